"""Vectors near others, by blocks of a matrix product.

Both sides are dealt into blocks of a bounded number of bytes by a hash of their ids; a pair of blocks is one group of a cogrouped
job, so neither side is ever whole in a task or on the driver, and only what lies within the distance leaves a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block's vectors as doubles, and rows of it that meet the other block at once.
BLOCK_BYTES, ROWS_AT_ONCE = 16 << 20, 2048


def unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors along the last axis; zero stays zero. Empty ones are an error."""
    v = np.asarray(v, np.float64)
    if v.shape[-1] == 0:
        raise ValueError("empty vector")
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, n, out=v.copy(), where=n > 0)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.clip(a @ b.T, -1, 1)


def blocks_for(rows: DataFrame) -> int:
    """Blocks that the vectors of rows fill."""
    first = rows.select(F.size("vector").alias("n")).first()
    return max(1, -(-rows.count() * 8 * first.n // BLOCK_BYTES)) if first else 1


def _within(eps: float, nearest: bool, mutual: bool):
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"id": left.id[:0], "key": right.key[:0], "distance": np.zeros(0)})]
        if not len(left) or not len(right):
            return found[0]
        right = right.sort_values("key", ignore_index=True)  # the first of equals
        own = unit(np.stack(right.vector))
        ids, keys = left.id.to_numpy(), right.key.to_numpy()
        best = np.full(len(right), np.inf), np.zeros(len(right), np.int64)
        for at in range(0, len(left), ROWS_AT_ONCE):
            here = ids[at : at + ROWS_AT_ONCE]
            d = distance(unit(np.stack(left.vector.iloc[at : at + ROWS_AT_ONCE])), own)
            if mutual:
                d[here[:, None] == keys[None, :]] = np.inf
                order = np.argsort(here, kind="stable")
                row = order[d[order].argmin(axis=0)]
                least = d[row, np.arange(len(keys))]
                better = (least < best[0]) | ((least == best[0]) & (here[row] < ids[best[1]]))
                best[0][better], best[1][better] = least[better], at + row[better]
            i, j = (np.arange(len(d)), d.argmin(axis=1)) if nearest else np.nonzero(d <= eps)
            keep = d[i, j] <= eps
            found.append(pd.DataFrame({"id": here[i[keep]], "key": keys[j[keep]], "distance": d[i[keep], j[keep]]}))
        if mutual:
            keep = best[0] <= eps
            found.append(pd.DataFrame({"id": keys[keep], "key": ids[best[1][keep]], "distance": best[0][keep]}))
        return pd.concat(found, ignore_index=True)

    return meet


def near(left: DataFrame, right: DataFrame, eps: float, nearest: bool = True, mutual: bool = False) -> DataFrame:
    """(id, key, distance): pairs of left (id, vector) and right (key, vector) at most eps apart in cosine distance.

    With nearest, a row of left has its nearest one of each block, the least key of equals; the caller takes the least of those. With
    mutual both sides hold the same kind of ids: rows aren't held against themselves, and those of right get their nearest ones, too.
    """
    a, b = blocks_for(left), blocks_for(right)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    anew = lambda c: F.col(c).alias(c)  # noqa: E731  the two sides can be one table
    one = left.select(anew("id"), anew("vector"), deal("id", a).alias("a"), every(b).alias("b"))
    other = right.select(anew("key"), anew("vector"), deal("key", b).alias("b"), every(a).alias("a"))
    kinds = dict(left.dtypes)["id"], dict(right.dtypes)["key"]
    return one.groupBy("a", "b").cogroup(other.groupBy("a", "b")).applyInPandas(_within(eps, nearest, mutual), f"id {kinds[0]}, key {kinds[1]}, distance double")
