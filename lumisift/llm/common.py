"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.operators.shared import delete_path, delete_shared, shared_dir, written  # noqa: F401  shared with the rest of the library

#: Words are runs of anything but ASCII white space; bytes.split() splits at exactly these characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cut lineage through a table in the shared folder.
saved = written


def discard(df: DataFrame) -> None:
    """Delete the files of a saved() table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete_path(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of phases whose results are written and whose frames are gone: it does once the driver has collected them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_row_ids(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(rid, doc_id, text, those to keep): rid is doc_id where that is unique and not null, else an id written next to each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    odd = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if odd:
        return saved(rows.withColumn("rid", F.monotonically_increasing_id()))
    return rows.withColumn("rid", F.col("doc_id"))


def byte_rows(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, without decoding."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks_of(batches, size: int, column: str = "text"):
    """Arrow batches dealt anew into lists of whole rows of about `size` bytes: yields (batch, first row, last row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0), dtype=np.int64)
        ends, start, base = np.cumsum(lengths), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: each input bit reaches all output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words, as drawn from a dictionary that grows with new ones."""

    def of(w):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        return h

    return np.fromiter(map(of, words), np.uint64, len(words))


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretch of a sequence of 64-bit values, from prefix sums."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        if base not in self._powers or len(self._powers[base][0]) < n + 1:
            size = max(1 << 12, 1 << int(n).bit_length())
            with np.errstate(over="ignore"):
                up = np.full(size, base, np.uint64)
                up[0] = 1
                down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
                down[0] = 1
                self._powers[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        up, self.down = self._powers[base]
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values * up[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[start + length] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        """Of each stretch of this length."""
        n = len(self.sums) - length
        with np.errstate(over="ignore"):
            return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the least key (32 bits; the last of equals) in each window of this width."""
    n = len(keys)
    packed = (keys.astype(np.uint64) << np.uint64(32)) | (np.uint64(n) - np.arange(n, dtype=np.uint64))
    step = 1
    while step * 2 <= width:
        packed = np.minimum(packed[:-step], packed[step:])
        step *= 2
    if step < width:
        packed = np.minimum(packed[: len(packed) - (width - step)], packed[width - step :])
    return (np.uint64(n) - (packed & np.uint64(0xFFFFFFFF))).astype(np.int64)
