"""Near duplicates: neighbours in time whose two fingerprints are close, closed to sets, with one keeper each.

The band of `window` neighbours is an equi-join on blocks of ranks (a row meets its own block and the next), never a range
join. Sets grow by hooking roots and jumping pointers on written tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumisift.functions.scalars import hamming_halves, hash_halves
from lumisift.operators.orders import with_rank
from lumisift.operators.shared import written


def eligible(items: DataFrame) -> DataFrame:
    """(id, ts, rn, dh, dl, ah, al): rows with a 16-digit dhash in order of time, then id."""
    (dh, dl), (ah, al) = hash_halves(F.col("features.dhash")), hash_halves(F.col("features.ahash"))
    rows = items.select("id", F.coalesce("ts", F.lit(0).cast("long")).alias("ts"), dh.alias("dh"), dl.alias("dl"), ah.alias("ah"), al.alias("al")).filter("dh is not null")
    return with_rank(rows, [F.col("ts").asc(), F.col("id").asc()], "rn")


def pairs(items: DataFrame, distance: int = 8, window: int = 80) -> DataFrame:
    """(a, b, rn_a, rn_b): pairs at most `window` eligible rows apart whose dhash differs in `distance` bits, ahash in 6 more, at most."""
    return _pairs(eligible(items), distance, window)


def _block(window: int):
    return F.floor(F.col("rn") / window).cast("long")


def _pairs(rows: DataFrame, distance: int, window: int) -> DataFrame:
    rows = rows.withColumn("block", _block(window))
    cols = [c for c in rows.columns if c != "block"]
    left = rows.select("block", *[F.col(c).alias(f"a_{c}") for c in cols])
    right = rows.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") - 1))).select("block", *[F.col(c).alias(f"b_{c}") for c in cols])
    near = (F.col("b_rn") > F.col("a_rn")) & (F.col("b_rn") <= F.col("a_rn") + window)
    d = hamming_halves(F.col("a_dh"), F.col("a_dl"), F.col("b_dh"), F.col("b_dl")) <= distance
    a = hamming_halves(F.col("a_ah"), F.col("a_al"), F.col("b_ah"), F.col("b_al")) <= distance + 6
    asked = F.col("a_asked") | F.col("b_asked") if "asked" in cols else F.lit(True)
    return left.join(right, "block").filter(near & asked & d & a).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a_rn").alias("rn_a"), F.col("b_rn").alias("rn_b"))


def closure(edges: DataFrame) -> DataFrame:
    """(node, root) of numbered nodes under edges (a, b): root is the least node that can be reached."""
    edges = written(edges.select("a", "b"))
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        a, b = label.select(F.col("node").alias("a"), F.col("root").alias("ra")), label.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        crossing = edges.join(a, "a").join(b, "b").filter("ra <> rb")
        hooks = written(crossing.groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("to")))
        if hooks.isEmpty():  # no node's label is above itself, so a set's common label is its least node
            return label
        hooked = written(label.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        label = written(hooked.join(hooked.select(F.col("node").alias("root"), F.col("root").alias("up")), "root").select("node", F.col("up").alias("root")))


def groups(items: DataFrame, distance: int = 8, window: int = 80) -> DataFrame:
    """(root, id, rn): sets of two and more; root is the id of the earliest member."""
    rows = written(eligible(items))  # ranked once
    return _sets(_pairs(rows, distance, window), rows)


def _sets(found: DataFrame, rows: DataFrame) -> DataFrame:
    sets = closure(found.select(F.col("rn_a").alias("a"), F.col("rn_b").alias("b")))
    rows = rows.select("id", "rn")
    return sets.join(rows, sets.node == rows.rn).select("root", "id", "rn").join(rows.select(F.col("rn").alias("root"), F.col("id").alias("root_id")), "root").select(F.col("root_id").alias("root"), "id", "rn")


@dataclass(frozen=True)
class NearDuplicates:
    """Near duplicates at one state of the items: the ranked rows, the pairs and the sets, all written."""

    rows: DataFrame
    pairs: DataFrame
    sets: DataFrame
    distance: int = 8
    window: int = 80

    @classmethod
    def of(cls, items: DataFrame, distance: int = 8, window: int = 80) -> NearDuplicates:
        rows = written(eligible(items))
        found = written(_pairs(rows, distance, window))
        return cls(rows, found, written(_sets(found, rows)), distance, window)

    def refreshed(self, items: DataFrame) -> NearDuplicates:
        """The same of other items: only what lies within `window` ranks of a change is compared, and only sets that a pair has joined or left are closed anew.

        New rows, and rows with another time or fingerprint, are compared with their neighbours. Where rows have gone their neighbours may have come
        near each other: fewer than `window` rows are between such two, so either had a gone row in its block of old ranks or
        the next. Other pairs stand as long as they are `window` ranks apart, at most.
        """
        rows = written(eligible(items))
        old, cols = self.rows, ("ts", "dh", "dl", "ah", "al")
        both = rows.join(old.select("id", F.col("rn").alias("_rn"), *[F.col(c).alias(f"_{c}") for c in cols]), "id", "full_outer")
        same = F.col("rn").isNotNull() & F.col("_rn").isNotNull()
        for c in cols:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        state = written(both.select("id", "rn", "_rn", same.alias("same")))
        came = state.filter("rn is not null and not same").select("id")
        gone = old.join(state.filter("_rn is not null and not same").select("id"), "id", "left_semi")
        around = F.explode(F.array(*[F.col("_b") + k for k in (-1, 0, 1)]))
        broken = gone.select(_block(self.window).alias("_b")).distinct().select(around.alias("_b")).distinct()
        beside = old.withColumn("_b", _block(self.window)).join(broken, "_b", "left_semi").select("id")
        asked = written(came.unionByName(beside).distinct().withColumn("asked", F.lit(True)))
        marked = rows.join(asked, "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        near = marked.filter("asked").select(_block(self.window).alias("_b")).distinct().select(around.alias("_b")).distinct()
        some = marked.withColumn("_b", _block(self.window)).join(near, "_b", "left_semi").drop("_b")
        a, b = rows.select(F.col("id").alias("a"), F.col("rn").alias("rn_a")), rows.select(F.col("id").alias("b"), F.col("rn").alias("rn_b"))
        settled = self.pairs.select("a", "b").join(asked.select(F.col("id").alias("a")), "a", "left_anti").join(asked.select(F.col("id").alias("b")), "b", "left_anti")
        settled = settled.join(a, "a").join(b, "b").filter((F.col("rn_b") > F.col("rn_a")) & (F.col("rn_b") <= F.col("rn_a") + self.window))
        found = written(settled.select("a", "b", "rn_a", "rn_b").unionByName(_pairs(some, self.distance, self.window)))
        # sets with a pair that is new or gone, and whatever they are joined to now
        names = ["a", "b"]
        changed = found.select(*names).exceptAll(self.pairs.select(*names)).unionByName(self.pairs.select(*names).exceptAll(found.select(*names)))
        ends = changed.select(F.explode(F.array(*names)).alias("id")).distinct()
        roots = self.sets.join(ends, "id", "left_semi").select("root").distinct()
        touched = written(ends.unionByName(self.sets.join(roots, "root", "left_semi").select("id")).distinct())
        again = found.join(touched.select(F.col("id").alias("a")), "a", "left_semi")
        rest = self.sets.join(touched, "id", "left_anti").select("root", "id").join(rows.select("id", "rn"), "id")
        sets = written(_sets(again, rows).unionByName(rest.select("root", "id", "rn")))
        return NearDuplicates(rows, found, sets, self.distance, self.window)


def keepers(dup: DataFrame, items: DataFrame, strategy: str = "sharpest") -> DataFrame:
    """(root, id) of the copy to keep: the sharpest, first or last; the earlier one of equals. None for `none`."""
    if strategy == "none":
        return dup.select("root", "id").limit(0)
    f = F.col("features")
    zero, infinite = F.lit(0.0), F.lit(float("inf"))
    best = {
        "sharpest": F.coalesce(f["lap_var"], zero) + F.coalesce(f["nat_w"].cast("double"), zero) * F.coalesce(f["nat_h"].cast("double"), zero) * F.lit(1e-5),
        "first": -F.coalesce(F.col("ts").cast("double"), infinite),
        "last": F.coalesce(F.col("ts").cast("double"), -infinite),
    }[strategy]
    rows = dup.join(items.select("id", best.alias("_best")), "id")
    w = Window.partitionBy("root").orderBy(F.desc("_best"), "rn")
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("root", "id")


def selectable(dup: DataFrame, keep: DataFrame) -> DataFrame:
    return dup.select("root", "id").join(keep.select("id"), "id", "left_anti")


def set_sizes(dup: DataFrame) -> DataFrame:
    """(id, similar_size)"""
    sizes = dup.groupBy("root").agg(F.count("*").alias("similar_size"))
    return dup.join(sizes, "root").select("id", "similar_size")
