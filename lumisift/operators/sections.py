"""Sections of an ordered answer: every row is in one, and the flat list is the sections end to end.

Input rows have rank, their place in the answer's order; output rows also have section, title, section_rank and row_rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumisift.functions.scalars import day_key, group_label


#: Titles of the sections for what is unknown.
NOBODY, UNDATED, ALONE = "Nobody recognised", "No date", "Nothing resembles these"
#: Consecutive ranks that are numbered in one task at most.
NUMBERED = 1 << 17


def _row_rank(df: DataFrame) -> DataFrame:
    """Places within sections. A section may hold most rows, so each stretch of ranks is numbered by itself and gets its section's count before it."""
    rows = df.withColumn("_stretch", F.floor(F.col("rank") / NUMBERED))
    counts = rows.groupBy("section", "_stretch").agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy("section").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("section", "_stretch", F.coalesce(so_far, F.lit(0).cast("long")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("section", "_stretch").orderBy("rank"))
    return rows.withColumn("_place", place).join(before, ["section", "_stretch"]).withColumn("row_rank", F.col("_before") + F.col("_place")).drop("_stretch", "_place", "_before")


def by_person(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with its rarest known person, rarest persons first; those with none last. groups: group_id, size, name."""
    known = groups.select(F.col("group_id").alias("_g"), F.col("size").alias("_size"), F.col("name").alias("_name"))
    seen = items.select("id", F.posexplode("people").alias("_pos", "_g")).join(known, "_g")
    rarest = seen.groupBy("id").agg(F.min_by(F.struct("_g", "_size", "_name"), F.struct("_size", "_pos")).alias("_r"))
    out = items.join(rarest, "id", "left")
    found = out.select("_r").filter("_r is not null").distinct().withColumn("section_rank", F.row_number().over(Window.orderBy("_r._size", "_r._g")).cast("long"))  # a row a person
    last = found.agg((F.count("*") + 1).alias("_last"))
    out = out.join(found.withColumnRenamed("_r", "_f"), F.col("_r") == F.col("_f"), "left").crossJoin(F.broadcast(last))
    out = out.withColumn("section", F.when(F.col("_r").isNull(), "person:none").otherwise(F.concat(F.lit("person:"), F.col("_r._g").cast("string"))))
    out = out.withColumn("title", F.when(F.col("_r").isNull(), NOBODY).otherwise(group_label(F.col("_r._name"), F.col("_r._g"))))
    return _row_rank(out.withColumn("section_rank", F.coalesce("section_rank", "_last")).drop("_r", "_f", "_last"))


def by_day(items: DataFrame) -> DataFrame:
    """Runs of equal days in the order, not all rows of a day."""
    day = F.when(F.col("ts").isNull(), "none").otherwise(day_key(F.col("ts")))
    rows = items.withColumn("_day", day)
    before = rows.select((F.col("rank") + 1).alias("rank"), F.col("_day").alias("_before"))
    marked = rows.join(before, "rank", "left").withColumn("_new", F.when(F.col("_before") == F.col("_day"), 0).otherwise(1))
    starts = marked.filter("_new = 1").select("rank", "_day")  # a row a run
    w = Window.orderBy("rank")
    runs = starts.select(F.col("rank").alias("_from"), F.row_number().over(w).cast("long").alias("section_rank"), F.lead("rank", 1).over(w).alias("_to"), F.col("_day").alias("_run_day"))
    # each run's rows join on its day, and their places pick the run
    out = rows.join(runs, (rows["_day"] == runs["_run_day"]) & (F.col("rank") >= F.col("_from")) & ((F.col("rank") < F.col("_to")) | F.col("_to").isNull()))
    out = out.withColumn("section", F.concat(F.lit("day:"), F.col("_day"))).withColumn("title", F.when(F.col("_day") == "none", UNDATED).otherwise(F.col("_day")))
    return out.withColumn("row_rank", (F.col("rank") - F.col("_from") + 1).cast("long")).drop("_day", "_from", "_to", "_run_day")


def by_similarity(items: DataFrame, duplicates: DataFrame) -> DataFrame:
    """A section per set of lookalikes, by how many of it are here; single ones last. duplicates: root, id."""
    out = items.join(duplicates.select("id", F.col("root").alias("_root")), "id", "left")
    sets = out.filter("_root is not null").groupBy("_root").agg(F.count("*").alias("_n"))
    sets = sets.withColumn("section_rank", F.row_number().over(Window.orderBy(F.desc("_n"), "_root")).cast("long"))  # a row a set
    last = sets.agg((F.count("*") + 1).alias("_last"))
    out = out.join(sets, "_root", "left").crossJoin(F.broadcast(last))
    out = out.withColumn("section", F.coalesce(F.concat(F.lit("similar:"), F.col("_root")), F.lit("similar:none")))
    out = out.withColumn("title", F.when(F.col("_root").isNull(), ALONE).otherwise(F.concat(F.col("_n").cast("string"), F.lit(" lookalikes"))))
    return _row_rank(out.withColumn("section_rank", F.coalesce("section_rank", "_last")).drop("_root", "_n", "_last"))


def for_order(items: DataFrame, order: str, groups: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame | None:
    """The sections that go with an order, or None."""
    if order == "rarePeople":
        return by_person(items, groups) if groups is not None else None
    if order in ("oldest", "newest"):
        return by_day(items)
    if order == "similar" and duplicates is not None:
        return by_similarity(items, duplicates)
    return None


def flat(sectioned: DataFrame) -> DataFrame:
    return sectioned.orderBy("section_rank", "row_rank")


def section_members(sectioned: DataFrame, section: str) -> DataFrame:
    """All ids of a section, rendered or not."""
    return sectioned.filter(F.col("section") == section).select("id")
