"""Orders that put unknown keys last either way, and ranks over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisift.functions.scalars import duration_text, format_bytes, format_date, item_bytes, percent
from lumisift.operators.shared import shared_dir


def people_likelihood() -> Column:
    return F.when(~F.coalesce("is_video", F.lit(False)), F.col("features.face_score"))


def with_attachment(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """items with attachment: the size of the largest group present; 0 for nobody, null for unread. sizes: group_id, size."""
    seen = items.select("id", F.explode("people").alias("group_id")).join(sizes.select("group_id", F.col("size").alias("_size")), "group_id", "left")
    most = seen.groupBy("id").agg(F.max("_size").alias("_most"))
    return items.join(most, "id", "left").withColumn("attachment", F.when(F.col("people").isNotNull(), F.coalesce("_most", F.lit(0).cast("long")))).drop("_most")


def sort_key(order: str) -> tuple[Column, bool]:
    """(key, descending) over filtered items; rarePeople needs attachment, similar needs similar_size."""
    still = lambda c: F.when(~F.coalesce("is_video", F.lit(False)), c)
    table = {
        "suspicion": (F.size("matched"), True),
        "noPeople": (people_likelihood(), False),
        "rarePeople": (F.col("attachment") if order == "rarePeople" else None, False),
        "similar": (F.col("similar_size") if order == "similar" else None, True),
        "biggest": (F.nullif(item_bytes(F.col("space_taken"), F.col("size_bytes")), F.lit(0).cast("long")), True),
        "blurry": (still(F.col("features.blur_score")), True),
        "dark": (still(F.col("features.dark_score")), True),
        "oldest": (F.col("ts"), False),
        "newest": (F.col("ts"), True),
    }
    return table.get(order, table["suspicion"])


def tiebreak() -> list[Column]:
    return [F.coalesce("ts", F.lit(0).cast("long")).desc(), F.col("id").asc()]


def order_by(order: str) -> list[Column]:
    key, down = sort_key(order)
    return [key.desc_nulls_last() if down else key.asc_nulls_last(), *tiebreak()]


def grid_order() -> list[Column]:
    return tiebreak()


def available_orders(has_groups: bool, has_sizes: bool, has_similar: bool) -> dict[str, str]:
    """Orders that can't be answered yet, and why."""
    out = {}
    if not has_groups:
        out["rarePeople"] = "no groups"
    if not has_sizes:
        out["biggest"] = "no sizes"
    if not has_similar:
        out["similar"] = "no lookalikes"
    return out


def shared_folder(df: DataFrame) -> str:
    """A new folder that driver and executors share."""
    return shared_dir(df.sparkSession)


#: Bytes a table may have, by Spark's estimate, to be ranked in one task.
ONE_TASK_BYTES = 64 << 20


def with_rank(df: DataFrame, by: list[Column], name: str = "rank") -> DataFrame:
    """df with the 1-based place of each row in a total order.

    A large table is sorted by range and written, each part numbers its own rows, and the parts' sizes (a row a part)
    give the offsets. A table that is known to be small is numbered by one window.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) <= ONE_TASK_BYTES:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*by)).cast("long"))
    spark, path = df.sparkSession, shared_folder(df)
    df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_part", before.alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_n", "_before")


def top(items: DataFrame, order: str, n: int = 300) -> DataFrame:
    return items.orderBy(*order_by(order)).limit(n)


def neighbours(items: DataFrame, order: str) -> DataFrame:
    """id, previous and next id in an order; null at the ends."""
    ranked = with_rank(items.select("id", "ts", *[c for c in items.columns if c not in ("id", "ts")]), order_by(order)).select("id", "rank")
    a = ranked.select(F.col("id").alias("previous"), (F.col("rank") + 1).alias("rank"))
    b = ranked.select(F.col("id").alias("next"), (F.col("rank") - 1).alias("rank"))
    return ranked.join(a, "rank", "left").join(b, "rank", "left").select("id", "previous", "next")


def tile_facts(matches: DataFrame) -> DataFrame:
    """What a tile says of a filtered row: three labels, date, size, duration, and the presence score where noFace matched."""
    weight = item_bytes(F.col("space_taken"), F.col("size_bytes"))
    return matches.select(
        "id",
        F.slice("matched", 1, 3).alias("labels"),
        format_date(F.col("ts"), F.lit("day")).alias("date"),
        F.when(weight > 0, format_bytes(weight)).alias("size"),
        F.when(F.col("is_video"), duration_text(F.col("duration"))).alias("duration"),
        F.when(F.array_contains("matched", "noFace"), percent(F.coalesce(F.col("features.face_score"), F.lit(0.0)))).alias("presence"),
    )
