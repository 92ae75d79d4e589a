"""Selection, decisions and the plan of a deletion; nothing here deletes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisift.functions.scalars import format_bytes, item_bytes
from lumisift.operators.orders import with_rank
from lumisift.operators.shared import written
from lumisift.sources.sinks import chunk_sink


def disposition() -> Column:
    """notOwned, noKey or deletable, in this order; an unknown owner is the user."""
    no_key = F.col("dedup_key").isNull() | (F.col("dedup_key") == "")
    return F.when(~F.coalesce("is_owned", F.lit(True)), "notOwned").when(no_key, "noKey").otherwise("deletable")


def plan(items: DataFrame) -> DataFrame:
    """(id, dedup_key, disposition, bytes)"""
    return items.select("id", "dedup_key", disposition().alias("disposition"), item_bytes(F.col("space_taken"), F.col("size_bytes")).alias("bytes"))


def summary(planned: DataFrame) -> DataFrame:
    """One row of a plan: counts by disposition, and bytes of how many measured deletable ones."""
    deletable = F.col("disposition") == "deletable"
    return planned.agg(
        F.count_if(deletable).alias("deletable"),
        F.count_if(F.col("disposition") == "noKey").alias("no_key"),
        F.count_if(F.col("disposition") == "notOwned").alias("not_owned"),
        F.coalesce(F.sum(F.when(deletable, F.col("bytes"))), F.lit(0).cast("long")).alias("bytes"),
        F.count_if(deletable & (F.col("bytes") > 0)).alias("sized"),
    ).withColumn("text", format_bytes(F.col("bytes")))


def write_manifest(planned: DataFrame, path: str) -> None:
    """The default sink: a reviewable manifest."""
    planned.write.mode("errorifexists").parquet(path)


def run_sink(planned: DataFrame, sink: Callable[[list[str]], object], log: str, size: int = 100, fatal: type[Exception] = PermissionError, writers: int = 4) -> DataFrame:
    """Hand the deletable keys to an action, `size` at a time in order of id, by `writers` tasks; a row (id, dedup_key, chunk, outcome, error) for each.

    Each chunk's own outcome decides: done, failed (the next one follows), or unsent, where a `fatal` error had ended the run. The
    outcomes are files below `log`, by what is in the chunk; so a task that runs again, or a repeat of the run with the same log, sends no chunk a
    second time that is done. A plan with other chunks can use the same log.
    """
    spark = planned.sparkSession
    keys = planned.filter("disposition = 'deletable'").select("id", "dedup_key")
    ranked = with_rank(keys, [F.col("id").asc(), F.col("dedup_key").asc()], "place")
    table = written(ranked.select(F.floor((F.col("place") - 1) / size).alias("number"), "place", "id", "dedup_key"))
    table = table.withColumn("chunk", F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "dedup_key")).over(Window.partitionBy("number"))), lambda x: x["dedup_key"]), "\n")))
    table = written(table)
    spark.dataSource.register(chunk_sink(sink, fatal))
    table.repartition(writers, "number").sortWithinPartitions("number", "place").select("chunk", "id", "dedup_key").write.format("chunk_sink").option("log", log).mode("append").save()
    sent = spark.read.schema("chunk string, outcome string, error string").json(f"{log}/outcomes")
    return table.join(sent, "chunk", "left").select("id", "dedup_key", "chunk", F.coalesce("outcome", F.lit("unsent")).alias("outcome"), "error")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row: requested, done, failed, unsent, and three of the errors."""
    kinds = [F.count_if(F.col("outcome") == k).alias(k) for k in ("done", "failed", "unsent")]
    return outcomes.agg(F.count("*").alias("requested"), *kinds, F.slice(F.array_sort(F.collect_set("error")), 1, 3).alias("errors"))


def trim_selection(selection: DataFrame, visible: DataFrame) -> DataFrame:
    return selection.join(visible.select("id"), "id", "left_semi")


def shift_range(ranked: DataFrame, anchor: str, target: str) -> DataFrame:
    """Ids between two rows in the displayed order, both included."""
    ends = ranked.filter(F.col("id").isin(anchor, target)).agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    return ranked.join(F.broadcast(ends)).filter(F.col("rank").between(F.col("lo"), F.col("hi"))).select("id")


def toggled(selection: DataFrame, ids: DataFrame, on: bool) -> DataFrame:
    """The selection with ids ticked or not."""
    return selection.select("id").unionByName(ids.select("id")).distinct() if on else selection.select("id").join(ids.select("id"), "id", "left_anti")


def keep_rest(visible: DataFrame, selection: DataFrame) -> DataFrame:
    """Ids that are on show and not selected: to be marked as kept."""
    return visible.select("id").join(selection.select("id"), "id", "left_anti")


def drop_unusable(items: DataFrame) -> DataFrame:
    return items.filter("url is not null")
