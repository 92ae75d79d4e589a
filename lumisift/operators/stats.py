"""Statistics of a library: one pass for the counts, histograms with and without empty bins, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.functions.scalars import day_key, item_bytes, moment, month_key, year_key
from lumisift.operators.criteria import predicates
from lumisift.params import QueryParams

TRAITS = ("noFace", "hasFace", "screenshot", "document", "blurry", "dark", "bright")


def _weight():
    return item_bytes(F.col("space_taken"), F.col("size_bytes"))


def _yes(name: str):
    return F.coalesce(F.col(name), F.lit(False))


def scalars(items: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return items.agg(
        F.count("*").alias("total"),
        F.count_if(_yes("analyzed")).alias("analyzed"),
        F.count_if(_yes("is_video")).alias("videos"),
        F.coalesce(F.sum(F.when(_yes("is_video"), F.col("duration"))), zero).alias("video_seconds"),
        F.count_if(F.col("ts").isNull()).alias("no_date"),
        F.coalesce(F.sum(_weight()), zero).alias("bytes"),
        F.count_if(_weight() > 0).alias("sized"),
    )


def histogram(items: DataFrame, unit: str) -> DataFrame:
    """(key, n) of dated rows; unit: year, month or day."""
    key = {"year": year_key, "month": month_key, "day": day_key}[unit](F.col("ts"))
    return items.filter("ts is not null").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def histograms(items: DataFrame) -> DataFrame:
    """(unit, key, n) of all three units in one shuffle."""
    keys = F.explode(F.create_map(F.lit("year"), year_key(F.col("ts")), F.lit("month"), month_key(F.col("ts")), F.lit("day"), day_key(F.col("ts"))))
    return items.filter("ts is not null").select(keys.alias("unit", "key")).groupBy("unit", "key").agg(F.count("*").alias("n"))


def _dense(items: DataFrame, key, size: int, name: str) -> DataFrame:
    counted = items.filter("ts is not null").groupBy(key.cast("long").alias(name)).agg(F.count("*").alias("n"))
    spine = items.sparkSession.range(size).withColumnRenamed("id", name)
    return spine.join(counted, name, "left").select(name, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def by_weekday(items: DataFrame) -> DataFrame:
    """Seven rows, Sunday is 0."""
    return _dense(items, F.dayofweek(moment(F.col("ts"))) - 1, 7, "weekday")


def by_hour(items: DataFrame) -> DataFrame:
    return _dense(items, F.hour(moment(F.col("ts"))), 24, "hour")


def traits(items: DataFrame) -> DataFrame:
    """Rows with features that match each trait at the default thresholds."""
    table = predicates(QueryParams())
    return items.filter("features is not null").agg(*[F.count_if(table[k]).alias(k) for k in TRAITS])


def busiest_days(items: DataFrame, n: int = 12) -> DataFrame:
    return histogram(items, "day").orderBy(F.desc("n"), "key").limit(n)


def latest_months(items: DataFrame, n: int = 24) -> DataFrame:
    return histogram(items, "month").orderBy(F.desc("key")).limit(n)


def no_date(items: DataFrame) -> DataFrame:
    lost = F.col("ts").isNull()
    return items.agg(F.count_if(lost).alias("undated"), F.count_if(lost & F.col("date_source").isNull()).alias("legacy"))


def group_sizes(items: DataFrame) -> DataFrame:
    """(group_id, size): rows in which each group appears."""
    return items.select("id", F.explode("people").alias("group_id")).distinct().groupBy("group_id").agg(F.count("*").alias("size"))


def storage_line(items: DataFrame) -> DataFrame:
    return items.agg(F.coalesce(F.sum(_weight()), F.lit(0).cast("long")).alias("bytes"), F.count_if(_weight() > 0).alias("measured"), F.count("*").alias("total"))


def face_candidates(items: DataFrame, least: float = 0.35):
    ok = _yes("analyzed") & F.col("url").isNotNull() & ~_yes("is_video") & (F.coalesce(F.col("features.face_score"), F.lit(0.0)) >= least)
    return items.filter(ok)


def progress(items: DataFrame, least: float = 0.35) -> DataFrame:
    face = _yes("analyzed") & F.col("url").isNotNull() & ~_yes("is_video") & (F.coalesce(F.col("features.face_score"), F.lit(0.0)) >= least)
    one = items.agg(
        F.count("*").alias("total"),
        F.count_if(_yes("analyzed")).alias("analysed"),
        F.count_if(~_yes("analyzed") & F.col("url").isNotNull()).alias("pending"),
        F.count_if(face).alias("face_total"),
        F.count_if(face & _yes("people_scanned")).alias("face_done"),
    )
    work = F.col("total") + F.col("face_total")
    return one.withColumn("face_pending", F.col("face_total") - F.col("face_done")).withColumns(
        {
            "ratio": F.when(work > 0, (F.col("analysed") + F.col("face_done")).cast("double") / work.cast("double")).otherwise(F.lit(0.0)),
            "complete": (work > 0) & (F.col("pending") == 0) & (F.col("face_done") >= F.col("face_total")),
        }
    )


#: Verdicts, and the shares in percent from which the stronger two hold.
NO_MATCHES, NOTHING_ASKED, FEW = "No matches", "Enable a criterion to begin", "A few catches"
STRONG = ((25, "Big clean-up ahead"), (8, "Good potential"))


def cleanup_score(total_and_caught: DataFrame, any_enabled: bool = True) -> DataFrame:
    """One row (total, caught) -> share in percent and a verdict."""
    share = F.col("caught").cast("double") * F.lit(100.0) / F.nullif(F.col("total"), F.lit(0).cast("long")).cast("double")
    verdict = F.when(F.col("caught") == 0, NO_MATCHES if any_enabled else NOTHING_ASKED)
    for least, text in STRONG:
        verdict = verdict.when(share >= least, text)
    verdict = verdict.otherwise(FEW)
    return total_and_caught.withColumn("share", share).withColumn("verdict", verdict)


def milestones(one: DataFrame) -> DataFrame:
    """Of a progress row: the milestone it has reached."""
    reached = F.when(F.col("complete"), "complete").when(F.col("analysed") >= 10_000, "10k").when(F.col("analysed") >= 1_000, "1k")
    return one.withColumn("milestone", reached)


def phases(spent: DataFrame, names: list[str]) -> DataFrame:
    """Share of each timing column of all time, and the worst phase."""
    sums = spent.agg(*[F.coalesce(F.sum(n), F.lit(0.0)).cast("double").alias(n) for n in names])
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    worst = F.array_max(F.array(*[F.struct(F.col(n).alias("v"), F.lit(n).alias("k")) for n in names]))["k"]
    return sums.select(*[F.when(total > 0, F.col(n) / total).otherwise(F.lit(0.0)).alias(f"{n}_share") for n in names], F.when(total > 0, worst).alias("worst"))


def failures(items: DataFrame) -> DataFrame:
    return items.filter("analysis_error is not null").groupBy(F.col("analysis_error").alias("reason")).agg(F.count("*").alias("n"))
