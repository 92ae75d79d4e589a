"""The one table of criteria, and what reads it: filter results, badges and statistics.

Every predicate is true or false, never null: what is unknown matches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.functions.scalars import item_bytes
from lumisift.params import CRITERIA, QueryParams

#: Face methods whose score alone is believed.
TRUSTED_FACE_METHODS = ("ultraface", "FaceDetector")


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def predicates(p: QueryParams) -> dict[str, Column]:
    """criterion -> Column over items; `duplicates` needs a Boolean column dup_selectable."""
    f = F.col("features")
    photo = ~_sure(F.col("is_video"))
    weight = item_bytes(F.col("space_taken"), F.col("size_bytes"))
    chosen = F.array(*map(F.lit, p.person_ids)).cast("array<int>")
    read = F.col("people").isNotNull() & F.lit(bool(p.person_ids))
    empty_face = ~_sure(f["face_score"] > p.no_face_max)
    believed = _sure(f["face_method"].isin(*TRUSTED_FACE_METHODS)) | (F.coalesce(f["skin_frac"], F.lit(0.0)) <= p.no_face_max_skin)
    bounds = [F.col("ts") >= p.date_from] * (p.date_from is not None) + [F.col("ts") <= p.date_to] * (p.date_to is not None)
    table = {
        "noFace": f.isNotNull() & photo & empty_face & believed,
        "hasFace": f["face_score"] >= p.has_face_min,
        "screenshot": f["screenshot_score"] >= p.screenshot_min,
        "document": f["document_score"] >= p.document_min,
        "blurry": photo & (f["blur_score"] >= p.blur_min),
        "dark": photo & (f["dark_score"] >= p.dark_min),
        "bright": photo & (f["bright_score"] >= p.bright_min),
        "duplicates": F.col("dup_selectable"),
        "longVideo": F.col("is_video") & (F.coalesce("duration", F.lit(0)) >= p.long_video_sec),
        "largeFile": (weight > 0) & (weight >= p.large_file_mb * 1024 * 1024),
        "dateRange": reduce(lambda a, b: a & b, bounds, F.lit(True)),
        "withPerson": read & F.arrays_overlap("people", chosen),
        "withoutPerson": read & ~F.arrays_overlap("people", chosen),
    }
    return {k: _sure(table[k]) for k in CRITERIA}


def apply_lens(items: DataFrame, lens: str) -> DataFrame:
    if lens == "video":
        return items.filter(_sure(F.col("is_video")))
    return items.filter(~_sure(F.col("is_video"))) if lens == "photo" else items


def undecided(items: DataFrame) -> DataFrame:
    return items.filter(~_sure(F.col("kept")))


def count_media(items: DataFrame) -> DataFrame:
    video = F.count_if(_sure(F.col("is_video")))
    return items.agg(F.count("*").alias("all"), video.alias("video"), (F.count("*") - video).alias("photo"))


def evaluated(items: DataFrame, p: QueryParams) -> DataFrame:
    """items with matched: the enabled criteria that hold, in the table's order."""
    table = predicates(p)
    on = [k for k in CRITERIA if k in p.enabled]
    matched = F.array_compact(F.array(*[F.when(table[k], F.lit(k)) for k in on])) if on else F.array().cast("array<string>")
    return items.withColumn("matched", matched)


def filtered(items: DataFrame, p: QueryParams) -> DataFrame:
    """Union or intersection of the enabled criteria; with none enabled, everything."""
    out = evaluated(items, p)
    if not p.enabled:
        return out
    need = len(p.enabled) if p.mode == "all" else 1
    return out.filter(F.size("matched") >= need)


def count_per_criterion(items: DataFrame, p: QueryParams) -> DataFrame:
    """One row: each criterion alone, enabled or not."""
    return items.agg(*[F.count_if(c).alias(k) for k, c in predicates(p).items()])
