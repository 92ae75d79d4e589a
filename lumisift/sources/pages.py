"""Listing pages: the positional wire format, catalogue rows, and a stream of page files.

A page is a line of JSON, `[[items...], next page id, last instant]`; a folder of such lines, in order of file name, is a
timeline from new to old. Missing places are null and entries that aren't items are dropped.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumisift.functions.scalars import thumb_url

#: Keys of an item's options, and the ownership entry of items that somebody else shared.
DURATION, FAVOURITE, DESCRIPTION, LIVE, SHARED = "76647426", "163238866", "396644657", "146008172", 27
PAGE_SIZE, SOURCES = 500, (1, 2, 3)

ITEM = """media_key string, thumb string, width int, height int, timestamp long, timezone_offset long, creation_timestamp long, dedup_key string,
is_archived boolean, is_favourite boolean, duration long, is_video boolean, is_live boolean, description string, is_owned boolean""".replace("\n", " ")


class ListingError(Exception):
    """kind: http, auth, shape or network."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


def _get(raw: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(raw, path, kind)


def _truthy(raw: Column, path: str) -> Column:
    text = _get(raw, path, "string")
    return text.isNotNull() & ~F.lower(text).isin("false", "0", "", "null")


def parse_items(pages: DataFrame, column: str = "value") -> DataFrame:
    """A row per item of pages of JSON text: page, place, ITEM's columns."""
    number = F.col("page") if "page" in pages.columns else F.monotonically_increasing_id()
    page = pages.select(number.alias("page"), F.try_parse_json(column).alias("p"))
    raw = page.select("page", F.posexplode(_get(F.col("p"), "$[0]", "array<variant>")).alias("place", "raw"))
    x = F.col("raw")
    entries = _get(x, "$", "array<variant>")
    options = F.col("options")  # the last entry, taken once for all that is read in it
    number = lambda at: _get(x, at, "string").try_cast("double").cast("long")
    duration = _get(options, f"$['{DURATION}'][0]", "string").try_cast("double")
    owners = F.coalesce(_get(x, "$[7]", "array<variant>"), F.array().cast("array<variant>"))
    shared = F.exists(owners, lambda o: F.coalesce(F.array_contains(_get(o, "$", "array<string>"), str(SHARED)), F.lit(False)))
    rows = raw.withColumn("options", F.element_at(entries, -1)).filter(entries.isNotNull() & (F.coalesce(_get(x, "$[0]", "string"), F.lit("")) != ""))
    return rows.select(
        "page", "place",
        _get(x, "$[0]", "string").alias("media_key"), F.nullif(_get(x, "$[1][0]", "string"), F.lit("")).alias("thumb"), _get(x, "$[1][1]", "int").alias("width"), _get(x, "$[1][2]", "int").alias("height"),
        number("$[2]").alias("timestamp"), number("$[4]").alias("timezone_offset"), number("$[5]").alias("creation_timestamp"), _get(x, "$[3]", "string").alias("dedup_key"),
        _truthy(x, "$[13]").alias("is_archived"), _truthy(options, f"$['{FAVOURITE}'][0]").alias("is_favourite"),
        F.floor(duration / 1000 + F.lit(0.5)).cast("long").alias("duration"), duration.isNotNull().alias("is_video"), _get(options, f"$['{LIVE}']", "string").isNotNull().alias("is_live"),
        F.nullif(_get(options, f"$['{DESCRIPTION}'][0]", "string"), F.lit("")).alias("description"), (~shared).alias("is_owned"),
    )


def parse_page(pages: DataFrame, column: str = "value") -> DataFrame:
    """(next_page_id, last_timestamp) of each page."""
    p = F.try_parse_json(column)
    return pages.select(F.nullif(_get(p, "$[1]", "string"), F.lit("")).alias("next_page_id"), _get(p, "$[2]", "string").try_cast("long").alias("last_timestamp"))


def parse_media_info(pages: DataFrame, column: str = "value") -> DataFrame:
    """A row per metadata entry, which are at [0][1] of a page."""
    raw = pages.select(F.explode(_get(F.try_parse_json(column), "$[0][1]", "array<variant>")).alias("raw"))
    x = F.col("raw")
    tail = F.element_at(_get(x, "$[1]", "array<variant>"), -1)
    number = lambda v, at: _get(v, at, "string").try_cast("double").cast("long")
    return raw.filter(F.coalesce(_get(x, "$[0]", "string"), F.lit("")) != "").select(
        _get(x, "$[0]", "string").alias("id"), F.nullif(_get(x, "$[1][3]", "string"), F.lit("")).alias("file_name"), number(x, "$[1][6]").alias("info_ts"), number(x, "$[1][9]").alias("size_bytes"),
        (number(tail, "$[0]") == 1).alias("takes_up_space"), number(tail, "$[1]").alias("space_taken"), (number(tail, "$[2]") == 2).alias("is_original_quality"),
    )


def to_rows(items: DataFrame, thumb_size: int = 176, now: int = 0, account: int | None = None, order: Column | None = None) -> DataFrame:
    """Catalogue rows of parsed items; sizes and names come with the metadata."""
    who = None if account is None else F.lit(account)
    return items.select(
        F.col("media_key").alias("id"), thumb_url(F.col("thumb"), thumb_size, who).alias("url"), F.col("thumb").alias("url_raw"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("file_name"),
        F.col("timestamp").alias("ts"), F.when(F.col("timestamp").isNotNull(), "exact").alias("precision"), F.lit("api").alias("date_source"), "is_video", "is_archived", "is_favourite", "is_owned", "duration", "dedup_key", "width", "height",
        F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("long").alias("space_taken"), (F.lit(0).cast("long") if order is None else order).alias("order"), F.lit(now).cast("long").alias("discovered_at"),
    )


def with_info(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Catalogue rows with their metadata; rows without any stay as they are."""
    i = info.select("id", *[F.col(c).alias(f"_{c}") for c in ("file_name", "size_bytes", "space_taken", "takes_up_space", "is_original_quality")])
    out = rows.join(i, "id", "left")
    for c in ("file_name", "size_bytes", "space_taken", "takes_up_space", "is_original_quality"):
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)) if c in rows.columns else F.col(f"_{c}")).drop(f"_{c}")
    return out.withColumn("label", F.coalesce("file_name", "label"))


def info_in_chunks(keys: list[str], fetch: Callable[[list[str]], list], size: int = 200) -> Iterator:
    """Metadata of one listing page's keys, chunk by chunk: a failed chunk is skipped, an auth error ends it."""
    for i in range(0, len(keys), size):
        try:
            yield from fetch(keys[i : i + size])
        except ListingError as e:
            if e.kind == "auth":
                raise


@dataclass(frozen=True)
class Cursor:
    older_than: int | None = None
    last_timestamp: int | None = None
    page_id: str | None = None
    reached_end: bool = False
    known: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str | None) -> Cursor | None:
        return cls(**json.loads(text)) if text else None


@dataclass(frozen=True)
class Start:
    before: int | None
    page_id: str | None
    reason: str


def plan_start(cursor: Cursor | None, older_than: int | None = None, resume: bool = True) -> Start:
    """Where a run begins, and why."""
    reason = (
        "no-resume" if not resume
        else "first-run" if cursor is None
        else "window-changed" if cursor.older_than != older_than
        else "completed" if cursor.reached_end
        else "no-position" if not cursor.last_timestamp
        else None
    )
    return Start(older_than, None, reason) if reason else Start(cursor.last_timestamp, cursor.page_id, "resume")


def with_retries(fetch: Callable[[], object], refresh: Callable[[], None] | None = None, retries: int = 4, wait: float = 0.6, sleep=time.sleep):
    """Network and http errors are tried again with doubled waits; auth refreshes once; shape never is."""
    refreshed = False
    for n in range(retries + 1):
        try:
            return fetch()
        except ListingError as e:
            if e.kind == "auth" and refresh and not refreshed:
                refresh()
                refreshed = True
            elif e.kind in ("auth", "shape") or n == retries:
                raise
            else:
                sleep(wait * 2**n)
    raise ListingError("network", "no retries left")


def read_pages(spark: SparkSession, folder: str, files: int = 200) -> DataFrame:
    """A stream of the pages of listing files (file, start, value), at most `files` of them in a batch; Spark lists and reads them, so any store it knows will do.

    A row is a line, and large files are read in blocks by several tasks; start is the block's place in its file.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files).option("lineSep", "\n").text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def page_lines(batch: DataFrame) -> DataFrame:
    """(page, value): the pages of a batch of files, one a line, in order of file, start (if there is one) and line."""
    at = [c for c in ("file", "start") if c in batch.columns]
    order = batch.select(*at).distinct().select(*at, F.row_number().over(Window.orderBy(*at)).cast("long").alias("_block"))  # a row a block of the batch
    lines = batch.select(*at, F.explode(F.split("value", r"\r?\n")).alias("value")).filter(F.trim("value") != "")
    numbered = lines.withColumn("_line", F.monotonically_increasing_id().bitwiseAND((1 << 32) - 1))  # a block is read by one task, line by line
    return numbered.join(F.broadcast(order), at).select((F.shiftleft("_block", 32) + F.col("_line")).alias("page"), "value")


def fetch_info(keys: DataFrame, fetch: Callable[[list[str]], list[str]], size: int = 200, refresh: Callable[[], None] | None = None) -> DataFrame:
    """Metadata pages (value) of ids, fetched by the tasks in chunks with retries; a chunk that fails in the end is left out, an auth error ends the job."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = info_in_chunks(pdf.id.tolist(), lambda some: with_retries(lambda: fetch(some), refresh), size)
            yield pd.DataFrame({"value": list(found)}, dtype=object)

    return keys.select("id").mapInPandas(rows, "value string")
