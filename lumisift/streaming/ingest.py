"""Incremental runs: listing, analysis and face passes over a catalogue, each idempotent, resumable and stoppable.

Listing is a stream with trigger availableNow whose micro-batches merge into the catalogue. Analysis and faces go through what is
pending slice by slice, each written before the next begins, or follow the catalogue's versions as streams of their own, beside the
listing. So a stop keeps what is merged, and a second run adds nothing.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumisift.operators import people
from lumisift.operators.duplicates import NearDuplicates
from lumisift.params import RunParams
from lumisift.sources import catalogue as C
from lumisift.sources import pages as P
from lumisift.streaming.changes import CatalogueChanges


class Stop(Exception):
    """Ends a stream before its next batch, or a pass before its next slice."""


class Abort:
    """A stop button: passes that were given it end before their next slice, and jobs and streams under way are cancelled."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self._set, self._queries = spark, f"lumisift-{uuid.uuid4().hex}", threading.Event(), []
        self._running, self._idle = 0, threading.Condition()

    def stop(self) -> None:
        self._set.set()
        threading.Thread(target=self._interrupt, daemon=True).start()
        for query in self._queries:
            query.stop()

    def _interrupt(self) -> None:
        """Again and again: a slice under way can be between two of its jobs."""
        with self._idle:
            while self._running:
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
                self._idle.wait(0.5)

    def is_set(self) -> bool:
        return self._set.is_set()

    def watch(self, query) -> None:
        self._queries.append(query)
        if self.is_set():
            query.stop()

    @contextmanager
    def jobs(self) -> Iterator[None]:
        """Jobs in here are cancelled by stop(), which ends the block with Stop."""
        if self.is_set():
            raise Stop
        self.spark.sparkContext.addJobTag(self.tag)
        with self._idle:
            self._running += 1
        try:
            yield
        except (Py4JJavaError, PySparkException) as e:
            if self.is_set():
                raise Stop from e
            raise
        finally:
            with self._idle:
                self._running -= 1
                self._idle.notify_all()
            self.spark.sparkContext.removeJobTag(self.tag)


@dataclass(frozen=True)
class ListingStats:
    pages: int = 0
    discovered: int = 0
    already_known: int = 0
    skipped_recent: int = 0
    skipped_no_thumb: int = 0
    barren: int = 0
    oldest: int | None = None
    last: int | None = None
    limit_reached: bool = False
    done: bool = False


def split_page(items: DataFrame, known: DataFrame, older_than: int | None) -> DataFrame:
    """Parsed items with verdict: recent, known, repeated (within the batch), no_thumb or new."""
    recent = F.col("timestamp") >= older_than if older_than is not None else F.lit(False)
    marked = items.join(known.select(F.col("id").alias("media_key"), F.lit(True).alias("_known")), "media_key", "left")
    again = F.row_number().over(Window.partitionBy("media_key").orderBy("page", "place")) > 1
    verdict = (
        F.when(F.coalesce(recent, F.lit(False)), "recent")
        .when(F.col("_known"), "known")
        .when(F.col("thumb").isNull(), "no_thumb")
        .when(again, "repeated")
        .otherwise("new")
    )
    return marked.withColumn("verdict", verdict).drop("_known")


def _take_pending(cat: C.Catalogue, run: RunParams) -> ListingStats:
    """Rows that earlier runs left beyond their limit into the items, up to this run's limit; those too recent for it wait."""
    waiting = cat.read("pending").join(cat.ids(), "id", "left_anti")
    ready = waiting if run.older_than is None else waiting.filter(F.coalesce(F.col("ts") < run.older_than, F.lit(True)))
    taken = (ready.orderBy("batch", "page", "place").limit(run.max_per_run) if run.max_per_run else ready).persist()
    n = taken.agg(F.count("*").alias("n"), F.min("ts").alias("oldest")).first()
    if n.n:
        cat.upsert(taken.drop("batch", "page", "place"))
        cat.change("pending", taken.select("id"), lambda old: old.join(taken.select("id"), "id", "left_anti").select(old.columns))
    taken.unpersist()
    return ListingStats(discovered=n.n, oldest=n.oldest, last=n.oldest, limit_reached=bool(run.max_per_run) and n.n >= run.max_per_run)


def list_pages(spark: SparkSession, folder: str | None, cat: C.Catalogue, run: RunParams, checkpoint: str, now: int = 0, batch_files: int = 200, abort: Abort | None = None, pages: DataFrame | None = None) -> ListingStats:
    """Read new pages into the catalogue; the stream's checkpoint is the position within them.

    pages: a stream (file, value) in place of the folder's files, such as sources.listing.stream_pages gives.

    A run that follows a completed one stops after `barren_pages` batches in a row without anything new. Rows beyond the run's
    limit, whose pages the checkpoint has passed, wait in the catalogue's table of pending rows; the next run takes them first.
    """
    start = P.plan_start(P.Cursor.from_json(cat.get_meta("cursor")), run.older_than, run.resume)
    state = [_take_pending(cat, run)]

    def merge(files: DataFrame, number: int) -> None:
        s = state[0]
        if s.limit_reached or s.done or (abort and abort.is_set()):
            raise Stop  # the batch isn't committed, so the next run begins with it
        files = files.persist() if pages is not None else files  # a client's page is fetched once; files are read again, by lines
        batch = P.page_lines(files)
        items = P.parse_items(batch).persist()
        keys = items.select(F.col("media_key").alias("id"))
        known = cat.read_near("items", keys).select("id").unionByName(cat.read_near("pending", keys).select("id")).distinct()
        parsed = split_page(items, known, run.older_than).persist()
        n = {r.verdict: r.n for r in parsed.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
        items.unpersist()  # all of them are in parsed now
        times = parsed.agg(F.min(F.when(F.col("verdict") != "recent", F.col("timestamp"))).alias("oldest"), F.min("timestamp").alias("last")).first()
        new = parsed.filter("verdict = 'new'")
        room = run.max_per_run - s.discovered if run.max_per_run else None
        count = min(n.get("new", 0), room) if room is not None else n.get("new", 0)
        if count < n.get("new", 0):
            last = new.orderBy("page", "place").limit(count).agg(F.max(F.struct("page", "place")).alias("last")).first()["last"]
            within = F.lit(False) if last is None else (F.col("page") < last.page) | ((F.col("page") == last.page) & (F.col("place") <= last.place))
            later = new.filter(~within)
            rows = P.to_rows(later, run.thumb_size, now).join(later.select(F.col("media_key").alias("id"), F.lit(number).cast("long").alias("batch"), "page", "place"), "id")
            cat.change("pending", rows.select("id"), lambda old: old.unionByName(rows, allowMissingColumns=True).select(old.columns))  # before the items: a batch that runs again finds these known
            new = new.filter(within)
        if count:
            cat.upsert(P.to_rows(new, run.thumb_size, now))
        read = batch.count()
        parsed.unpersist()
        files.unpersist()
        barren = 0 if count else s.barren + 1
        state[0] = replace(
            s,
            pages=s.pages + read,
            discovered=s.discovered + count,
            already_known=s.already_known + n.get("known", 0) + n.get("repeated", 0),
            skipped_recent=s.skipped_recent + n.get("recent", 0),
            skipped_no_thumb=s.skipped_no_thumb + n.get("no_thumb", 0),
            barren=barren,
            oldest=min((v for v in (s.oldest, times.oldest) if v is not None), default=None),
            last=times.last if times.last is not None else s.last,
            limit_reached=room is not None and n.get("new", 0) >= room,
            done=start.reason == "completed" and barren >= run.barren_pages,
        )

    if not state[0].limit_reached:
        stream = P.read_pages(spark, folder, batch_files) if pages is None else pages
        query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if abort:
            abort.watch(query)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if not (state[0].limit_reached or state[0].done or (abort and abort.is_set())):
                raise
    s = state[0]
    ended = not s.limit_reached and not (abort and abort.is_set())
    cat.set_meta("cursor", P.Cursor(run.older_than, s.last, None, ended, cat.ids().count()).to_json())
    cat.note_progress(s.oldest)
    return s


def fill_sizes(cat: C.Catalogue, info: DataFrame) -> None:
    """Metadata into the catalogue, apart from the listing: its failure leaves the listed rows as they are."""
    cat.change("items", info.select("id"), lambda old: P.with_info(old, info).select(old.columns))


#: Items of a slice of a pass: what a stop can lose.
SLICE = 100_000


def _cuts(counts: dict[int, int], size: int) -> list[tuple[list[int], int, int]]:
    """(parts, share, shares) of each slice: parts that hold `size` ids together at most, or one of equal shares of a part that holds more."""
    out, room = [], 0
    for part, n in sorted(counts.items()):
        shares = -(-n // size)
        if shares > 1:
            out += [([part], k, shares) for k in range(shares)]
            room = 0
        elif n > room:
            out.append(([part], 0, 1))
            room = size - n
        else:
            out[-1][0].append(part)
            room -= n
    return out


def _slices(cat: C.Catalogue, todo: DataFrame, size: int, abort: Abort | None, step: Callable[[DataFrame, C.Within], None]) -> bool:
    """step(ids, their parts) for slices of the ids, one after the other; whether a stop came before the end.

    Slices follow the catalogue's parts, so that each rewrites its own parts and no other's, and a pass costs as much as it has to do.
    """
    of, dealt = cat.dealt(todo)
    counts = {r[0]: r[1] for r in dealt.groupBy("_part").count().collect()}  # a row a part
    for parts, share, shares in _cuts(counts, size):
        here = dealt.filter(F.col("_part").isin(parts))
        here = (here.filter(F.pmod(F.hash("id"), F.lit(shares)) == share) if shares > 1 else here).select("id")
        try:
            if abort is None:
                step(here, C.Within(of, parts))
            else:
                with abort.jobs():
                    step(here, C.Within(of, parts))
        except Stop:
            return True
    return False


def analyse(cat: C.Catalogue, todo: DataFrame, kernel: Callable[[DataFrame], DataFrame], size: int = SLICE, abort: Abort | None = None) -> dict:
    """kernel over the items of these ids: their features, or why there are none."""
    out = {"tried": 0, "failed": 0}

    def step(ids: DataFrame, within: C.Within) -> None:
        results = kernel(cat.read_near("items", ids, within).join(ids, "id", "left_semi")).persist()
        n = results.agg(F.count("*").alias("tried"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
        cat.save_features(results, within)
        results.unpersist()
        out["tried"], out["failed"] = out["tried"] + n.tried, out["failed"] + n.failed

    return out | ({"stopped": True} if _slices(cat, todo, size, abort, step) else {})


def find_faces(cat: C.Catalogue, todo: DataFrame, detect: Callable[[DataFrame], DataFrame], size: int = SLICE, abort: Abort | None = None) -> dict:
    """detect over the items of these ids: their faces; photos that failed stay unread."""
    out = {"read": 0}

    def step(ids: DataFrame, within: C.Within) -> None:
        results = detect(cat.read_near("items", ids, within).join(ids, "id", "left_semi")).persist()
        read = results.filter("ok").select("photo_id").distinct()
        n = read.count()
        cat.save_faces(results.filter("ok and vector is not null").select("id", "photo_id", "box", "score", "vector"), read, within)
        results.unpersist()
        out["read"] += n

    return out | ({"stopped": True} if _slices(cat, todo, size, abort, step) else {})


def analyse_pending(cat: C.Catalogue, kernel: Callable[[DataFrame], DataFrame], limit: int | None = None, size: int = SLICE, abort: Abort | None = None) -> dict:
    """kernel: pending items -> (id, features, error). Each item is tried once a run; failures stay pending with a reason."""
    todo = C.pending(cat.read("items"), limit).select("id").persist()  # what this run tries, whatever stays pending
    out = analyse(cat, todo, kernel, size, abort)
    todo.unpersist()
    return out


def scan_faces(cat: C.Catalogue, detect: Callable[[DataFrame], DataFrame], limit: int | None = None, size: int = SLICE, abort: Abort | None = None) -> dict:
    """detect: candidate items -> faces and a row (photo_id, ok) for each; photos that failed stay unread."""
    todo = C.people_candidates(cat.read("items"), limit).select("id").persist()
    out = find_faces(cat, todo, detect, size, abort)
    todo.unpersist()
    return out


def _follow(cat: C.Catalogue, want: str, step: Callable[[DataFrame], dict], checkpoint: str, abort: Abort | None):
    """A stream of ids from the catalogue's versions; step takes those of a batch that are still to be done."""
    cat.spark.dataSource.register(CatalogueChanges)
    rule = {"analysis": lambda i: C.pending(i).filter("analysis_error is null"), "faces": lambda i: C.people_candidates(i, None)}[want]

    def batch(ids: DataFrame, number: int) -> None:
        seen = ids.distinct().persist()
        todo = rule(cat.read_near("items", seen)).join(seen, "id", "left_semi").select("id").persist()
        if not todo.isEmpty() and step(todo).get("stopped"):
            raise Stop  # the batch isn't committed, so the next run begins with it
        todo.unpersist()
        seen.unpersist()

    ids = cat.spark.readStream.format("catalogue_changes").option("path", cat.path).option("want", want).load()
    query = ids.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(f"{want}-{uuid.uuid4().hex[:8]}").start()
    if abort:
        abort.watch(query)
    return query


def follow_analysis(cat: C.Catalogue, kernel: Callable[[DataFrame], DataFrame], checkpoint: str, size: int = SLICE, abort: Abort | None = None):
    """Analyse what the catalogue holds and whatever is listed later, until the stream is stopped. What failed before is left to analyse_pending."""
    return _follow(cat, "analysis", lambda todo: analyse(cat, todo, kernel, size, abort), checkpoint, abort)


def follow_faces(cat: C.Catalogue, detect: Callable[[DataFrame], DataFrame], checkpoint: str, size: int = SLICE, abort: Abort | None = None):
    """Read the faces of candidates as they come up, until the stream is stopped. A photo that failed is read again when its part changes."""
    return _follow(cat, "faces", lambda todo: find_faces(cat, todo, detect, size, abort), checkpoint, abort)


def near_duplicates(cat: C.Catalogue, distance: int = 8, window: int = 80) -> NearDuplicates:
    """Near duplicates of the catalogue's items, kept beside it by version and parameters: what is kept is read, or refreshed by what has changed since."""
    key, version, tables = f"near-{distance}-{window}", cat.version("items"), ("rows", "pairs", "sets")
    known, spark = cat.get_meta(key), cat.spark
    load = lambda at: NearDuplicates(*[spark.read.parquet(f"{cat.path}/{at['folder']}/{t}") for t in tables], distance, window)
    if known and known["version"] == version:
        return load(known)
    items = cat.read("items")
    new = load(known).refreshed(items) if known else NearDuplicates.of(items, distance, window)
    at = {"version": version, "folder": f"near-{uuid.uuid4().hex}"}
    for t in tables:
        getattr(new, t).write.parquet(f"{cat.path}/{at['folder']}/{t}")
    cat.set_meta(key, at)
    if known:
        cat._delete(known["folder"])
    return load(at)


def regroup(cat: C.Catalogue, eps: float = people.SHIPPED_EPS) -> DataFrame:
    """Group all faces anew, carry the stored names, and write each photo's people."""
    named = cat.get_meta("named", [])
    spark = cat.spark
    previous = spark.createDataFrame([(x["name"], x["centroid"]) for x in named], "name string, centroid array<double>") if named else None
    groups, photos = people.regroup(cat.read("faces"), previous, eps)
    cat.save_people(photos)
    return groups


def full_run(
    spark: SparkSession,
    folder: str,
    cat: C.Catalogue,
    run: RunParams,
    checkpoint: str,
    kernel: Callable[[DataFrame], DataFrame] | None = None,
    detect: Callable[[DataFrame], DataFrame] | None = None,
    info: DataFrame | None = None,
    abort: Abort | None = None,
    batch_files: int = 200,
) -> dict:
    """Listing, analysis and faces side by side, each a stream; then sizes and groups. All write one catalogue, part by part.

    A stop ends all of them with what they have merged. A follower that fails ends the run when the listing has ended.
    """
    analysis = follow_analysis(cat, kernel, f"{checkpoint}-analysis", abort=abort) if kernel is not None else None
    faces = follow_faces(cat, detect, f"{checkpoint}-faces", abort=abort) if detect is not None else None
    followers = [q for q in (analysis, faces) if q is not None]
    try:
        out: dict = {"listing": list_pages(spark, folder, cat, run, checkpoint, batch_files=batch_files, abort=abort)}
        if info is not None:
            fill_sizes(cat, info)
        for query in followers:  # faces wait for features
            if query.isActive or query.exception():
                query.processAllAvailable()
    except StreamingQueryException:
        if not (abort and abort.is_set()):
            raise
    finally:
        for query in followers:
            query.stop()
    if abort and abort.is_set():
        return out | {"stopped": True}
    items = cat.read("items")
    if kernel is not None:
        out["analysis"] = items.agg(F.count_if(F.col("analyzed")).alias("analysed"), F.count_if(F.col("analysis_error").isNotNull()).alias("failed")).first().asDict()
    if detect is not None:
        out["faces"] = {"read": items.filter("people_scanned").count()}
        out["groups"] = regroup(cat, run.eps)
    return out
