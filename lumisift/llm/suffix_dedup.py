"""Suffix-array dedup: bytes covered by a string of 400 bytes that also starts elsewhere.

Only suffixes that can have such a neighbour are sorted. In each window of 400 bytes the least hash of its short strings
chooses an anchor, the same in every copy, and only anchors whose short string occurs twice go on (the others' distinguishing
prefix is shorter than a window). Windows that chose anchor p start `back` bytes before it; such a window is repeated if some
other suffix at an equal anchor agrees with p's in back bytes to the left and in 400 - back bytes to the right.

The suffixes at anchors are sorted by the prefix-aware distributed merge sort of `suffix_sort`, those that agree to the right
for a whole window by what stands to their left, read backward. The common prefixes with some neighbours in that order
explain windows; the one with the nearest bounds how far any other suffix agrees to the right. A second sort, of what stands
to the left of equal anchors, bounds how far any other agrees to the left. Windows within both bounds that no neighbour
explained are few (near copies with different edits on both sides) and are looked up by hash among the suffixes at equal
anchors.

Null and empty texts have no bytes. Repeated rows are copies of each other: all their bytes from 400 on are covered.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import Rolling, blocks_of, byte_rows, mixed, release, saved, table, window_minima, with_row_ids, word_hashes
from lumisift.llm.suffix_sort import common_prefix, cut_at, decoded, front_coded, merged

WINDOW = 400
#: Bytes in the hashed strings from which anchors are chosen.
GRAM = 48
BLOCK_BYTES = 2_000_000
#: Bytes of suffixes that a task sorts at once, and that a range of the sort should hold; strings sampled for each range.
RUN_BYTES, RANGE_BYTES, SAMPLED = 24 << 20, 24 << 20, 16
#: Neighbours on either side that a suffix is compared with while some of its windows are unexplained.
NEIGHBOURS = 16
#: Odd multipliers of the polynomial hashes, and the hashes that stand for byte values.
BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))

#: Bytes that stand for a word (its hash) where windows are counted in words.
WORD = 8

#: Kinds of sorted strings: to the right of an anchor and then to its left, or to its left alone.
RIGHT, LEFT = 0, 1
#: What travels with a string: the anchor, how far before it its windows start, and the bytes there are to its right.
IDS = ["rid", "at", "near", "far", "right"]
SORTED = "kind int, rid long, at long, near int, far int, agrees int, copy boolean, spans array<int>"


def _values(text: bytes) -> np.ndarray:
    return _VALUES[np.frombuffer(text, np.uint8)]


def _coded(batch, words: bool) -> list[bytes]:
    """The strings that are sorted: texts as UTF-8, or WORD bytes a word."""
    texts = byte_rows(batch.column("text"))
    if not words:
        return texts
    known: dict[bytes, int] = {}
    return [word_hashes(t.split(), known).tobytes() for t in texts]


def _anchor_rows(window: int, gram: int, words: bool):
    """(rid, core, at, near, far): windows starting near to far bytes before `at` chose the anchor there."""

    def rows(batches):
        for batch in blocks_of(batches, BLOCK_BYTES):
            out = []
            for rid, text in zip(batch.column("rid").to_pylist(), _coded(batch, words)):
                if len(text) < window:
                    continue
                roll = Rolling(_values(text), BASES[0])
                chosen = window_minima(roll.all(gram) >> np.uint64(32), window - gram + 1)
                first = np.flatnonzero(np.diff(chosen, prepend=-1))
                last = np.append(first[1:], len(chosen)) - 1
                at = chosen[first]
                out.append((np.full(len(at), rid), roll.of(at, gram).view(np.int64), at, at - last, at - first))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, (np.int64, np.int64, np.int32, np.int32, np.int32))], names=["rid", "core", "at", "near", "far"])

    return rows


def _strings(batch, window: int, gram: int, words: bool):
    """(kind, string, *IDS) of each listed anchor of a batch's documents."""
    for rid, text, found in zip(batch.column("rid").to_pylist(), _coded(batch, words), batch.column("found").to_pylist()):
        for f in found:
            at, far = f["at"], f["far"]
            right, left = text[at : at + window], text[at - far : at][::-1]
            ids = rid, at, f["near"], far, len(right)
            yield RIGHT, right.ljust(window, b"\0") + left, *ids
            yield LEFT, right[:gram] + left, *ids


def _sampled(window: int, gram: int, words: bool):
    def rows(batches):
        for batch in batches:
            kind, string, *ids = zip(*_strings(batch, window, gram, words))
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(string, pa.binary()), *(pa.array(x, pa.int64()) for x in ids)], names=["kind", "string", *IDS])

    return rows


def _runs(shared: Broadcast, window: int, gram: int, words: bool):
    """Sorted, cut and front-coded runs; ranges of the second kind are numbered after those of the first."""

    def rows(batches):
        splitters = shared.value

        def emit(runs):
            found = []
            for kind in (RIGHT, LEFT):
                runs[kind].sort()
                found += [{"part": part + kind * (len(splitters[RIGHT]) + 1), **front_coded(piece)} for part, piece in cut_at(runs[kind], splitters[kind])]
            return pa.RecordBatch.from_pylist(found, pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("prefixes", "sizes", "rest", "ids"))]))

        runs, weight = ([], []), 0
        for batch in batches:
            for kind, *x in _strings(batch, window, gram, words):
                runs[kind].append(tuple(x))
                weight += len(x[0]) + 200
                if weight >= RUN_BYTES:
                    yield emit(runs)
                    runs, weight = ([], []), 0
        if weight:
            yield emit(runs)

    return rows


class _Suffix:
    """One string of the first sort among its neighbours: the windows explained, and how far a neighbour agrees to the right."""

    __slots__ = ("agrees", "copy", "ids", "open", "shared", "spans", "string")

    def __init__(self, string: bytes, shared: int, ids: list[int]):
        self.string, self.shared, self.ids = string, shared, ids
        self.agrees, self.spans, self.open, self.copy = 0, [], True, False

    def explain(self, low: int, high: int) -> None:
        low, high = max(low, self.ids[2]), min(high, self.ids[3])
        if low <= high and not any(a <= low and high <= b for a, b in self.spans):
            self.spans.append((low, high))
            self.open = (low, high) != (self.ids[2], self.ids[3])

    def row(self) -> tuple:
        return RIGHT, *self.ids[:4], self.agrees, self.copy, [x for s in self.spans for x in s]


def _compare(held: list[_Suffix], new: _Suffix, window: int) -> None:
    """Hold the new string against those before it, nearest first."""
    agree = len(new.string)
    for old, shared in zip(reversed(held), [new.shared, *(h.shared for h in reversed(held))]):
        agree = min(agree, shared)
        right = min(agree, window, old.ids[4], new.ids[4])
        if old is held[-1]:
            new.copy = new.ids[2:] == old.ids[2:] and new.string == old.string
            # how far any other agrees: NUL bytes may agree with a shorter neighbour's padding, and a third string goes on there
            old.agrees, new.agrees = (max(x.agrees, min(agree, window, x.ids[4])) for x in (old, new))
        if old.open or new.open:
            left = common_prefix(old.string[window:], new.string[window:])
            old.explain(window - right, left)
            new.explain(window - right, left)


def _merge_right(strings, following: tuple | None, window: int, gram: int):
    held: list[_Suffix] = []
    for string, shared, ids in strings:
        new = _Suffix(string, shared, ids)
        if held and shared < gram:
            yield from (h.row() for h in held)
            held = []
        _compare(held, new, window)
        held.append(new)
        if len(held) > NEIGHBOURS:
            yield held.pop(0).row()
    if held and following:
        new = _Suffix(following[0], common_prefix(held[-1].string, following[0]), list(following[1:]))
        if new.shared >= gram:
            _compare(held, new, window)
        yield new.row()
    yield from (h.row() for h in held)


def _merge_left(strings, following: tuple | None, gram: int):
    last, agrees, string = None, 0, b""
    row = lambda ids, shared: (LEFT, *ids[:4], shared - gram, False, None)
    for string, shared, ids in strings:
        if last:
            yield row(last, max(agrees, shared))
        last, agrees = ids, shared
    if last and following:
        shared = common_prefix(string, following[0])
        yield row(following[1:], shared)
        agrees = max(agrees, shared)
    if last:
        yield row(last, agrees)


def _merge(shared: Broadcast, window: int, gram: int):
    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        splitters = shared.value
        part = int(key[0])
        kind = int(part > len(splitters[RIGHT]))
        part -= kind * (len(splitters[RIGHT]) + 1)
        strings = merged([decoded(r.prefixes, r.sizes, r.rest, r.ids, len(IDS)) for r in pdf.itertuples()])
        following = splitters[kind][part] if part < len(splitters[kind]) else None  # the next range begins with it
        rows = _merge_left(strings, following, gram) if kind else _merge_right(strings, following, window, gram)
        return pd.DataFrame(rows, columns=["kind", "rid", "at", "near", "far", "agrees", "copy", "spans"])

    return merge


def _judged(window: int):
    """(rid, at, low, high, sure): windows starting low to high bytes before `at`, repeated for sure or yet to be looked up.

    Of each distinct suffix one row with all its windows and sure null: what others are looked up in.
    """

    def rows(batches):
        for batch in batches:
            out = {k: [] for k in ("rid", "at", "low", "high", "sure")}
            for rid, at, near, far, right, left, copy, lists in zip(*(batch.column(c).to_pylist() for c in ("rid", "at", "near", "far", "right", "left", "copy", "spans"))):
                spans = sorted((s[i], s[i + 1]) for s in lists or [] for i in range(0, len(s or []), 2))
                joined: list[list[int]] = []
                for low, high in spans:
                    if joined and low <= joined[-1][1] + 1:
                        joined[-1][1] = max(joined[-1][1], high)
                    else:
                        joined.append([low, high])
                place, end = max(near, window - (right or 0)), min(far, -1 if left is None else left)
                gaps = []
                for low, high in [*joined, [end + 1, end + 1]]:
                    if place < min(low, end + 1):
                        gaps.append((place, min(low - 1, end)))
                    place = max(place, high + 1)
                for sure, found in ((True, joined), (False, gaps), (None, [] if copy else [(near, far)])):
                    for low, high in found:
                        for k, v in zip(out, (rid, at, low, high, sure)):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], names=list(out))

    return rows


def _window_hashes(window: int, words: bool):
    def rows(batches):
        for batch in batches:
            out = []
            for rid, text, found in zip(batch.column("rid").to_pylist(), _coded(batch, words), batch.column("found").to_pylist()):
                roll = Rolling(_values(text), BASES[1])
                for f in found:
                    back = np.arange(f["low"], f["high"] + 1)
                    hashes = roll.of(f["at"] - back, window).view(np.int64)
                    asked = np.zeros(len(back), bool)
                    for a in f["asks"]:
                        asked[a["low"] - f["low"] : a["high"] - f["low"] + 1] = True
                    out.append((np.full(len(back), rid), np.full(len(back), f["core"]), np.full(len(back), f["at"]), back, hashes, asked))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, (np.int64, np.int64, np.int64, np.int32, np.int64, bool))], names=["rid", "core", "at", "back", "hash", "asked"])

    return rows


def _in_text(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where in the text the words lie that such spans of word hashes cover whole."""
    if not spans:
        return []
    places = np.array([m.span() for m in _WORDS.finditer(text)])
    return [(int(places[-(-a // WORD), 0]), int(places[b // WORD - 1, 1])) for a, b in spans]


def _cut(keep: tuple[str, ...], as_text: bool, words: bool):
    def rows(batches):
        for batch in blocks_of(batches, BLOCK_BYTES):
            res = {k: [] for k in ("rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
            for rid, doc, text, spans in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), byte_rows(batch.column("text")), batch.column("spans").to_pylist()):
                removed, count, kept, end = 0, 0, [], 0
                merged_spans: list[list[int]] = []
                spans = [(s["a"], s["b"]) for s in spans or []]
                for s in sorted(_in_text(text, spans) if words else spans):
                    if merged_spans and s[0] <= merged_spans[-1][1]:
                        merged_spans[-1][1] = max(merged_spans[-1][1], s[1])
                    else:
                        merged_spans.append(list(s))
                for a, b in merged_spans:
                    kept.append(text[end:a])
                    removed, count, end = removed + b - a, count + 1, b
                kept.append(text[end:])
                for k, v in zip(res, (rid, doc, len(text), removed, count, b"".join(kept))):
                    res[k].append(v)
            if as_text:
                res["kept"] = [k.decode("utf-8", "ignore") for k in res["kept"]]
            kinds = {"kept": pa.string() if as_text else pa.binary()}
            yield pa.RecordBatch.from_arrays([*(pa.array(res[k], kinds.get(k, pa.int64())) for k in res), *(batch.column(k) for k in keep)], names=[*res, *keep])

    return rows


def _candidates(rows: DataFrame, window: int, gram: int, words: bool) -> DataFrame:
    """Anchors whose short string occurs twice."""
    anchors = saved(rows.select("rid", "text").mapInArrow(_anchor_rows(window, gram, words), "rid long, core long, at int, near int, far int"))
    # written, so that both sides of the join on a hot core can be split
    shared = saved(anchors.groupBy("core").agg(F.count("*").alias("times")).filter("times > 1").select("core"))
    return saved(anchors.join(shared, "core"))


def _splitters(rows: DataFrame, taking: DataFrame, count: int, parts: int, window: int, gram: int, words: bool) -> list[list[tuple]]:
    """For each kind, every SAMPLED-th string of a sorted sample of SAMPLED strings a range. Spark sorts; the driver gets the cuts alone."""
    if parts <= 1:
        return [[], []]
    few = taking.filter(F.pmod(F.xxhash64("rid", "at"), F.lit(max(1, count // (SAMPLED * parts)))) == 0)
    few = few.groupBy("rid").agg(F.collect_list(F.struct("at", "near", "far")).alias("found"))
    schema = ", ".join(["kind int, string binary", *(f"{c} long" for c in IDS)])
    sample = rows.join(few, "rid").select("rid", "text", "found").mapInArrow(_sampled(window, gram, words), schema)
    # an id that counts from 0 in each sorted partition
    ordered = saved(sample.orderBy("kind", "string", *IDS).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    blocks = ordered.groupBy("kind", "part").agg(F.count("*").alias("n"), F.min("place").alias("least")).orderBy("kind", "part").collect()
    base, starts = [0, 0], []
    for b in blocks:  # a row for each sorted partition and kind
        starts.append((b.kind, b.part, base[b.kind] - b.least))
        base[b.kind] += b.n
    starts = rows.sparkSession.createDataFrame(starts, "kind int, part int, start long")
    chosen = ordered.join(F.broadcast(starts), ["kind", "part"]).filter((F.col("place") + F.col("start")) % SAMPLED == SAMPLED - 1)
    out = [[], []]
    for r in chosen.select("kind", "string", *IDS).collect():
        out[r.kind].append((bytes(r.string), *(r[c] for c in IDS)))
    return [sorted(set(x)) for x in out]


def _sort_and_judge(rows: DataFrame, taking: DataFrame, window: int, gram: int, words: bool) -> DataFrame:
    spark = rows.sparkSession
    total = taking.agg(F.count("*").alias("k"), F.sum(F.col("far") + window).alias("bytes")).first()
    parts = max(1, -(-(total.bytes or 0) // RANGE_BYTES), min(spark.sparkContext.defaultParallelism, total.k // 1000))
    splitters = spark.sparkContext.broadcast(_splitters(rows, taking, total.k, parts, window, gram, words))
    listed = taking.groupBy("rid").agg(F.collect_list(F.struct("at", "near", "far")).alias("found"))
    pieces = rows.select("rid", "text").join(listed, "rid").mapInArrow(_runs(splitters, window, gram, words), "part int, prefixes binary, sizes binary, rest binary, ids binary")
    done = saved(pieces.groupBy("part").applyInPandas(_merge(splitters, window, gram), SORTED))
    right, left = F.when(F.col("kind") == RIGHT, F.col("agrees")), F.when(F.col("kind") == LEFT, F.col("agrees"))
    by_anchor = done.groupBy("rid", "at").agg(F.max("near").alias("near"), F.max("far").alias("far"), F.max(right).alias("right"), F.max(left).alias("left"), F.bool_or("copy").alias("copy"), F.collect_list("spans").alias("spans"))
    return saved(by_anchor.mapInArrow(_judged(window), "rid long, at long, low int, high int, sure boolean"))


def _looked_up(rows: DataFrame, taking: DataFrame, judged: DataFrame, window: int, words: bool) -> DataFrame:
    """(rid, at, back): windows yet to be judged that occur twice at equal anchors."""
    anchors = taking.select("rid", F.col("at").cast("long").alias("at"), "core")
    asking = saved(judged.filter("not sure").groupBy("rid", "at").agg(F.collect_list(F.struct("low", "high")).alias("asks"), F.min("low").alias("ask_low"), F.max("high").alias("ask_high")).join(anchors, ["rid", "at"]))
    spans = saved(asking.groupBy("core").agg(F.min("ask_low").alias("core_low"), F.max("ask_high").alias("core_high")))
    # of the distinct suffixes at those anchors, the windows that anyone asks for
    held = judged.filter("sure is null").select("rid", "at", "low", "high").join(anchors, ["rid", "at"]).join(spans, "core")
    held = held.join(asking.select("rid", "at", "asks"), ["rid", "at"], "left")
    held = held.withColumn("low", F.greatest("low", "core_low")).withColumn("high", F.least("high", "core_high")).filter("low <= high")
    listed = held.groupBy("rid").agg(F.collect_list(F.struct("core", "at", "low", "high", F.coalesce("asks", F.array().cast("array<struct<low:int,high:int>>")).alias("asks"))).alias("found"))
    windows = saved(rows.select("rid", "text").join(listed, "rid").mapInArrow(_window_hashes(window, words), "rid long, core long, at long, back int, hash long, asked boolean"))
    twice = saved(windows.groupBy("core", "hash").agg(F.count("*").alias("times"), F.bool_or("asked").alias("asked")).filter("times > 1 and asked").select("core", "hash"))
    return saved(windows.filter("asked").join(twice, ["core", "hash"], "left_semi").select("rid", "at", "back"))


def repeated_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, words: bool = False) -> DataFrame:
    """(rid, a, b): spans of rows (rid, text), in bytes of what `_coded` gives, that repeated windows cover; they may overlap."""
    spark = rows.sparkSession
    taking = _candidates(rows, window, gram, words)
    release(spark)
    judged = _sort_and_judge(rows, taking, window, gram, words)
    release(spark)
    sure = judged.filter("sure").select("rid", (F.col("at") - F.col("high")).cast("int").alias("a"), (F.col("at") - F.col("low") + window).cast("int").alias("b"))
    if judged.filter("not sure").isEmpty():
        return sure
    found = _looked_up(rows, taking, judged, window, words)
    release(spark)
    return sure.unionByName(found.select("rid", (F.col("at") - F.col("back")).cast("int").alias("a"), (F.col("at") - F.col("back") + window).cast("int").alias("b")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: tuple[str, ...] = (), as_text: bool = False, words: bool = False) -> DataFrame:
    """Per row: rid, doc_id, n_bytes, n_removed, n_spans, kept (binary, or text without broken characters) and the columns to keep.

    With words, window and gram count words: the sorted strings are sequences of word hashes, and a span of removed words takes the
    white space within it but none around it.
    """
    rows = with_row_ids(docs, keep)
    if words:
        window, gram = WORD * window, WORD * gram
    spans = repeated_windows(rows, window, gram, words).groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    kinds = dict(docs.dtypes)
    counts = "rid long, doc_id long, n_bytes long, n_removed long, n_spans long"
    schema = ", ".join([counts, f"kept {'string' if as_text else 'binary'}", *(f"{c} {kinds[c]}" for c in keep)])
    return rows.join(spans, "rid", "left").select("rid", "doc_id", "text", "spans", *keep).mapInArrow(_cut(keep, as_text, words), schema)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """The same rows by definition, for tests."""
    times: dict[bytes, int] = {}
    texts = {d: (t or "").encode() for d, t in docs}
    digest = lambda s: hashlib.blake2b(s, digest_size=12).digest()
    for t in texts.values():
        for i in range(len(t) - window + 1):
            k = digest(t[i : i + window])
            times[k] = times.get(k, 0) + 1
    out = {}
    for d, t in texts.items():
        gone = np.zeros(len(t) + 1, np.int32)
        for i in range(len(t) - window + 1):
            if times[digest(t[i : i + window])] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        cut = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~cut])
        out[d] = len(t), int(cut.sum()), int((np.diff(cut.astype(int), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest()
    return out
