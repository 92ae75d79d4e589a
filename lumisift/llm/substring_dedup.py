"""Substring dedup by relative Lempel-Ziv parsing of documents against indexed reference blocks.

Anchors index the text: in each window of 50 words the least of its short-phrase hashes (cores) is chosen, so the same words choose
the same anchors everywhere. Only cores that occur in two documents take part. The reference of a core is its first occurrence
in its least document; references are laid out in blocks of whole words, each block with an index from core to place.

Every document is parsed against all blocks that index one of its cores. From each indexed core a match is extended word by word
to both sides as far as document and reference agree; matches that follow each other along one diagonal are one factor. Factors of
50 words or more in a lesser document are duplicate spans. At factor boundaries, windows that hold an indexed core but are not
inside its factor may still occur in another document: those, and only those, are looked up by their hashes. A window that a
factor explains occurs in the least document of all with its core, so factors and look-ups together decide every window.

A document that many others follow is the reference of many anchors: its part of a block is dealt several times, and the documents
parsed against it are dealt among them. No group of documents meets in one task.

Null and empty texts have no words. Rows with a null doc_id have no order: they remove nothing and lose nothing. Rows that
share a doc_id never remove each other's words; repeated rows each have their result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import Rolling, blocks_of, byte_rows, release, saved, table, window_minima, with_row_ids, word_hashes

WINDOW = 50
#: Words in the hashed phrases from which anchors are chosen; a window has WINDOW - GRAM + 1 of them.
GRAM = 8
BLOCK_BYTES = 2_000_000
#: Anchors that are parsed against a block in one task, about; and how many are extended at once.
PARSED, AT_ONCE = 50_000, 4096
#: Odd multipliers of the polynomial hashes.
BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

ANCHORS = "rid long, doc_id long, core long, at int, first int, n int"
STRETCHES = "block int, deal int, reference boolean, rid long, doc_id long, start int, words binary, anchors binary"
#: A factor covers the words from a up to b; a window to be looked up has a hash and starts at a.
FACTORS = "rid long, doc_id long, a int, b int, hash long"
RUNS = "rid long, doc_id long, n_words long, n_removed long, kept string"


def _anchors_of(values: np.ndarray, window: int, gram: int):
    """Anchors of one document: cores, places, first window and number of windows that chose them."""
    roll = Rolling(values, BASES[0])
    chosen = window_minima((roll.all(gram) >> np.uint64(32)), window - gram + 1)  # by window start
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    at = chosen[first]
    return roll.of(at, gram), at, first, np.diff(np.append(first, len(chosen)))


def _anchor_rows(window: int, gram: int):
    def rows(batches):
        known: dict[bytes, int] = {}
        for batch in blocks_of(batches, BLOCK_BYTES):
            if len(known) > 1_000_000:
                known.clear()
            out = []
            for rid, doc, text in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), byte_rows(batch.column("text"))):
                words = text.split()
                if doc is not None and len(words) >= window:
                    core, at, first, n = _anchors_of(word_hashes(words, known), window, gram)
                    out.append((np.full(len(at), rid), np.full(len(at), doc), core.view(np.int64), at, first, n))
            if out:
                kinds = np.int64, np.int64, np.int64, np.int32, np.int32, np.int32
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(zip(*out), kinds)], names=["rid", "doc_id", "core", "at", "first", "n"])

    return rows


def _stretch_rows(window: int):
    """The words around a document's anchors for each block: overlapping phrases (all windows of an anchor) join into a stretch."""

    def rows(batches):
        known: dict[bytes, int] = {}
        schema = pa.schema([("block", pa.int32()), ("deal", pa.int32()), ("reference", pa.bool_()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.binary()), ("anchors", pa.binary())])
        for batch in blocks_of(batches, BLOCK_BYTES):
            if len(known) > 1_000_000:
                known.clear()
            out = []
            for i, (rid, doc, text) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), byte_rows(batch.column("text")))):
                values = word_hashes(text.split(), known)
                found = batch.column("found")[i].values
                block, deals, owned, core, at, first, n = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "deals", "owned", "core", "at", "first", "n"))
                order = np.lexsort((at, deals, owned, block))
                block, deals, owned, core, at, first, n = (x[order] for x in (block, deals, owned, core, at, first, n))
                end = first + n + window - 1
                new = np.ones(len(at), bool)
                new[1:] = (block[1:] != block[:-1]) | (deals[1:] != deals[:-1]) | (owned[1:] != owned[:-1]) | (first[1:] > end[:-1])
                anchors = np.stack([core, at, first, n], axis=1)
                starts = np.flatnonzero(new)
                for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
                    words = values[first[lo] : end[hi - 1]].tobytes()
                    for deal in range(int(deals[lo])) if owned[lo] else [rid % int(deals[lo])]:
                        out.append((int(block[lo]), deal, bool(owned[lo]), rid, doc, int(first[lo]), words, anchors[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows


class Laid:
    """Stretches laid end to end: their words, and of each anchor its place there, its stretch's bounds, and what it says of its document."""

    def __init__(self, pdf: pd.DataFrame):
        parts = [np.frombuffer(w, np.uint64) for w in pdf.words]
        sizes = np.array([len(p) for p in parts], np.int64)
        base = np.cumsum(sizes) - sizes
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        lists = [np.frombuffer(a, np.int64).reshape(-1, 4) for a in pdf.anchors]
        of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        anchors = np.concatenate(lists) if lists else np.zeros((0, 4), np.int64)
        self.core, self.at, self.first, self.n = anchors.T
        #: What turns a place in a document into one here.
        self.shift = (base - pdf.start.to_numpy(np.int64))[of]
        self.low, self.high = base[of], (base + sizes)[of]
        self.rid, self.doc = pdf.rid.to_numpy(np.int64)[of], pdf.doc_id.to_numpy(np.int64)[of]


def _extended(own: Laid, other: Laid, to: np.ndarray, left: int, right: int):
    """How many words each anchor's match with the other side's anchor `to` reaches to its left, and to its right with itself."""
    lefts, rights = np.empty(len(own.at), np.int64), np.empty(len(own.at), np.int64)
    for i in range(0, len(own.at), AT_ONCE):
        rows = slice(i, i + AT_ONCE)
        t = to[rows]
        p, q = own.at[rows] + own.shift[rows], other.at[t] + other.shift[t]
        for steps, reach in ((-1 - np.arange(left), lefts), (np.arange(right), rights)):
            a, b = p[:, None] + steps, q[:, None] + steps
            inside = (a >= own.low[rows, None]) & (a < own.high[rows, None]) & (b >= other.low[t][:, None]) & (b < other.high[t][:, None])
            same = inside & (own.words[np.where(inside, a, 0)] == other.words[np.where(inside, b, 0)])
            reach[rows] = np.where(same.all(axis=1), len(steps), np.argmin(same, axis=1))
    return lefts, rights


def _parse(window: int, gram: int):
    """Factors of the documents dealt to a block, and the windows at their boundaries."""

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        index, own = Laid(pdf[pdf.reference]), Laid(pdf[~pdf.reference])
        order = np.argsort(index.core, kind="stable")
        if not len(own.at):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("rid", "doc_id", "a", "b", "hash")})
        to = order[np.searchsorted(index.core[order], own.core)]
        left, right = _extended(own, index, to, window - gram, window)
        # the windows of an anchor that lie within its match
        low, high = np.maximum(own.first, own.at - left), np.minimum(own.first + own.n - 1, own.at + right - window)
        matched = low <= high
        keep = np.flatnonzero(matched & (index.doc[to] < own.doc))
        by = keep[np.lexsort((low[keep], own.at[keep] - index.at[to[keep]], index.rid[to[keep]], own.rid[keep]))]
        rid, doc, a, b, ref, diagonal = own.rid[by], own.doc[by], low[by], high[by] + window, index.rid[to[by]], own.at[by] - index.at[to[by]]
        new = np.ones(len(by), bool)
        new[1:] = (rid[1:] != rid[:-1]) | (ref[1:] != ref[:-1]) | (diagonal[1:] != diagonal[:-1]) | (a[1:] > b[:-1])
        starts = np.flatnonzero(new)
        factors = pd.DataFrame({"rid": rid[starts], "doc_id": doc[starts], "a": a[starts], "b": b[np.append(starts[1:], len(by)) - 1] if len(by) else b, "hash": None})

        number = np.repeat(np.arange(len(own.at)), own.n)
        place = own.first[number] + np.arange(len(number)) - np.repeat(np.cumsum(own.n) - own.n, own.n)
        open_ = ~(matched[number] & (place >= low[number]) & (place <= high[number]))
        number, place = number[open_], place[open_]
        hashes = Rolling(own.words, BASES[1]).of(place + own.shift[number], window).view(np.int64)
        asked = pd.DataFrame({"rid": own.rid[number], "doc_id": own.doc[number], "a": place, "b": place + window, "hash": hashes})
        factors["hash"] = factors["hash"].astype("Int64")
        asked["hash"] = asked["hash"].astype("Int64")
        return pd.concat([factors, asked], ignore_index=True)

    return parse


def _cut():
    """Drop the words that a document's spans cover."""

    def rows(batches):
        for batch in blocks_of(batches, BLOCK_BYTES):
            res = {k: [] for k in ("rid", "doc_id", "n_words", "n_removed", "kept")}
            for i, (rid, doc, text) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), byte_rows(batch.column("text")))):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int32)
                spans = batch.column("spans")[i].values
                if spans is not None:
                    np.add.at(gone, spans.field("a").to_numpy(), 1)
                    np.subtract.at(gone, spans.field("b").to_numpy(), 1)
                cut = np.cumsum(gone[:-1]) > 0
                removed = int(cut.sum())
                if removed:
                    words = [w for w, c in zip(words, cut.tolist()) if not c]
                for k, v in zip(res, (rid, doc, len(cut), removed, b" ".join(words))):
                    res[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(res[c], pa.int64()) for c in ("rid", "doc_id", "n_words", "n_removed")] + [pa.array(res["kept"], pa.binary()).cast(pa.string())], names=list(res))

    return rows


def _referred(anchors: DataFrame) -> DataFrame:
    """Anchors whose core is in two documents, with the block that indexes it, whether they are its reference, and how often it is dealt."""
    first = F.min(F.struct("doc_id", "rid", "at"))
    cores = saved(anchors.groupBy("core").agg(first.alias("o"), F.count("*").alias("times"), F.max("doc_id").alias("most")).filter("o.doc_id < most").select("core", F.col("o.rid").alias("owner"), F.col("o.at").alias("owner_at"), "times"))
    total = cores.agg(F.sum("times")).first()[0] or 0
    blocks = max(1, -(-total // PARSED))
    # a power of two, so that most cores of a passage deal a document alike
    deals = F.greatest(F.lit(1), F.pow(F.lit(2), F.ceil(F.log2(F.sum("times") / PARSED)))).cast("int")
    loads = cores.groupBy("owner").agg(deals.alias("deals"))
    # written, so that both sides of the join on a hot core can be split
    cores = saved(cores.join(loads, "owner").withColumn("block", F.pmod(F.xxhash64("owner"), F.lit(blocks)).cast("int")).drop("times"))
    return anchors.join(cores, "core").select("rid", "core", "at", "first", "n", "block", "deals", ((F.col("rid") == F.col("owner")) & (F.col("at") == F.col("owner_at"))).alias("owned"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: rid, doc_id, n_words, n_removed, kept (the words left, joined by a space)."""
    spark, rows = docs.sparkSession, with_row_ids(docs)
    taking = saved(_referred(saved(rows.mapInArrow(_anchor_rows(window, gram), ANCHORS))))
    release(spark)
    listed = taking.groupBy("rid").agg(F.collect_list(F.struct("block", "deals", "owned", "core", "at", "first", "n")).alias("found"))
    stretches = saved(rows.join(listed, "rid").select("rid", "doc_id", "text", "found").mapInArrow(_stretch_rows(window), STRETCHES))
    release(spark)
    factors = saved(stretches.groupBy("block", "deal").applyInPandas(_parse(window, gram), FACTORS))
    asked = factors.filter("hash is not null")
    # both sides written, so that a hot window can be split
    least = saved(asked.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("hash", "least"))
    again = asked.join(least, "hash").filter("least < doc_id")
    spans = factors.filter("hash is null").select("rid", "a", "b").unionByName(again.select("rid", "a", "b"))
    spans = saved(spans.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    release(spark)
    return rows.join(spans, "rid", "left").select("rid", "doc_id", "text", "spans").mapInArrow(_cut(), RUNS)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same rows by definition, for tests."""
    least: dict[tuple, int] = {}
    split = {d: (t or "").encode().split() for d, t in docs}
    for d, w in split.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, d), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = len(w), len(gone), hashlib.sha256(kept).hexdigest()
    return out
