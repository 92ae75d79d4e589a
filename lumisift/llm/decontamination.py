"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by documents: each block of whole documents has a row per term with its postings, which are the
term's places in the block's words laid end to end (with a gap between documents, so that no phrase crosses one). A query
window is looked up from its globally rarest term; the other terms' postings, adjusted by their offsets, are intersected
with what is left, and with a slop they need only be near. The plan of all look-ups is a table too: a window's row joins the
index by its rarest term, which gives the blocks it must go to, and meets the postings there.

Null and empty texts have no words, n_words 0, and are not contaminated. Null items, and items without words, match nothing.
Repeated rows each have their own result; rows of the benchmark that share an item_id count as one item.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import blocks_of, byte_rows, saved, table

WINDOW = 13
#: Bytes of text in a block of the index.
BLOCK_BYTES = 4_000_000
#: Windows of test items whose look-ups may meet in one block at once, about: beyond it they are dealt, each deal with the block's postings.
AT_ONCE = 200_000

#: A-Z in lower case; ASCII but letters and digits becomes a space; bytes of other characters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX_SCHEMA = "block long, term binary, n long, postings binary, doc_ids array<long>, doc_words array<int>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _indexed(batches):
    blocks = itertools.count(TaskContext.get().partitionId() << 32)
    for batch in blocks_of(batches, BLOCK_BYTES):
        ids: dict[bytes, int] = {}
        places, terms, lengths, base = [], [], [], 0
        for text in byte_rows(batch.column("text")):
            words = words_of(text)
            terms.extend(ids.setdefault(w, len(ids)) for w in words)
            places.append(np.arange(base, base + len(words), dtype=np.int32))
            lengths.append(len(words))
            base += len(words) + 1
        terms = np.array(terms, np.int32)
        counts = np.bincount(terms, minlength=len(ids))
        postings = np.concatenate(places)[np.argsort(terms, kind="stable")] if places else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], 4 * np.cumsum(counts)]).astype(np.int32)
        block = next(blocks)
        rows = len(ids) + 1
        none = pa.nulls(rows - 1, pa.list_(pa.int64())), pa.nulls(rows - 1, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(rows, block, np.int64)),
                pa.array([None, *ids], pa.binary()),
                pa.array(np.concatenate([[0], counts]).astype(np.int64)),
                pa.concat_arrays([pa.array([None], pa.binary()), pa.Array.from_buffers(pa.binary(), rows - 1, [None, pa.py_buffer(offsets), pa.py_buffer(postings)])]),
                pa.concat_arrays([pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), none[0]]),
                pa.concat_arrays([pa.array([lengths], pa.list_(pa.int32())), none[1]]),
            ],
            names=["block", "term", "n", "postings", "doc_ids", "doc_words"],
        )


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index: for each block a row per term, and one (term null) with the block's documents and their lengths."""
    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_indexed, INDEX_SCHEMA))


def _item_words(batches):
    for batch in batches:
        res = {k: [] for k in ("row", "item_id", "size", "place", "term")}
        for row, item, text in zip(batch.column("row").to_pylist(), batch.column("item_id").to_pylist(), byte_rows(batch.column("text"))):
            words = words_of(text)
            for place, word in enumerate(words):
                for k, v in zip(res, (row, item, len(words), place, word)):
                    res[k].append(v)
        kinds = pa.int64(), batch.schema.field("item_id").type, pa.int32(), pa.int32(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(res[k], t) for k, t in zip(res, kinds)], names=list(res))


def _windows(window: int):
    """An item's windows whose terms all occur: (term, item_id, length, places, terms), the rarest term first, that one by itself too."""

    def rows(batches):
        for batch in batches:
            res = {k: [] for k in ("term", "item_id", "length", "places", "terms")}
            for item, size, words in zip(batch.column("item_id").to_pylist(), batch.column("size").to_pylist(), batch.column("words").to_pylist()):
                known, seen = {w["place"]: (w["n"], w["term"]) for w in words}, set()
                for start in range(max(1, size - window + 1)):
                    length = min(window, size)
                    phrase = [known.get(start + k) for k in range(length)]
                    if None in phrase or (whole := tuple(t for _, t in phrase)) in seen:
                        continue
                    seen.add(whole)
                    order = sorted(range(length), key=lambda k: (phrase[k][0], k))
                    for k, v in zip(res, (whole[order[0]], item, length, order, [whole[k] for k in order])):
                        res[k].append(v)
            kinds = pa.binary(), batch.schema.field("item_id").type, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(res[k], t) for k, t in zip(res, kinds)], names=list(res))

    return rows


def plan_lookups(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(term, item_id, length, places, terms): each window of an item by its rarest term, with all its terms and their places in it."""
    key = dict(items.dtypes)["item_id"]
    texts = saved(items.filter("text is not null").select("item_id", "text").withColumn("row", F.monotonically_increasing_id()))
    words = texts.mapInArrow(_item_words, f"row long, item_id {key}, size int, place int, term binary")
    counts = index.filter("term is not null").join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    counted = words.join(counts, "term").groupBy("row", "item_id", "size").agg(F.collect_list(F.struct("place", "term", "n")).alias("words"))
    return saved(counted.mapInArrow(_windows(window), f"term binary, item_id {key}, length int, places array<int>, terms array<binary>"))


def _near(found: np.ndarray, postings: np.ndarray, offset: int, slop: int) -> np.ndarray:
    """Those starts that have a posting at most slop places from their offset."""
    at = np.searchsorted(postings, found + (offset - slop))
    return found[(at < len(postings)) & (postings[np.minimum(at, len(postings) - 1)] <= found + (offset + slop))]


def _matcher(window: int, slop: int):
    def match(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        res = {k: [] for k in ("ordinal", "item_id", "first", "last")}
        if len(asks) and len(rows):
            lengths = np.asarray(next(iter(rows.doc_words[rows.term.isna()])), np.int64)
            starts = np.cumsum(lengths + 1) - (lengths + 1)
            # documents lie one place apart in the index; so far apart here that no match spans two
            apart = np.arange(len(lengths)) * (window + 2 * slop)
            terms = rows[rows.term.notna()]
            postings = {}
            for t, p in zip(terms.term, terms.postings):
                p = np.frombuffer(p, np.int32).astype(np.int64)
                postings[bytes(t)] = p + apart[np.searchsorted(starts, p, side="right") - 1] if slop else p
            if slop:
                starts = starts + apart
            out = defaultdict(list)
            for item, length, places, terms in zip(asks.item_id, asks.length, asks.places, asks.terms):
                order = list(zip(places.tolist(), terms))
                found = postings[order[0][1]] - order[0][0]
                for offset, term in order[1:]:
                    if not len(found) or term not in postings:
                        found = found[:0]
                        break
                    found = _near(found, postings[term], offset, slop)
                if len(found):
                    docs = np.searchsorted(starts, found + order[0][0], side="right") - 1
                    out[item].extend((d, p - int(starts[d]), length) for d, p in zip(docs.tolist(), found.tolist()))
            for item, hits in out.items():
                merged = []  # of one item in this block, as [document, first, last) with places in it
                for doc, p, length in sorted(hits):
                    first, last = max(0, p - slop), min(int(lengths[doc]), p + length + slop)
                    if merged and merged[-1][0] == doc and first <= merged[-1][2]:
                        merged[-1][2] = max(merged[-1][2], last)
                    else:
                        merged.append([doc, first, last])
                for doc, first, last in merged:
                    for k, v in zip(res, (doc, item, first, last)):
                        res[k].append(v)
        return pd.DataFrame({"block": pd.Series([key[0]] * len(res["item_id"]), dtype="int64")} | {k: pd.Series(v, dtype=object if k == "item_id" else "int32") for k, v in res.items()})

    return match


def find_phrases(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(block, ordinal, item_id, first, last): the runs of document words inside windows of an item.

    slop 0 asks for exact phrases; else each term may be so many places off (a proximity match).
    """
    plan = plan_lookups(index, items, window)
    deals = max(1, -(-plan.count() // AT_ONCE))
    plan = plan.withColumn("deal", F.pmod(F.xxhash64("item_id", "terms"), F.lit(deals)).cast("int"))
    used = saved(plan.select(F.explode("terms").alias("term")).distinct())
    terms = index.filter("term is not null")
    asks = saved(terms.select("term", "block").join(plan, "term").select("block", "deal", "item_id", "length", "places", "terms"))
    rows = terms.join(used, "term", "left_semi").unionByName(index.filter("term is null")).select("block", "term", "postings", "doc_words")
    rows = rows.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    schema = f"block long, ordinal int, item_id {dict(items.dtypes)['item_id']}, first int, last int"
    return rows.groupBy("block", "deal").cogroup(asks.groupBy("block", "deal")).applyInPandas(_matcher(window, slop), schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, index: DataFrame | None = None) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, item_ids (sorted as strings), contaminated (a twentieth of its words hit)."""
    index = build_index(docs) if index is None else index
    hits = find_phrases(index, items, window, slop)
    by_doc = hits.groupBy("block", "ordinal").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    sweep = F.aggregate("spans", nothing, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], a["end"]))).alias("n"), F.greatest(a["end"], x["last"]).alias("end")), lambda a: a["n"].cast("long"))
    rows = index.filter("term is null").select("block", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("ordinal", "d"))
    out = rows.join(by_doc, ["block", "ordinal"], "left").select(
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.doc_words").cast("long").alias("n_words"),
        F.coalesce(sweep, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), qw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, w[i + 1 : i + least(len(w), 13)] AS g FROM q, unnest(range(0, greatest(1, len(w) - 12))) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM qw), dw AS (
  SELECT doc_id, i, n, w[i + 1 : i + n] AS g FROM d, sizes, unnest(range(0, len(w) - n + 1)) AS r(i) WHERE len(w) >= n
), hit AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN qw ON dw.n = qw.n AND dw.g = qw.g
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS x(k) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
