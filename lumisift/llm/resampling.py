"""Importance resampling towards a target distribution, by hashed word n-grams.

A byte automaton reads Arrow's UTF-8 buffers as they are: a lookup table lowers and classifies all bytes at once, differences of the
classes give the words' borders, and the CRCs of all words advance together, one byte a step, from table to table. A bigram's CRC goes
on from its first word's, so no feature is ever put together as text.

Tasks send one row a bucket (BUCKETS at most), whatever they read; the gains by bucket come back as one broadcast of BUCKETS numbers,
and a second pass over the texts sums them by document. The draw is by rank of (doc_id, score) rows, dealt by range.

Null and empty texts, and texts without words, have no features: weight 0, not eligible. Rows count, also those that share a doc_id;
equal rows are drawn in either order. A null doc_id hashes as an empty one and comes after all others among ties. An empty target has
no features, which is a distribution too. No rows give none. Further columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import blocks_of, saved, table
from lumisift.llm.placing import placed

BUCKETS, LONGEST = 10_000, 2
#: Words of an eligible document, percent of those that are drawn, and the seed of the draw.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes that a task reads at once, and bytes of a word that the automaton takes; what few words have beyond them follows word by word.
BLOCK_BYTES, STEPS = 8_000_000, 48


def _crc_table() -> np.ndarray:
    """What a byte makes of the low byte of a CRC-32 register (reflected polynomial EDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Each byte lowered if A-Z, and whether it is of a word: digits, letters and whatever isn't ASCII."""
    b = np.arange(256)
    lower = np.where((b >= ord("A")) & (b <= ord("Z")), b + 32, b).astype(np.uint8)
    of_word = ((lower >= ord("0")) & (lower <= ord("9"))) | ((lower >= ord("a")) & (lower <= ord("z"))) | (lower >= 128)
    return lower, of_word


TABLE, (LOWER, OF_WORD) = _crc_table(), _byte_classes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array's texts and where each begins, and the end, without a copy; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[ends[0] : ends[-1]], ends - ends[0]


def word_borders(of_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end: where the class changes, and where a text begins."""
    n = len(of_word)
    inner = offsets[(offsets > 0) & (offsets < n)]
    first = np.zeros(n + 1, bool)
    first[0] = first[n] = True
    first[inner] = True
    padded = np.zeros(n + 2, bool)
    padded[1:-1] = of_word
    before, here = padded[:-1], padded[1:]
    return np.flatnonzero(here & (~before | first)), np.flatnonzero(before & (~here | first))


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of their stretches, all stretches one byte a step; the longest come first, so those still going are a prefix."""
    order = np.argsort(-length, kind="stable")
    size, at = length[order], start[order]
    now = state[order]
    going = np.searchsorted(-size, -np.arange(1, min(STEPS, int(size[0]) if len(size) else 0) + 1), side="right")
    for t, n in enumerate(going):
        part = now[:n]
        now[:n] = TABLE[(part ^ data[at[:n] + t]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    for i in range(int(np.searchsorted(-size, -STEPS, side="left"))):  # those longer than STEPS
        rest = data[at[i] + STEPS : at[i] + size[i]].tobytes()
        now[i] = zlib.crc32(rest, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def features(column: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of texts: each one's number of words, and all features' text numbers and buckets."""
    raw, offsets = text_bytes(column)
    data = LOWER[raw]
    start, end = word_borders(OF_WORD[raw], offsets)
    text = np.searchsorted(offsets, start, side="right") - 1
    words = np.bincount(text, minlength=len(column))
    length = end - start
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    texts, found = [], []
    for k in range(longest):
        if k:  # go on over a blank and the next word of the same text
            here = np.flatnonzero(text[k:] == text[: len(text) - k]) if len(text) > k else np.zeros(0, np.int64)
            blank = TABLE[(state ^ np.uint32(32)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
            more = np.zeros(len(start), np.uint32)
            more[here] = advance(blank[here], data, start[here + k], length[here + k])
            state = more
        else:
            here = np.arange(len(start))
            state = advance(state, data, start, length)
        texts.append(text[here])
        found.append((state[here] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
    return words, np.concatenate(texts), np.concatenate(found).astype(np.int64)


def _counted(longest: int, buckets: int):
    def rows(batches):
        total = np.zeros(buckets, np.int64)
        for batch in blocks_of(batches, BLOCK_BYTES):
            total += np.bincount(features(batch.column("text"), longest, buckets)[2], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    return rows


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of docs (text); buckets without any are absent."""
    return docs.select("text").mapInArrow(_counted(longest, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain, in thousandths, from the counts (bucket, n) of what is drawn from and of the target; both counts have one added."""
    spark = raw.sparkSession
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = both.unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    counts = saved(every.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    number = lambda x: x.cast("double")
    ratio = number(F.col("t") + 1) * F.lit(float(total.s + buckets)) / (number(F.col("s") + 1) * F.lit(float(total.t + buckets)))
    gains = counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()  # a row a bucket
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in gains]] = [r.gain for r in gains]
    return out


def _weighed(gains: Broadcast, longest: int, buckets: int):
    def rows(batches):
        for batch in blocks_of(batches, BLOCK_BYTES):
            words, texts, found = features(batch.column("text"), longest, buckets)
            n = np.bincount(texts, minlength=batch.num_rows)
            # exact: integers are summed as such
            sums = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, texts, gains.value[found])
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return rows


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A document's draw from the Gumbel distribution, in thousandths, from its doc_id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_words, n_features and weight: the mean gain of its features, rounded down."""
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets)
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # a number a bucket
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_weighed(shared, longest, buckets), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of docs with weight, score and rank: a draw of percent of the eligible rows without replacement, by Gumbel scores; rank is null for the rest."""
    scored = saved(weights(docs, target).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    eligible = F.col("n_words") >= least_words
    drawn = percent * scored.filter(eligible).count() // 100
    ranked = placed(scored.withColumn("list", F.when(eligible, 0).otherwise(1)), "list", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    rank = F.when((F.col("list") == 0) & (F.col("place") < drawn), F.col("place") + 1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), d AS (
  SELECT doc_id, 1 AS raw, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT NULL, 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), x AS (
  SELECT doc_id, raw, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d
), n AS (SELECT doc_id, raw, f, count(*) AS n FROM x GROUP BY ALL
), hashed AS (
  SELECT f, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])) AS register FROM (SELECT DISTINCT f FROM n), crc
), b AS (SELECT doc_id, raw, xor(register, 4294967295) % 10000 AS bucket, sum(n) AS n FROM n JOIN hashed USING (f) GROUP BY ALL
), c AS (SELECT bucket, coalesce(sum(n) FILTER (raw = 1), 0) AS s, coalesce(sum(n) FILTER (raw = 0), 0) AS t FROM b GROUP BY bucket
), totals AS (SELECT sum(s) AS s, sum(t) AS t FROM c
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((c.t + 1)::DOUBLE * (totals.s + 10000)::DOUBLE / ((c.s + 1)::DOUBLE * (totals.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM c, totals
), w AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM b JOIN gains USING (bucket) WHERE raw = 1 GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || d.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (doc_id) WHERE raw = 1
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM ranked) // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
