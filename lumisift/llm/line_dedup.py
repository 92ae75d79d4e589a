"""Line dedup: lines that many documents hold stay in one of them.

Lines are exploded with their places, normalised (white space at both ends cut, A-Z lowered) and hashed; distinct documents are counted
by hash, after each task and each (hash, document) has been reduced to one row; lines over the threshold go everywhere but in
the document with the largest doc_id, and what is left of a text is put together by position. Built-in functions throughout.

A line may be in a third of all documents. Hashes that make up more than 1 / HOT of all rows to be dropped are at most HOT by
arithmetic, so they are broadcast; of all others no one has more than that share of a join.

Null and empty texts are one empty line, which no threshold reaches. Rows that share a doc_id are one document when documents are counted, but
each row has its result. A null doc_id comes before all others. No rows give none. Further columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import saved, table, with_row_ids
from lumisift.llm.quality_rules import let

#: Code points of a line that counts, documents that must hold it, and hashes that are broadcast.
LEAST_LENGTH, LEAST_DOCUMENTS, HOT = 20, 3, 1 << 16
#: ASCII white space.
BLANKS = " \t\n\v\f\r"
KEY = ["high", "low"]


def key_of(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case and nothing else."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(rows: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(rid, doc_id, place, high, low): the lines that count, with 128 bits of their keys."""
    lines = rows.select("rid", "doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("key", key_of(F.col("line")))
    return lines.filter(F.length("key") >= least_length).select("rid", "doc_id", "place", F.xxhash64(F.lit(1), "key").alias("high"), F.xxhash64("key").alias("low"))


def repeated_lines(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(high, low, documents, keeper): hashes in at least so many documents, and the largest doc_id with each."""
    counted = lines.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count("*").alias("documents"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("documents") >= least_documents)


def remove_repeated_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_lines, n_dropped and kept: the text without the lines that went."""
    rows = with_row_ids(docs)
    lines = lines_of(rows, least_length)
    repeated = saved(repeated_lines(lines, least_documents))
    total = repeated.agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
    elsewhere = (F.col("doc_id") != F.col("keeper")) | F.col("doc_id").isNull()
    often, seldom = repeated.filter(F.col("documents") * hot > total), repeated.filter(F.col("documents") * hot <= total)
    gone = lines.join(F.broadcast(often), KEY)  # fewer than `hot` rows: they share `total`
    if not seldom.isEmpty():
        gone = gone.unionByName(lines.join(seldom, KEY))
    dropped = gone.filter(elsewhere).groupBy("rid").agg(F.collect_list("place").alias("dropped"))

    def left(parts: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.coalesce("dropped", F.array().cast("array<int>")))
        kept = F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")
        return F.struct(F.size(parts).cast("long").alias("n_lines"), (F.size(parts) - F.size(places)).cast("long").alias("n_dropped"), kept.alias("kept"))

    return rows.join(dropped, "rid", "left").select("doc_id", let(F.split("text", "\n"), left).alias("x")).select("doc_id", "x.*")


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
