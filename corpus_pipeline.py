"""The corpus pipeline: documents through quality rules, near-dedup, suffix dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns documents again, the last one the pieces of packed sequences. Every stage
sees all that the one before kept; run() writes what a stage returns into the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm import decontamination, near_copies, packing, quality_rules, suffix_dedup
from lumisift.llm.common import saved, table, with_row_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words in a run that is cut where it repeats, and in the short strings that choose its anchors.
REPEATED, SHORT = 50, 6


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows are judged one by one, repeated ones too; null and empty texts have no words and go. Other nulls stay."""
    return quality_rules.apply_rules(docs.select(COLUMNS)).filter("__quality.kept").select(COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (four fifths of their 5-word shingles shared, or linked by such) one row: that with the least doc_id.

    Rows count, not their doc_ids: of repeated rows one stays, of different texts with one doc_id each that no other is like.
    A null doc_id comes after all others; a null text becomes an empty one.
    """
    rows = with_row_ids(docs, ("lang", "source", "n_chars"))
    groups = near_copies.near_copies(rows)
    first = rows.select("rid", "doc_id").join(groups, F.col("rid") == F.col("id")).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).rid.alias("rid"))
    return rows.join(first, "rid", "left_semi").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of any run of REPEATED that starts twice in the corpus. No document goes; a null text becomes an empty one."""
    cut = suffix_dedup.remove_repeats(docs, window=REPEATED, gram=SHORT, keep=("lang", "source"), as_text=True, words=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a twentieth of their words in passages of test items.

    Rows count, not their doc_ids: of rows that share one each is judged alone. A null text is an empty one, and stays; items without words say nothing.
    """
    rows = with_row_ids(docs, ("lang", "source", "n_chars"))
    judged = decontamination.contamination(rows.select(F.col("rid").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(judged.filter("contaminated").select(F.col("doc_id").alias("rid")), "rid", "left_anti").select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place. Every row is a document, repeated ones too; null and empty texts are one end token."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_distinct),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express fingerprints, byte strings and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
