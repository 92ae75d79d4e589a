"""Token counts of flat token files without an index, by a scan for the end-of-document identifier.

A token file is nothing but unsigned 16-bit little-endian ids, each document followed by the identifier. Files are cut into
byte blocks that know nothing of documents. A task searches its block with one vectorised comparison and returns the places
it found; a prefix scan over the blocks of a file (running count of documents, last place found before) stitches documents
that cross blocks, and the counts follow as differences.

Empty files have no documents; tokens after the last identifier of a file are an unended document, which is returned with
ended false. Null and empty texts are documents of no tokens. Repeated rows each are a document; null doc_ids stay null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumisift.llm.common import saved, shared_dir, table
from lumisift.llm.tokens import Encoder, default_vocabulary

#: The vocabulary's end-of-text id, which no text encodes to.
END = 50256
BLOCK_BYTES = 4 << 20
WIDTH = 2


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """A flat file a task, and the written table (file, bytes, ordinal, doc_id) of what was written in which order.

    A file is named by task and attempt and appears under its name when whole; the table only lists files of tasks that ended.
    """
    vocabulary = vocabulary or default_vocabulary()

    def rows(batches):
        task = TaskContext.get()
        fs, top = _filesystem(folder)
        fs.create_dir(top)
        path = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}.u16"
        encoder, ordinal, ids = Encoder.of(vocabulary), 0, []
        out = fs.open_output_stream(path)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                out.write(np.append(encoder.ids(text or ""), END).astype("<u2").tobytes())
            ids.append((batch.column("doc_id"), ordinal))
            ordinal += batch.num_rows
        out.close()
        size = fs.get_file_info(path).size
        for doc_ids, first in ids:
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, size, np.int64)), pa.array(np.arange(first, first + n)), doc_ids], names=["file", "bytes", "ordinal", "doc_id"])

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "file string, bytes long, ordinal long, doc_id long"))


def _search(folder: str, end: int):
    def rows(batches):
        fs, _ = _filesystem(folder)
        for batch in batches:
            for path, first, size in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "size"))):
                with fs.open_input_file(path) as f:
                    tokens = np.frombuffer(f.read_at(size, first), "<u2")
                found = np.flatnonzero(tokens == end) + first // WIDTH
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first // WIDTH]), pa.array([len(tokens)], pa.int64()), pa.array([found], pa.list_(pa.int64()))], names=["file", "first", "tokens", "ends"])

    return rows


def count_tokens(spark: SparkSession, files: DataFrame, folder: str, end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """files (file, bytes) -> a row per document: file, ordinal, start (tokens before it in the file), n_tokens, ended."""
    step = block_bytes - block_bytes % WIDTH
    blocks = files.filter("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("first"), "bytes")
    blocks = blocks.select("file", "first", F.least(F.lit(step).cast("long"), F.col("bytes") - F.col("first")).alias("size"))
    found = saved(blocks.repartition(F.col("file"), F.col("first")).mapInArrow(_search(folder, end), "file string, first long, tokens long, ends array<long>"))
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "first", F.size("ends").cast("long").alias("n"), F.get("ends", F.size("ends") - 1).alias("last"), (F.col("first") + F.col("tokens")).alias("to"))
    carried = summary.select("file", "first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("done"), F.coalesce(F.max("last").over(before), F.lit(-1).cast("long")).alias("carry"))
    docs = (
        found.join(carried, ["file", "first"])
        .select("file", "done", "carry", "ends", F.posexplode("ends").alias("i", "at"))
        .withColumn("start", F.coalesce(F.get("ends", F.col("i") - 1), F.col("carry")) + 1)
        .select("file", (F.col("done") + F.col("i")).alias("ordinal"), "start", (F.col("at") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    )
    rest = summary.groupBy("file").agg(F.sum("n").alias("ordinal"), F.coalesce(F.max("last") + 1, F.lit(0).cast("long")).alias("start"), F.max("to").alias("to")).filter("to > start")
    return docs.unionByName(rest.select("file", "ordinal", "start", (F.col("to") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and the shard and place of its tokens."""
    folder = shared_dir(spark)
    written = write_token_files(table(spark, sf_dir, "documents"), folder)
    counts = count_tokens(spark, written.select("file", "bytes").distinct(), folder)
    return counts.join(written.select("file", "ordinal", "doc_id"), ["file", "ordinal"]).select("doc_id", "n_tokens", F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("shard"), "ordinal", "start")
