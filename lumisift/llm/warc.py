"""WARC archives: written as text rows by Spark, read back by a Python data source.

The writer forms whole records as strings, so Spark's committer makes the files on any file system and a lost task leaves no
half record. The source plans a partition for some files of about equal bytes, takes filters on the record type and on other
named headers, parses headers first, and seeks past the payload of a record that is filtered out or whose payload column
isn't read. It opens any file system that Arrow knows (local, HDFS, S3, GCS), and gzip archives by their name (`.gz`), where what is
skipped is unpacked but not kept. A store that only Spark can read goes through binaryFile rows to the same parser: whole archives
of at most 2 GB, no seeking.

Null html is an empty payload. Pages with equal payloads shorter than the bound are all responses. Repeated page rows are
written and read back each; with equal page_ids one of them is the response's id for all. A null page_id is written and read
back as null, and is a response only to itself. A record whose Content-Length is missing or no number has null for it and for
its payload, and reading goes on at the next line that begins a record.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from lumisift.llm.common import saved, shared_dir, table

#: Payloads shorter than this are never made revisits.
LEAST_BYTES = 1000
#: Bytes of archives for a partition of the source.
PARTITION_BYTES = 32 << 20
#: Columns of the source and the headers that they come from.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "page_id": "x-page-id", "payload_length": "x-payload-length",
}
SCHEMA = ", ".join([*(f"{c} string" for c in HEADERS), "content_length long", "payload binary"])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*parts: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in parts])


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, and digest, payload_bytes and refers_to (the largest page_id of those with the same payload, or null)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    same = rows.filter(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    # written, so that Spark knows its size and can split the pages of a hot payload
    out = rows.join(saved(same), ["digest", "payload_bytes"], "left")
    return out.withColumn("refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first"))).drop("first")


def records(pages: DataFrame) -> DataFrame:
    """One string column: whole WARC records but for the blank lines between them."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("payload_bytes").cast("string"))), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = _lines(
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>"))),
        ("WARC-Date", F.lit("2020-01-01T00:00:00Z")),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%20")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", urn(F.col("refers_to"))),
        ("X-Page-ID", F.col("page_id").cast("string")),
        ("X-Payload-Length", F.col("payload_bytes").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    )
    return pages.withColumn("block", block).select(F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), F.col("block")).alias("value"))


def write_warc(pages: DataFrame, path: str, compression: str = "none") -> None:
    """Archives (records in Spark's part files, or with "gzip" in packed ones) of with_revisits() rows."""
    records(pages).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


class Wanted:
    """Which records and whether their payloads: column -> allowed values."""

    def __init__(self, columns: list[str], allowed: dict[str, set] | None = None):
        self.columns, self.allowed = columns, allowed or {}
        self.payload = "payload" in columns

    def read(self, f) -> Iterator[dict]:
        """Records of an open file."""
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = {}
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            row = {c: head.get(h) for c, h in HEADERS.items()}
            length = head.get("content-length", "")
            size = row["content_length"] = int(length) if length.isascii() and length.isdigit() else None
            if size is None:
                row["payload"] = None
                if all(row[c] in values for c, values in self.allowed.items()):
                    yield row
                continue
            if any(row[c] not in values for c, values in self.allowed.items()):
                f.seek(size, os.SEEK_CUR)
                continue
            row["payload"] = None
            if self.payload and row["record_type"] == "response":
                block = f.read(size)
                row["payload"] = block.partition(b"\r\n\r\n")[2] if "http" in head.get("content-type", "") else block
            else:
                f.seek(size, os.SEEK_CUR)
            yield row

    def batches(self, rows: Iterator[dict], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c == "content_length" else pa.string()) for c in self.columns])
        held, weight = [], 0
        for row in rows:
            held.append({c: row[c] for c in self.columns})
            weight += 500 + len(row["payload"] or b"")
            if weight >= size:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class WarcReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], columns: list[str]):
        """files: URIs and bytes."""
        self.files, self.wanted = files, Wanted(columns)

    def pushFilters(self, filters):
        """Equality and membership on header columns are decided here; the rest goes back to Spark."""
        for x in filters:
            name = x.attribute[0] if isinstance(x, (EqualTo, In)) and len(x.attribute) == 1 else None
            if name in HEADERS:
                values = set(x.value) if isinstance(x, In) else {x.value}
                self.wanted.allowed[name] = self.wanted.allowed.get(name, values) & values
            else:
                yield x

    def partitions(self):
        groups, room = [[]], PARTITION_BYTES
        for path, size in sorted(self.files):
            if groups[-1] and size > room:
                groups.append([])
                room = PARTITION_BYTES
            groups[-1].append(path)
            room -= size
        return [Files(g) for g in groups]

    def read(self, partition):
        for path in partition.value:
            fs, at = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as f:
                yield from self.wanted.batches(self.wanted.read(_unpacked(io.BufferedReader(f, 1 << 20), path)))


def _unpacked(f, path: str):
    """The archive's bytes; of many gzip members one after the other."""
    return gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f


class WarcSource(DataSource):
    """spark.read.format("warc").option("columns", "record_type,payload").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        columns = self._columns()
        return ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in columns)

    def _columns(self) -> list[str]:
        every = [x.split()[0] for x in SCHEMA.split(", ")]
        chosen = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return [c for c in every if not chosen or c in chosen]

    def reader(self, schema) -> WarcReader:
        return WarcReader(_listed(self.options["path"]), self._columns())


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))


def _listed(path: str) -> list[tuple[str, int]] | None:
    """URI and bytes of each archive at or below the path, or None for a store that Arrow doesn't open."""
    uri = _uri(path)
    with contextlib.suppress(pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        fs, top = pafs.FileSystem.from_uri(uri)
        found = fs.get_file_info(top)
        scheme = uri[: uri.index(top)] if top in uri else uri.partition("://")[0] + "://"
        if found.type == pafs.FileType.File:
            return [(scheme + top, found.size)]
        inside = fs.get_file_info(pafs.FileSelector(top, recursive=True))
        return [(scheme + f.path, f.size) for f in inside if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
    return None


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, record_types: list[str] | None = None) -> DataFrame:
    """Records of all archives below path; columns of HEADERS, content_length and payload."""
    columns = columns or [x.split()[0] for x in SCHEMA.split(", ")]
    if _listed(path) is None:
        wanted = Wanted([x.split()[0] for x in SCHEMA.split(", ") if x.split()[0] in columns], {"record_type": set(record_types)} if record_types else None)

        def rows(batches):
            for batch in batches:
                for at, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                    yield from wanted.batches(wanted.read(_unpacked(io.BytesIO(content.as_py()), at)))

        schema = ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in columns)
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, schema).select(*columns)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    needed = set(columns) | ({"record_type"} if record_types else set())
    out = spark.read.format("warc").option("columns", ",".join(needed)).load(path)
    if record_types:
        out = out.filter(F.col("record_type").isin(record_types))
    return out.select(*columns)


def op3_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(with_revisits(table(spark, sf_dir, "pages")), path)
    read = read_warc(spark, path, ["page_id", "record_type", "payload_digest", "refers_to", "payload_length", "payload"], ["response", "revisit"])
    response = F.col("record_type") == "response"
    return read.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length").cast("long")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        F.regexp_extract("refers_to", r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT h, n, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h, n)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
  CASE WHEN g.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN g.first <> page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h AND p.n = g.n
"""
