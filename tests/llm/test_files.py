"""WARC, token files and packing."""

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.llm import packing, token_counts, warc
from lumisift.llm.common import shared_dir
from lumisift.llm.tokens import Encoder, default_vocabulary


@pytest.fixture
def pages(spark):
    big = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 60
    html = [big, big, "small", "small", None, "", big + "x", big, "\r\n\r\n", "x" * 1000, "x" * 1000, "x" * 999, "x" * 999]
    rows = [(i * 7 % 13, f"http://h/{i}\r\nx", h, "extra") for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def test_warc_round_trip(spark, pages):
    path = shared_dir(spark)
    warc.write_warc(warc.with_revisits(pages), path)
    rows = {r.page_id: r.html or "" for r in pages.collect()}
    newest = defaultdict(int)
    for p, h in rows.items():
        newest[h] = max(newest[h], p)
    got = {int(r.page_id): r for r in warc.read_warc(spark, path).collect()}
    assert got.keys() == rows.keys()
    for p, h in rows.items():
        again = len(h.encode()) >= 1000 and newest[h] != p
        assert got[p].record_type == ("revisit" if again else "response")
        assert got[p].payload_digest == "sha1:" + hashlib.sha1(h.encode()).hexdigest()
        assert (got[p].payload is None) if again else (got[p].payload.decode() == h)
        assert got[p].refers_to == (f"<urn:page:{newest[h]}>" if again else None)


def test_warc_filters_and_columns(spark, pages):
    path = shared_dir(spark)
    warc.write_warc(warc.with_revisits(pages), path)
    only = warc.read_warc(spark, path, ["page_id"], ["revisit"])
    assert only.count() == 3 and only.columns == ["page_id"]
    reader = warc.WarcReader([], ["record_type", "page_id"])
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("content_length",), 5)]))
    assert len(rest) == 1 and reader.wanted.allowed == {"record_type": {"revisit"}} and not reader.wanted.payload


def test_warc_reads_what_only_spark_can_open(spark, pages, monkeypatch):
    path = shared_dir(spark)
    warc.write_warc(warc.with_revisits(pages), path)
    want = sorted(map(tuple, warc.read_warc(spark, path, ["page_id", "payload"], ["response"]).collect()))
    monkeypatch.setattr(warc, "_listed", lambda p: None)
    assert sorted(map(tuple, warc.read_warc(spark, path, ["page_id", "payload"], ["response"]).collect())) == want


@pytest.mark.parametrize("only_spark", [False, True])
def test_warc_of_gzip_members(spark, pages, tmp_path, monkeypatch, only_spark):
    import gzip

    path = shared_dir(spark)
    warc.write_warc(warc.with_revisits(pages), path)
    want = sorted(map(tuple, warc.read_warc(spark, path, ["page_id", "record_type", "payload"]).collect()), key=str)
    packed = shared_dir(spark)
    warc.write_warc(warc.with_revisits(pages), packed, "gzip")
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted(Path(packed.removeprefix("file:")).glob("*.gz")))
    starts = [m.start() for m in re.finditer(rb"WARC/1\.1\r\nWARC-Type", whole)]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(whole[a:b]) for a, b in zip(starts, [*starts[1:], len(whole)])))
    if only_spark:
        monkeypatch.setattr(warc, "_listed", lambda p: None)
    for place in (packed, str(tmp_path)):
        got = warc.read_warc(spark, place, ["page_id", "record_type", "payload"])
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert warc.read_warc(spark, place, ["page_id"], ["revisit"]).count() == 3


def test_warc_with_odd_headers(spark, tmp_path):
    record = lambda length, body: b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: " + length + b"\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "odd.warc").write_bytes(b"\r\n" + record(b"3", b"abc") + record(b"many", b"lost\r\n\r\n") + b"WARC/1.0\nWARC-Type: warcinfo\n\n" + record(b"2", b"de") + record(b"100", b"cut"))
    got = [(r.record_type, r.content_length, r.payload and bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert got == [("response", 3, b"abc"), ("response", None, None), ("warcinfo", None, None), ("response", 2, b"de"), ("response", 100, b"cut\r\n\r\n")]


def test_warc_of_nothing(spark, pages):
    path = shared_dir(spark)
    warc.write_warc(warc.with_revisits(pages.limit(0)), path)
    assert warc.read_warc(spark, path).count() == 0


@pytest.mark.parametrize("block", [10, 64, 1 << 20])
def test_token_counts(spark, documents, corpus, block):
    folder = shared_dir(spark)
    written = token_counts.write_token_files(documents, folder)
    counts = token_counts.count_tokens(spark, written.select("file", "bytes").distinct(), folder, block_bytes=block)
    got = {r.doc_id: r.n_tokens for r in counts.join(written, ["file", "ordinal"]).collect()}
    encoder = Encoder.of(default_vocabulary())
    assert got == {d: len(encoder.ids(t or "")) for d, t in corpus}
    assert counts.filter("not ended").count() == 0


def test_token_file_without_a_last_end(spark, tmp_path):
    path = tmp_path / "a.u16"
    np.array([5, token_counts.END, token_counts.END, 7, 8], "<u2").tofile(path)
    files = spark.createDataFrame([(str(path), 10), (str(tmp_path / "none"), 0)], "file string, bytes long")
    got = sorted(map(tuple, token_counts.count_tokens(spark, files, str(tmp_path), block_bytes=4).select("ordinal", "start", "n_tokens", "ended").collect()))
    assert got == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 2, False)]


def check_packing(rows, texts):
    encoder, pieces, bins = Encoder.of(default_vocabulary()), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for d, t in texts.items():
        ids, own = np.append(encoder.ids(t or "", special=True), 2).astype("<u4"), sorted(pieces[d], key=lambda r: r.piece)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) <= 1024
    return len(bins)


def test_packing_round_trip(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 40)
    out = packing.pack_documents(documents)
    rows = out.collect()
    n = check_packing(rows, dict(corpus))
    sizes = [r.length for r in rows]
    assert n <= 1.1 * -(-sum(sizes) // 1024) + 3


def test_special_token_name_is_one_token(spark):
    rows = packing.pieces_of(spark.createDataFrame([(1, "a<|endoftext|>"), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == [(1, 3), (2, 1)]


def test_genetic_packing_is_no_worse_than_best_fit():
    rng = np.random.default_rng(4)
    sizes = rng.integers(200, 700, 400).tolist()
    plain = packing.Grouping([], sizes)
    packing.best_fit(plain.bins, plain.room, range(len(sizes)), sizes)
    best = packing.evolve(sizes, None, [], 1)
    assert sorted(p for b in best.bins for p in b) == list(range(len(sizes)))
    assert len(best.bins) <= len(plain.bins)


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty).count() == 0
