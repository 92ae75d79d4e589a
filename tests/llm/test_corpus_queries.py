"""The registered queries over whole tables: odd rows, and independent definitions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumisift.llm import queries

#: Names that operators use for columns of their own.
CLASHING = ("rid", "row", "id", "fp", "root", "block", "kept", "found", "spans", "train", "island", "deal", "term", "word", "__quality", "_let")
SHARDED = [q for q in queries.QUERIES if not q.startswith("op3_")]


def _tables(spark, folder, rows, labels=()):
    extra = {c: F.lit(c) for c in CLASHING}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns(extra).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").withColumns(extra).write.parquet(f"{folder}/labels.parquet")
    bench = [("b1", rows[0][1] and " ".join(rows[0][1].split()[:40])), ("b1", None), (None, ""), ("b2", "--")] if rows else []
    spark.createDataFrame(bench, "item_id string, text string").withColumns(extra).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, words, tmp_path_factory):
    """Repeated rows, rows that share a doc_id, nulls in every column, empty and very long texts, ties, and clashing columns."""
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, long = prose(150), prose(150), prose(150_000)
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, None), (3, None), (4, ""), (5, long), (6, long), (7, "x" * 300_000), (8, " \n\t "), (9, "<|endoftext|> a"), (None, None)]
    assert len(long.encode()) > 800_000
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 0), (2, 1, 0), (3, 0, 0), (5, 0, 0), (None, 1, None), (6, None, None), (99, 1, 0)]
    return _tables(spark, tmp_path_factory.mktemp("odd"), rows, labels), rows


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("nothing"), [])


@pytest.fixture(scope="module")
def results(spark, odd):
    return {name: queries.QUERIES[name](spark, odd[0]).collect() for name in SHARDED}


@pytest.mark.parametrize("name", SHARDED)
def test_every_row_has_its_result(name, results, odd):
    rows = odd[1]
    got = Counter(r.doc_id for r in results[name] if not name.startswith("op4") or r.piece == 0)
    assert got == Counter(d for d, _ in rows)
    # repeated rows have equal results but for where they are packed, and in op6 to op8 equal texts are scored alike
    if not name.startswith(("op4", "op9")):
        same = [tuple(r) for r in results[name] if r.doc_id is None]
        assert len(set(same)) <= 2


@pytest.mark.parametrize("name", SHARDED)
def test_no_rows_give_none(spark, name, nothing):
    assert queries.QUERIES[name](spark, nothing).count() == 0


def test_odd_fingerprints(results):
    def fingerprint(text):
        w = ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).encode().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))

    by = defaultdict(set)
    for r in results["op1_simhash_near_dedup"]:
        by[r.doc_id].add((r.fingerprint, r.component_id))
    assert by[3] == by[4] == by[8] == {("0" * 16, 3)} and len(by[1]) == 2 and {c for _, c in by[1]} == {1}
    assert by[7] == {(f"{fingerprint('x' * 300_000):016x}", 7)} and by[9] == {(f"{fingerprint('<|endoftext|> a'):016x}", 9)}
    assert by[5] == {(next(iter(by[5]))[0], 5)} and by[6] == {(next(iter(by[5]))[0], 5)}


def test_odd_repeats(results, odd):
    n = {d: len((t or "").encode()) for d, t in odd[1]}
    two = defaultdict(list)
    for r in results["op2_suffix_array_dedup"]:
        two[r.doc_id].append(r)
    assert {(r.n_removed, r.n_spans) for d in (5, 6, 7) for r in two[d]} == {(n[5], 1), (n[7], 1)} and two[4][0].n_removed == 0
    assert sorted(r.n_removed == r.n_bytes for r in two[1]) == [False, True, True]
    five = defaultdict(list)
    for r in results["op5_substring_dedup"]:
        five[r.doc_id].append(r.n_removed)
    assert sorted(five[1]) == [0, 0, 0] and five[2] == [150] and five[6] == [150_000] and five[5] == [0] and set(five[None]) == {0}


def test_odd_classifier(results):
    for r in results["op6_quality_classifier"]:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_odd_contamination(results):
    got = defaultdict(set)
    for r in results["op10_benchmark_decontamination"]:
        got[r.doc_id].add((r.n_words, r.n_hit, r.n_items, r.contaminated))
    assert got[2] == {(150, 40, 1, True)} and got[4] == {(0, 0, 0, False)} and got[None] == {(150, 40, 1, True), (0, 0, 0, False)}
    assert {x[2:] for x in got[1]} == {(1, True), (0, False)}
    assert {r.items_sha256 for r in results["op10_benchmark_decontamination"] if r.n_items} == {hashlib.sha256(b"b1").hexdigest()}


def test_packing_and_counts_by_the_tokenizer_file(spark, tmp_path, words):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice([*words, "don't", "1234", "\n\n", "日本語", "🙂", "  "]) for _ in range(rng.randint(0, 400)))) for i in range(60)] + [(100, None), (101, "a<|endoftext|>b")]
    folder = _tables(spark, tmp_path, rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in rows}
    pieces = defaultdict(list)
    for r in queries.QUERIES["op4_best_fit_packing"](spark, folder).collect():
        pieces[r.doc_id].append(r)
    for d, own in pieces.items():
        want = np.array([*ids[d], 2], "<u4")
        assert sum(r.length for r in own) == len(want)
        assert all(zlib.crc32(want[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert pieces.keys() == ids.keys()
    counted = {r.doc_id: r.n_tokens for r in queries.QUERIES["op9_token_counts"](spark, folder).collect()}
    plain = {d for d, t in rows if "<|" not in (t or "")}  # the special token's name is ordinary text in token files
    assert {d: counted[d] for d in plain} == {d: len(ids[d]) for d in plain} and counted.keys() == ids.keys()


def test_classifier_by_plain_compression(spark, tmp_path, words):
    import zstandard

    from lumisift.llm import quality_classifier as Q

    rng = random.Random(11)
    text = lambda good: " ".join(rng.choice(words[:400] if good else words[300:700]) for _ in range(rng.randint(20, 900)))
    rows = [(d, text(d % 2)) for d in range(160)] + [(900, None), (901, ""), (902, "z" * 100_000)]
    labels = [(d, d % 2, 0) for d in range(120)]
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    folder = _tables(spark, tmp_path / "a", rows, labels)
    got = {r.doc_id: r for r in queries.QUERIES["op6_quality_classifier"](spark, folder).collect()}
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([x for x in labels if x[0] not in held], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, known)
    bad, good = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in model.dictionaries)
    for d, t in rows:
        raw = (t or "").encode()
        cut = [raw[i : i + 2048] for i in range(0, len(raw), 2048)]
        x = sum(len(bad.compress(p)) - len(good.compress(p)) for p in cut) / len(raw) if raw else 0.0
        assert got[d].score == pytest.approx(1 / (1 + np.exp(-(model.slope * x + model.offset))), abs=1e-9)
        assert got[d].held_out == (d in held) and got[d].predicted == int(got[d].score >= 0.7)
    judged = [(got[d].score > 0.5) == bool(d % 2) for d in range(160) if d in held or d >= 120]
    assert sum(judged) > 0.9 * len(judged)
    flipped = _tables(spark, tmp_path / "b", rows, [(d, 1 - q if d in held else q, t) for d, q, t in labels])  # held-out labels say nothing
    assert {r.doc_id: r.score for r in queries.QUERIES["op6_quality_classifier"](spark, flipped).collect()} == {d: r.score for d, r in got.items()}


def test_odd_pages(spark, tmp_path):
    big, large = "<p>é</p>" * 200, "y" * 3_000_000
    rows = [(1, "u", big), (5, "u", big), (3, None, big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (10, "", ""), (11, "u", large), (12, "u", large)]
    extra = {c: F.lit(c) for c in ("record_type", "payload", "refers_to", "payload_digest", "value", "content_length")}
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(extra).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.QUERIES["op3_warc_round_trip"](spark, str(tmp_path)).collect()}
    assert got.keys() == {p for p, *_ in rows}
    for p, _, h in rows:
        raw = (h or "").encode()
        first = max(q for q, _, g in rows if (g or "") == (h or ""))
        again = len(raw) >= 1000 and first != p
        assert (got[p].payload_bytes, got[p].payload_digest, got[p].record_type, got[p].refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None)
