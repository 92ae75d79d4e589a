"""The pipeline's stages against their definitions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumisift.llm import decontamination, near_copies, quality_rules, simhash
from lumisift.llm.common import saved
from tests.llm.conftest import DOCUMENTS
from tests.llm.test_files import check_packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_repeats(texts, window=50):
    """Texts without the words of windows that start twice anywhere, and the white space between them."""
    words = {d: [m for m in WORD.finditer(t or "")] for d, t in texts.items()}
    at = lambda d, i: tuple(m.group() for m in words[d][i : i + window])
    times = Counter(at(d, i) for d, w in words.items() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = {k for i in range(len(w) - window + 1) if times[at(d, i)] > 1 for k in range(i, i + window)}
        kept, end = [], 0
        for k in sorted(gone):
            if k - 1 not in gone:
                kept.append((texts[d] or "")[end : w[k].start()])
            end = w[k].end()
        out[d] = "".join(kept) + (texts[d] or "")[end:]
    return out


def contaminated(text, items):
    """Whether a twentieth of the words lie in windows of 13 words of items."""
    words = decontamination.words_of((text or "").encode())
    hit = set()
    for item in items:
        w = decontamination.words_of(item.encode())
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        hit |= {k for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows for k in range(i, i + n)}
    return bool(hit) and 20 * len(hit) >= len(words)


def test_stages_by_definition(spark, documents, corpus, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    good = quality_rules.apply_rules(documents).filter("__quality.kept").orderBy("doc_id").collect()
    items = [*(" ".join(r.text.split()[3:40]) for r in good[::3]), "a b"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = saved(stage(spark, docs, str(tmp_path)))
        seen[name] = before, docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, out = seen["quality_rules"]
    rules = quality_rules.apply_rules(documents).filter("__quality.kept")
    assert texts(out) == texts(rules.select("doc_id", "text")) and out.count() < len(before)
    before, out = seen["simhash_near_dedup"]
    kept = set(near_copies.brute_force(list(before.items())).values())
    assert texts(out) == {d: before[d] for d in kept} and len(kept) < len(before)
    before, out = seen["suffix_array_dedup"]
    want = without_repeats(before)
    assert texts(out) == want and {r.doc_id: r.n_chars for r in out.collect()} == {d: len(t) for d, t in want.items()}
    assert want != before
    before, out = seen["benchmark_decontamination"]
    want = {d: t for d, t in before.items() if not contaminated(t, items)}
    assert texts(out) == want and len(want) < len(before)
    before, out = seen["best_fit_packing"]
    check_packing(out.collect(), before)
    documents.withColumn("rid", F.lit(rng.random())).write.parquet(str(tmp_path / "documents.parquet"))  # an extra column that clashes
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), before)


def test_rows_that_share_a_doc_id_are_rows(spark, words, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c = (" ".join(rng.choice(words) for _ in range(120)) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (None, c), (None, c), (None, None), (2, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCUMENTS).repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_distinct(spark, docs, "").collect())
    assert got == Counter([(1, a), (1, b), (None, c), (2, "")])
    spark.createDataFrame([(0, " ".join(b.split()[:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect())
    assert got == Counter([(1, a), (1, a), (None, c), (None, c), (None, ""), (2, "")])
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect())
    assert got == sorted([(1, ""), (1, b), (1, ""), (0, ""), (0, ""), (0, ""), (2, "")])


@pytest.mark.parametrize("stage", range(4))
def test_stages_of_nothing(spark, empty, tmp_path, stage):
    import corpus_pipeline

    spark.createDataFrame([(0, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.STAGES[stage][1](spark, empty, str(tmp_path))
    assert out.columns == corpus_pipeline.COLUMNS and out.count() == 0


def test_near_copies_equal_definition(spark, words):
    rng = random.Random(9)
    rows = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for k in range(4):
            w = list(base)
            for _ in range(k * len(w) // 80):  # some beyond 0.8
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(500, "a b"), (501, "A  b"), (502, ""), (503, None), (504, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = near_copies.brute_force(rows)
    assert {r.id: r.root for r in near_copies.near_copies(docs, "doc_id").collect()} == want
    fps = {d: simhash.fingerprint((t or "").encode()) for d, t in rows}
    assert any(r != d and (fps[r] ^ fps[d]).bit_count() > 2 for d, r in want.items())


def test_near_copies_unlike_all_pivots(spark, words):
    """Pairs of near copies in large buckets of texts that are a little less alike."""
    rng = random.Random(4)
    base = [rng.choice(words) for _ in range(400)]
    rows = []
    for _ in range(150):
        w = list(base)
        for number in (6, 8):
            w = list(w)
            for i in rng.sample(range(400), number):
                w[i] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    want = near_copies.brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.id: r.root for r in near_copies.near_copies(docs, "doc_id").collect()} == want
    assert 50 < len(set(want.values())) < 150


def test_near_copies_pairs_ruled_out_are_no_rows(spark, words, monkeypatch):
    """A bucket's classes meet in one join with all bounds; what they rule out is never a row, and nothing but the answer stays on disk."""
    rng = random.Random(6)
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, f"{shared} " + " ".join(rng.choice(words) for _ in range(40))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tables, gone = [], []
    monkeypatch.setattr(near_copies, "saved", lambda df: tables.append((df.columns, out := saved(df), out.count())) or out)
    drop = near_copies.discard
    monkeypatch.setattr(near_copies, "discard", lambda df: gone.append(id(df)) or drop(df))
    assert {r.id: r.root for r in near_copies.near_copies(docs, "doc_id").collect()} == near_copies.brute_force(rows)
    pairs = [n for columns, _, n in tables if {"other", "b"} & set(columns) and "both" not in columns]
    assert max(pairs) < 1000  # of 120 * 119 / 2 in each of some 20 buckets
    assert {id(df) for columns, df, _ in tables if "prefix" in columns or "set" in columns} <= set(gone)


def test_run_over_odd_and_no_rows(spark, words, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    prose = lambda n: " ".join([*(rng.choice(words) for _ in range(n)), "the of and to in"])
    a, long = prose(150), prose(60_000)
    clash = {c: F.lit(c) for c in ("rid", "id", "root", "kept", "block", "row", "__quality")}
    for name, rows in {"odd": [(1, a), (1, a), (None, prose(90)), (None, None), (3, None), (4, ""), (5, long)], "none": []}.items():
        folder = tmp_path / name
        frame = spark.createDataFrame([(d, t, None if d == 1 else "en", "s", None) for d, t in rows], DOCUMENTS)
        frame.withColumns(clash).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(0, None), (None, "a b c")], "item_id long, text string").withColumns(clash).write.parquet(f"{folder}/benchmark.parquet")
        pieces = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r.doc_id for r in pieces} == ({1, None, 5} if rows else set())
        assert sum(r.piece == 0 for r in pieces) == (3 if rows else 0)
