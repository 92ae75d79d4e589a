"""Near, suffix and substring dedup against their definitions."""

import random

from pyspark.sql import functions as F

from lumisift.llm import simhash, substring_dedup, suffix_dedup
from lumisift.llm.common import Rolling
from lumisift.llm.suffix_sort import common_prefix, decoded, front_coded, merged


def test_merge_sort_keeps_order_and_prefixes():
    rng = random.Random(1)
    for _ in range(100):
        rows = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), i) for i in range(rng.randint(1, 60))]
        k = rng.randint(1, 7)
        runs = [front_coded(sorted(rows[i::k])) for i in range(min(k, len(rows)))]
        got = list(merged([decoded(**r, width=1) for r in runs]))
        assert [(s, ids[0]) for s, _, ids in got] == sorted(rows)
        assert all(common_prefix(a[0], b[0]) == b[1] for a, b in zip(got, got[1:]))


def _suffix_rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in df.select("*", F.sha2("kept", 256).alias("h")).collect()}


def test_suffix_dedup_equals_definition(documents, corpus, monkeypatch):
    want = suffix_dedup.brute_force(corpus)
    assert _suffix_rows(suffix_dedup.remove_repeats(documents)) == want
    # many small ranges and runs: splitters fall between equal strings; few neighbours: look-ups decide more
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 50_000)
    monkeypatch.setattr(suffix_dedup, "NEIGHBOURS", 1)
    assert _suffix_rows(suffix_dedup.remove_repeats(documents)) == want


def test_suffix_dedup_of_repeated_rows_nulls_and_nothing(spark, documents, empty, words):
    text = " ".join(words[:200])
    rows = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text[:500], "x"), (None, None, "x")], "doc_id long, text string, kept string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(rows).collect())
    n = len(text.encode())
    assert got == [(0, 0, 0), (0, len(text[:500].encode()), len(text[:500].encode())), (1, n, n), (1, n, n)]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_nul_bytes_behind_shorter_texts(spark):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("bcdefghijklmnopqrstuvwxyz") for _ in range(n))
    # of passages one that holds the least hash of each window about it, so all texts are sorted by what stands there
    least = lambda x: min(Rolling(suffix_dedup._values(x.encode()), suffix_dedup.BASES[0]).all(suffix_dedup.GRAM).tolist())
    passage, before = min((prose(100) for _ in range(300)), key=least), "A" * 200
    texts = [before + passage + "\0" * 400, before + passage + "\0" * 250 + prose(300)]
    # more texts than a suffix has neighbours end with the passage; padded, they stand between those two
    texts += [prose(450) + passage for _ in range(suffix_dedup.NEIGHBOURS + 4)]
    rows = list(enumerate(texts))
    want = suffix_dedup.brute_force(rows)
    assert want[1][1] == 550
    assert _suffix_rows(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_substring_dedup_equals_definition(documents, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.h) for r in substring_dedup.remove_repeats(documents).select("*", F.sha2("kept", 256).alias("h")).collect()}
    assert got == substring_dedup.brute_force(corpus)


def test_substring_dedup_of_repeated_rows_nulls_and_nothing(spark, empty, words):
    text = " ".join(words[:120])
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(rows).collect())
    assert got == [(0, 120, 0), (1, 120, 0), (1, 120, 0), (2, 120, 120), (3, 0, 0)]
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_simhash_equals_all_pairs(documents, corpus, monkeypatch):
    want = simhash.brute_force(corpus)
    for leaf, block in ((250_000, 256), (10, 4)):
        monkeypatch.setattr(simhash, "LEAF", leaf)
        monkeypatch.setattr(simhash, "BLOCK", block)
        out = simhash.near_duplicates(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fp"), "component_id")
        assert {r.doc_id: (r.fp, r.component_id) for r in out.collect()} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_tree_loses_no_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (60, 12, 2)).astype(np.uint64)).sum(axis=2, dtype=np.uint64)
    fps = np.unique(np.concatenate([seeds, (seeds[:, None] ^ flips).ravel()]))
    nodes = simhash.grow_tree(fps[::3], 30)
    rows, leaf, own = simhash.route(fps, nodes, 2)
    assert sorted(rows[own].tolist()) == list(range(len(fps)))
    met = set()
    for k in set(leaf.tolist()):
        here = [(r, o) for r, x, o in zip(rows.tolist(), leaf.tolist(), own.tolist()) if x == k]
        met |= {tuple(sorted((a, b))) for a, oa in here for b, ob in here if a < b and (oa or ob)}
        met |= {tuple(sorted((a, b))) for a, oa in here for b, ob in here if oa and a != b}
    near = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert near and near <= met


def test_simhash_of_long_chain_nulls_and_nothing(spark, empty):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 200)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(links).collect()} == {**{i: 0 for i in range(n + 1)}, 100: 100, 200: 100}
    rows = spark.createDataFrame([(5, None), (3, ""), (None, "  "), (9, "only one")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(rows).collect()) == [(0, 3), (3, 3), (5, 3), (9, 9)]
    assert simhash.near_duplicates(empty).count() == 0
