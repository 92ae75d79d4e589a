"""Rules, decontamination, classifier and language model."""

import math
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumisift.llm import decontamination, hmm, quality_classifier, quality_rules


def _duck(spark, sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        pdf = df.toPandas()
        con.register(f"_{name}", pdf)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    return con.sql(sql).fetchall()


def test_rules_equal_sql(spark, documents):
    out = quality_rules.apply_rules(documents.select("doc_id", "text")).select("doc_id", *[f"__quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
    assert sorted(map(tuple, out.collect())) == sorted(_duck(spark, quality_rules.ORACLE_SQL, documents=documents.select("doc_id", "text")))


def test_repeat_words_by_definition(spark):
    texts = ["a b c a b c", "a a a a", "a b", "", None, "q w e r t y q w e z", "x y z " * 100]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n for r in quality_rules.apply_rules(rows).select("doc_id", "__quality.n_repeat_words").withColumnRenamed("n_repeat_words", "n").collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert got[i] == len({k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_rules_run_no_python(spark, documents):
    plan = quality_rules.apply_rules(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!ed)", plan.replace("ArrowColumnar", ""))


def _decontaminated(docs, items, **options):
    out = decontamination.contamination(docs, items, **options)
    return sorted(tuple(r) for r in out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long"), F.sha2(F.array_join("item_ids", ","), 256), "contaminated").collect())


@pytest.fixture
def items(spark, corpus):
    long = [t for _, t in corpus if t and len(t.split()) > 60]
    rows = [(i, " ".join(t.split()[5 : 5 + 10 + i])) for i, t in enumerate(long[:30])] + [(90, long[0].upper()), (91, None), (92, ""), (93, "--"), (94, "nowhere words at all"), (95, "aa aa"), (1, "a")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination_equals_sql(spark, documents, items):
    want = sorted(_duck(spark, decontamination.ORACLE_SQL, documents=documents.select("doc_id", "text"), benchmark=items))
    assert _decontaminated(documents, items) == want
    assert any(r[-1] for r in want)


def test_decontamination_in_deals_and_blocks(spark, documents, items, monkeypatch):
    whole = _decontaminated(documents, items)
    monkeypatch.setattr(decontamination, "AT_ONCE", 100)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 5_000)
    assert _decontaminated(documents, items) == whole


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "one two noise three four"), (2, "one two three four"), (3, "four three two one")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "one two three four")], "item_id string, text string")
    hit = lambda slop: {r.doc_id for r in decontamination.contamination(docs, items, slop=slop).filter("n_hit > 0").collect()}
    assert hit(0) == {2} and hit(1) == {1, 2}


def test_proximity_matches_stay_in_a_document(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "x b c d e f"), (4, "")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("q", "a b c d e f")], "item_id string, text string")
    for slop in (1, 2, 5):
        hits = {r.doc_id: r.n_hit for r in decontamination.contamination(docs, items, slop=slop).collect()}
        assert hits == {1: 0, 2: 0, 3: 0, 4: 0}
    items = spark.createDataFrame([("q", "b c e")], "item_id string, text string")
    hits = {r.doc_id: r.n_hit for r in decontamination.contamination(docs, items, slop=1).collect()}
    assert hits == {1: 0, 2: 0, 3: 5, 4: 0}


def test_decontamination_of_nothing(spark, empty, items, documents):
    assert decontamination.contamination(empty, items).count() == 0
    assert decontamination.contamination(documents, items.limit(0)).filter("contaminated").count() == 0


def test_classifier_tells_held_out_labels(spark, words):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        text = " ".join(rng.choice(words[:300]) if good else rng.choice(words[300:600]).upper() + "!!" for _ in range(rng.randint(40, 200)))
        rows.append((i, text, int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 4] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).collect()}
    assert sum(out[i].predicted == q for i, _, q in rows if i % 4 == 0) >= 97
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == 402
    single = quality_classifier.fit(docs, labels.filter("quality = 1"))
    assert {r.predicted for r in quality_classifier.classify(docs, single).collect()} == {1}


def _base(docs, train):
    counts = Counter(w for d, t in docs if train(d) for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, t in docs:
        tokens = [*(t or "").encode().lower().split(), b""]
        out[d] = len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
    return out


def test_language_model_counts_and_base(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 20_000)
    want = _base(corpus, lambda d: d % 3 > 0)
    got = hmm.score_documents(documents.withColumn("train", F.col("doc_id") % 3 > 0), rounds=1).collect()
    assert len(got) == len(corpus)
    for r in got:
        n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0


def test_forward_and_expectations_are_exact(monkeypatch):
    import itertools

    import numpy as np

    monkeypatch.setattr(hmm, "CHUNK", 3)
    rng = np.random.default_rng(0)
    k, c = 2, 4
    begin, move, emission = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T
    lengths = np.array([7, 1, 3, 4])
    classes = rng.integers(0, c, lengths.sum())
    starts, moves, shares, total = hmm.expected(lengths, emission[classes], begin, move)
    want_moves, want_starts, at = np.zeros((k, k)), np.zeros(k), 0
    for doc, n in enumerate(lengths):
        seq = classes[at : at + n]
        paths = {p: begin[p[0]] * np.prod([move[p[i], p[i + 1]] * emission[seq[i], p[i + 1]] for i in range(n)]) for p in itertools.product(range(k), repeat=n + 1)}
        z = sum(paths.values())
        assert np.isclose(total[doc], np.log(z))
        for p, w in paths.items():
            want_starts[p[0]] += w / z
            for i in range(n):
                want_moves[p[i], p[i + 1]] += w / z
        for i in range(n):
            share = [sum(w for p, w in paths.items() if p[i + 1] == s) / z for s in range(k)]
            assert np.allclose(shares[at + i], share)
        at += n
    assert np.allclose(moves, want_moves) and np.allclose(starts, want_starts)


def test_portions_of_a_block_hold_each_token_once(monkeypatch):
    """However large a block, only so many tokens' states are in memory, and expectations are the same."""
    import numpy as np

    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 90, 400)
    emit = rng.dirichlet(np.ones(3), int(lengths.sum()))
    begin, move = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    starts, moves, shares, total = hmm.expected(lengths, emit, begin, move)
    monkeypatch.setattr(hmm, "AT_ONCE", 1000)
    docs, places = zip(*hmm._portions(lengths))
    assert max(map(len, places)) <= 1000 and len(docs) > 10
    assert sorted(np.concatenate(docs).tolist()) == list(range(400)) and sorted(np.concatenate(places).tolist()) == list(range(len(emit)))
    parts = [hmm.expected(lengths[d], emit[p], begin, move) for d, p in zip(docs, places)]
    assert np.allclose(sum(x[0] for x in parts), starts) and np.allclose(sum(x[1] for x in parts), moves)
    assert all(np.allclose(x[2], shares[p]) and np.allclose(x[3], total[d]) for x, d, p in zip(parts, docs, places))


def _two_tongues(seed, count, shared=()):
    """Texts of one of two vocabularies each, whose words end alike within a vocabulary."""
    import random

    rng = random.Random(seed)
    stems = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(150)]
    return [(i, " ".join(rng.choice(stems) + ("ish" if i % 2 else "oux") for _ in range(rng.randint(5, 120)))) for i in range(count)]


def test_training_raises_the_likelihood_and_beats_the_base(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", 4)
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(hmm, "CHUNK", 32)
    docs = spark.createDataFrame(_two_tongues(3, 300), "doc_id long, text string").withColumn("train", F.col("doc_id") % 5 > 0).repartition(3)
    logs = []
    train = hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: [out := train(*a), logs.extend(out[-1])][0])
    rows = [r for r in hmm.score_documents(docs, states=4, rounds=3).collect() if r.held_out]
    assert len(logs) == 3 and logs[1] > logs[0] and logs[2] >= logs[1] - 1e-6 * abs(logs[1])
    tokens = sum(r.n_tokens for r in rows)
    bits = lambda column: -sum(r[column] for r in rows) / tokens / math.log10(2)
    assert bits("score") < bits("base_score") - 0.5


def test_scores_are_of_one_distribution(spark, monkeypatch):
    """Over all next words, known or not, probabilities of a class sum to at most 1."""
    monkeypatch.setattr(hmm, "FREQUENT", 3)
    train = [(i, "aa aa aa bb bb cc") for i in range(4)]
    asked = [(10 + i, w) for i, w in enumerate(["aa", "bb", "cc", "dd", ""])]
    docs = spark.createDataFrame(train + asked, "doc_id long, text string").withColumn("train", F.col("doc_id") < 10)
    got = {r.doc_id: 10**r.score for r in hmm.score_documents(docs, states=2, rounds=1).collect()}
    assert 0 < sum(got[d] for d, _ in asked) <= 1 + 1e-9 and got[10] > got[12] > got[13] > 0


@pytest.mark.parametrize("top", [0, 40])
def test_broadcast_words_change_no_score(spark, monkeypatch, top):
    """The most frequent words go by broadcast, others by a table: scores are the same, and no rows are made for the former."""
    monkeypatch.setattr(hmm, "FREQUENT", 4)
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 20_000)
    docs = spark.createDataFrame(_two_tongues(5, 120), "doc_id long, text string").withColumn("train", F.col("doc_id") % 5 > 0).repartition(3)
    rows, train = [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda blocks, own, *a: rows.append(own.count()) or train(blocks, own, *a))
    scores = lambda: {r.doc_id: r.score for r in hmm.score_documents(docs, states=3, rounds=2).collect()}
    want = scores()
    monkeypatch.setattr(hmm, "TOP", top)
    got = scores()
    assert rows[0] == 0 < rows[1]
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-5) for d in want)


def test_start_rounds_take_each_token_once(spark, documents, monkeypatch):
    """The rounds over all shares together unpack each token once, and their expected counts are of all training tokens."""
    import numpy as np

    monkeypatch.setattr(hmm, "BLOCK_BYTES", 20_000)
    docs = documents.select("doc_id", "text", (F.col("doc_id") % 3 > 0).alias("train"))
    batches = docs.mapInArrow(hmm._encoded, hmm.BLOCKS).toArrow().to_batches()
    blocks = [r for b in batches for r in b.to_pylist()]
    lengths, trained = (sum(sum(x for x, t in zip(r["lengths"], r["train"]) if t or every) for r in blocks) for every in (True, False))
    numbers, unpacked = [], hmm.unpacked
    monkeypatch.setattr(hmm, "unpacked", lambda data: numbers.append(x := unpacked(data)) or x)
    by_shape, total = np.full((hmm.SHAPES, 2), 1 / hmm.SHAPES), 0
    for share in range(hmm.SHARES):
        read = [b.set_column(b.schema.get_field_index("tokens"), "tokens", pa.array([[r["tokens"][share]] for r in b.to_pylist()], pa.list_(pa.binary()))) for b in batches]
        out = [r for b in hmm._start_round(share, 2, np.full(2, 0.5), np.full((2, 2), 0.5), by_shape)(read) for r in b.to_pylist()]
        total += sum(sum(r["shares"]) for r in out if r["shape"] >= 0)
    shapes = hmm.SHARES * sum(len(unpacked(r["shapes"])) for r in blocks)
    assert len(blocks) > 1 and sum(map(len, numbers)) == lengths + shapes
    assert math.isclose(total, trained)


@pytest.mark.parametrize("top", [0, 40, 1 << 17])
def test_expected_counts_are_written_as_sums(spark, monkeypatch, top):
    """However many blocks and tasks there are, a round writes each word's and shape's expected counts once; together they are all training tokens."""
    import numpy as np

    for name, value in (("FREQUENT", 4), ("BLOCK_BYTES", 20_000), ("SLICE", 64), ("TOP", top)):
        monkeypatch.setattr(hmm, name, value)
    docs = spark.createDataFrame(_two_tongues(7, 120), "doc_id long, text string").withColumn("train", F.col("doc_id") % 5 > 0).repartition(4)
    rows, saved = [], hmm.saved
    monkeypatch.setattr(hmm, "saved", lambda df: [out := saved(df), rows.extend(out.collect() if "sums" in out.columns else [])][0])
    tokens = hmm.score_documents(docs, states=3, rounds=1).first().train_tokens
    assert rows and len({(r.kind, r.part) for r in rows}) == len(rows)
    keys = [(r.kind, k) for r in rows for k in np.frombuffer(r["keys"], np.int64).tolist()]
    assert len(set(keys)) == len(keys) and {"word", "top"} & {k for k, _ in keys} == ({"word"} if not top else {"top"} if top > 40 else {"word", "top"})
    assert math.isclose(sum(np.frombuffer(r["sums"]).sum() for r in rows if r.kind != "chain"), tokens, rel_tol=1e-5)


def test_short_numbers():
    import numpy as np

    x = np.random.default_rng(0).lognormal(-5, 9, (1000, 8))
    x[0] = 0
    assert np.allclose(hmm.unshort(hmm.short(x)).reshape(x.shape), x, rtol=2**-16, atol=0)
    assert len(hmm.unshort(hmm.short(np.zeros((0, 8))))) == len(hmm.unpacked(hmm.packed(np.zeros(0)))) == 0


def test_language_model_of_nothing_and_odd_rows(spark, empty):
    assert hmm.score_documents(empty.withColumn("train", F.lit(True))).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, None), (None, ""), (2, "x " * 200_000)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, block int").withColumn("train", F.col("doc_id").isNull() | (F.col("doc_id") != 2))
    got = sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in hmm.score_documents(docs).collect())
    assert got == [(0, False, 1, 1, 8), (0, False, 1, 1, 8), (1, False, 3, 3, 8), (1, False, 3, 3, 8), (2, True, 200_001, 1, 8)]
