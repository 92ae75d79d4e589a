"""The Merkle manifest, line dedup and importance resampling, each against a plain definition over odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumisift.llm import line_dedup, merkle, resampling
from lumisift.llm.placing import placed

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("tree", "place", "node", "total", "items", "upper", "rid", "line", "key", "high", "low", "keeper", "bucket", "n", "list", "score", "__at")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in EXTRA})
    return docs.repartition(3) if rows else docs


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for d in range(330):
        text = " ".join(rng.choice(["Ab", "cd", "É", "ﬀ"]) for _ in range(rng.randint(0, 6)))
        out.append((d, text, "en", rng.choice(["hot", "hot", "hot", "b", "B", "é", None]), len(text)))
    out += [(1, None, None, "hot", None), (1, None, None, "hot", None), (None, "Null Id", "x", "b", 7), (None, "Null Id", "x", "b", 7), (1000, "", "", "", 0), (1001, "Z" * 300_000, "en", "alone", 1)]
    rng.shuffle(out)
    return out


def plain_manifest(rows):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def path(all_levels, i):
        for nodes in all_levels[:-1]:
            run = i // 16 * 16
            yield nodes[run:i], nodes[i + 1 : run + 16]
            i //= 16

    trees = defaultdict(list)
    for r in rows:
        trees[r[3]].append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        inner[s] = levels([leaf(r, r[1]) for r in trees[s]])
    top = levels([inner[s][-1][0] for s in names]) if names else []
    root, out = top[-1][0] if rows else None, []
    for k, s in enumerate(names):
        for i, r in enumerate(trees[s]):
            steps = [*path(inner[s], i), *path(top, k)]
            proof = sha("".join("".join(a) + "".join(b) for a, b in steps))
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, r[1].translate(LOWER) if changed and r[1] is not None else r[1])
            for a, b in steps:
                node = sha("".join(a) + node + "".join(b))
            out.append((r[0], leaf(r, r[1]), inner[s][-1][0], root, proof, node, node == root))
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_manifest(spark, rows, tmp_path, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)  # blocks of 16 and 256 nodes take several rounds here
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    want = plain_manifest(rows)
    assert Counter(got) == Counter(want)
    assert {v for *_, v in want} == {True, False} and {v for d, *_, v in want if d == 1000} == {True}


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_manifest_of_few(spark, n):
    few = [(i, f"T{i}", "en", "s", 1) for i in range(n)]
    got = merkle.manifest(merkle.leaves_of(frame(spark, few)))
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded) for r in got.collect()) == Counter(w[:6] for w in plain_manifest(few))


def test_places_within_groups(spark):
    rng = random.Random(2)
    data = [("g" if rng.random() < 0.7 else f"g{rng.randint(0, 5)}", rng.randint(0, 20)) for _ in range(500)]
    got = defaultdict(list)
    for r in placed(spark.createDataFrame(data, "g string, x int").repartition(5), "g", [F.desc("x")]).collect():
        got[r.g].append((r.place, r.x))
    for g, own in got.items():
        assert [p for p, _ in sorted(own)] == list(range(len(own)))
        assert [x for _, x in sorted(own)] == sorted((x for h, x in data if h == g), reverse=True)


def plain_lines(rows, least=20, documents=3):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    order = lambda d: (d is not None, d or 0)
    drop = {k: max(ds, key=order) for k, ds in holders.items() if len(k) >= least and len(ds) >= documents}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in drop or drop[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(8)
    pool = [f"Boilerplate Line {i} É of the site" for i in range(12)] + ["twenty code points ä", "nineteen code pointß", "short", "", "\t \v", "x" * 400_000]
    change = lambda x: rng.choice([x, x, f" {x}\t", x.upper() if x.isascii() else x.translate(LOWER), f" {x}"])
    out = []
    for d in range(80):
        lines = [change(rng.choice(pool[:-1])) if rng.random() < 0.6 else f"own line {d} {rng.random()}" for _ in range(rng.randint(0, 9))]
        out.append((d, "\n".join(lines), "en", "s", 1))
    out += [(5, pool[0], "en", "s", 1), (5, pool[0], "en", "s", 1), (None, f"{pool[0]}\nrest", None, None, None), (None, None, None, None, None), (200, None, "en", "s", 0), (201, "", "en", "s", 0)]
    out += [(300 + k, f"{pool[-1]}\n{pool[1]}\r\nend {k}\n", "en", "s", 1) for k in range(4)]
    return out


@pytest.mark.parametrize("hot", [line_dedup.HOT, 4, 0])
def test_lines(spark, lined, hot):
    """hot: all repeated hashes are broadcast, some, or none."""
    got = line_dedup.remove_repeated_lines(frame(spark, lined), hot=hot).collect()
    want = plain_lines(lined)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.kept)) for r in got) == Counter(want)
    assert sum(n for _, _, n, _ in want) > 50


def test_lines_query_is_native_and_takes_no_rows(spark, lined, tmp_path):
    frame(spark, lined).write.parquet(f"{tmp_path}/documents.parquet")
    got = line_dedup.op12_line_dedup(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == Counter(plain_lines(lined))
    assert line_dedup.remove_repeated_lines(frame(spark, [])).count() == 0


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


TEXTS = ["Ab cd-EF", "", None, "a", "É9 ﬀ\x7f\x80z", "..,", "x" * 3000 + " y " + "z" * 49 + "é" * 60, "w " * 5000, "ends with sep ", "日本 語"]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[::-1], ["", None], [], ["abc"]])
def test_the_automaton_reads_like_the_pattern(texts):
    column = pa.array(["skipped", *texts, "tail"], pa.string()).slice(1, len(texts))
    words, owner, found = resampling.features(column)
    want = [plain_features(t) for t in texts]
    assert words.tolist() == [n for n, _ in want]
    for i, (_, buckets) in enumerate(want):
        assert Counter(found[owner == i].tolist()) == Counter(buckets)


def test_the_automaton_on_random_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aBz09 -_é日\x00\n") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    words, owner, found = resampling.features(pa.array(texts))
    got = defaultdict(Counter)
    for o, b in zip(owner.tolist(), found.tolist()):
        got[o][b] += 1
    assert all(words[i] == n and got[i] == Counter(b) for i, (n, b) in enumerate(map(plain_features, texts)))


def test_resampling(spark, words, tmp_path):
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(words[:200]) for _ in range(n))
    rows = [(d, prose(rng.randint(0, 60)), "en", "s", 1) for d in range(150)] + [(7, prose(30), "en", "s", 1)] * 3 + [(None, prose(40), None, None, None), (None, None, None, None, None), (500, None, "en", "s", 0), (501, "y" * 500_000, "en", "s", 1)]
    target = [("a", prose(300)), ("b", None), (None, "")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(target, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    s, t = Counter(), Counter()
    for r in rows:
        s.update(plain_features(r[1])[1])
    for _, text in target:
        t.update(plain_features(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    scored = []
    for d, text, *_ in rows:
        n, buckets = plain_features(text)
        weight = sum(map(gain, buckets)) // len(buckets) if buckets else 0
        h = int(sha(f"7:{'' if d is None else d}")[:8], 16)
        scored.append((weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), d, n, len(buckets), weight))
    eligible = sorted((x for x in scored if x[2] >= 20), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    drawn = Counter((x[1], x[3], x[4], x[0], k + 1) for k, x in enumerate(eligible[: 25 * len(eligible) // 100]))
    got = [tuple(r) for r in resampling.op13_importance_resampling(spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert Counter(r[:4] for r in got) == Counter((x[1], x[3], x[4], x[0]) for x in scored)
    assert Counter(r for r in got if r[4] is not None) == drawn and len(drawn) > 20


def test_resampling_of_nothing(spark):
    docs, target = frame(spark, []), spark.createDataFrame([("a", "some words")], "item_id string, text string")
    assert resampling.resample(docs, target).count() == 0
    one = frame(spark, [(1, "word " * 30, "en", "s", 1)])
    r = resampling.resample(one, target.limit(0), percent=100).first()
    assert r.rank == 1 and r.n_words == 30 and np.isfinite(r.score)
