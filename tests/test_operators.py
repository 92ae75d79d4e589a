"""Invariants of the query algebra over a seeded catalogue, and operators on literal rows."""

import dataclasses

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumisift import schema
from lumisift.operators import criteria, decisions, duplicates, orders, people, products, sections, stats
from lumisift.params import CRITERIA, QueryParams, RunParams
from lumisift.plans.query import LibraryQuery

ITEM = f"""id string, url string, ts long, date_source string, is_video boolean, is_owned boolean, duration long, dedup_key string, size_bytes long, space_taken long,
analyzed boolean, analysis_error string, features {schema.FEATURES}, people array<int>, people_scanned boolean, kept boolean""".replace("\n", " ")


def item(i, **over):
    f = {"face_score": 0.0, "screenshot_score": 0.0, "document_score": 0.0, "blur_score": 0.0, "dark_score": 0.0, "bright_score": 0.0, "face_method": None, "skin_frac": None, "lap_var": 100.0, "nat_w": 1000, "nat_h": 1000, "dhash": "0" * 16, "ahash": "0" * 16}
    row = {"id": i, "url": "u", "ts": 1_672_531_200_000, "date_source": "api", "is_video": False, "is_owned": True, "duration": None, "dedup_key": "k", "size_bytes": None, "space_taken": None, "analyzed": True, "analysis_error": None, "people": None, "people_scanned": False, "kept": None}
    features = over.pop("features", {})
    row["features"] = None if features is None else f | features
    return row | over


@pytest.fixture(scope="module")
def catalogue(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(400):
        bucket = f"{int(rng.integers(40)):02x}"
        scores = {k: float(rng.random()) for k in ("face_score", "screenshot_score", "document_score", "blur_score", "dark_score", "bright_score")}
        analysed = rng.random() < 0.9
        features = {**scores, "lap_var": float(rng.random() * 800), "dhash": "0" * 14 + bucket, "ahash": "0" * 14 + bucket} if analysed else None
        video = bool(rng.random() < 0.12)
        ts = None if rng.random() < 0.05 else int(1_514_764_800_000 + rng.integers(0, 6 * 365 * 24) * 3_600_000)
        ids = None if rng.random() < 0.2 else sorted({int(x) for x in rng.integers(0, 9, rng.integers(0, 4))})
        rows.append(item(f"id{i}", ts=ts, is_video=video, duration=int(rng.integers(600)) if video else None, features=features, analyzed=bool(analysed), people=ids, size_bytes=int(rng.integers(0, 9)) * 10_000_000 or None))
    return spark.createDataFrame(rows, ITEM).persist()


def groups_of(items):
    return stats.group_sizes(items).withColumn("name", F.lit(None).cast("string"))


ALL = QueryParams(enabled=set(CRITERIA), person_ids=(1, 2), date_from=1_577_836_800_000, hide_kept=False)


@pytest.fixture(scope="module")
def alone(catalogue):
    """criterion -> ids that it matches alone."""
    groups = groups_of(catalogue)
    return {k: {r.id for r in LibraryQuery(catalogue, dataclasses.replace(ALL, enabled={k}), groups).matches().collect()} for k in CRITERIA}


def test_badges_are_filter_sizes(catalogue, alone):
    badges = LibraryQuery(catalogue, ALL, groups_of(catalogue)).badges().first()
    assert {k: badges[k] for k in CRITERIA} == {k: len(v) for k, v in alone.items()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(chosen=st.sets(st.sampled_from(CRITERIA), min_size=1, max_size=5))
def test_any_is_union_and_all_is_intersection(catalogue, alone, chosen):
    ids = lambda mode: {r.id for r in LibraryQuery(catalogue, dataclasses.replace(ALL, enabled=chosen, mode=mode), groups_of(catalogue)).matches().select("id").collect()}
    assert ids("any") == set.union(*(alone[k] for k in chosen))
    assert ids("all") == set.intersection(*(alone[k] for k in chosen))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.floats(0, 1), b=st.floats(0, 1))
def test_thresholds_are_monotone(catalogue, a, b):
    n = lambda x: criteria.count_per_criterion(catalogue.withColumn("dup_selectable", F.lit(False)), QueryParams(blur_min=x)).first().blurry
    assert n(max(a, b)) <= n(min(a, b))


def test_one_keeper_a_set(catalogue):
    dup = duplicates.groups(catalogue).persist()
    sizes = {r.root: r["count"] for r in dup.groupBy("root").count().collect()}
    assert sizes and min(sizes.values()) >= 2
    for how in ("sharpest", "first", "last"):
        keep = duplicates.keepers(dup, catalogue, how)
        assert {r.root for r in keep.collect()} == sizes.keys() and keep.count() == len(sizes)
        assert duplicates.selectable(dup, keep).count() == sum(sizes.values()) - len(sizes)
    assert duplicates.keepers(dup, catalogue, "none").count() == 0


@pytest.mark.parametrize("order", ["rarePeople", "newest", "similar"])
def test_sections_partition_the_answer(catalogue, order):
    q = LibraryQuery(catalogue, dataclasses.replace(ALL, enabled={"blurry", "dark"}, sort=order), groups_of(catalogue))
    out = q.sectioned().collect()
    assert sorted(r.id for r in out) == sorted(r.id for r in q.matches().collect())
    by = {}
    for r in out:
        by.setdefault((r.section_rank, r.section), []).append(r.row_rank)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())
    assert sorted(k for k, _ in by) == list(range(1, len(by) + 1))


def test_histograms_add_up(catalogue):
    one = stats.scalars(catalogue).first()
    for df in (*(stats.histogram(catalogue, u) for u in ("year", "month", "day")), stats.by_weekday(catalogue), stats.by_hour(catalogue)):
        assert df.agg(F.sum("n")).first()[0] + one.no_date == one.total


def test_large_tables_rank_by_parts(catalogue, monkeypatch):
    want = {r.id: r.rank for r in orders.with_rank(catalogue.select("id", "ts"), orders.grid_order()).collect()}
    monkeypatch.setattr(orders, "ONE_TASK_BYTES", 0)
    assert {r.id: r.rank for r in orders.with_rank(catalogue.select("id", "ts"), orders.grid_order()).collect()} == want
    assert sorted(want.values()) == list(range(1, 401))


def test_unknown_is_no_answer(spark):
    rows = [item("a", people=None), item("b", people=[]), item("c", people=[3]), item("d", ts=None, size_bytes=0), item("e", features=None), item("f", features={"face_score": None, "face_method": "ultraface"}), item("g", features={"face_score": 0.1, "skin_frac": 0.5})]
    items = spark.createDataFrame(rows, ITEM).withColumn("dup_selectable", F.lit(False))
    table = criteria.predicates(QueryParams(person_ids=(3,), date_from=0))
    got = {k: {r.id for r in items.filter(table[k]).collect()} for k in ("withPerson", "withoutPerson", "dateRange", "noFace", "largeFile")}
    assert got["withPerson"] == {"c"} and got["withoutPerson"] == {"b"} and "d" not in got["dateRange"]
    assert got["noFace"] == {"a", "b", "c", "d", "f"} and got["largeFile"] == set()


def test_closure_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in duplicates.closure(edges).collect()} == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}


def plain_clusters(vectors, eps, ratio=1.0):
    """Leader clustering and merging, one vector after another."""
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    clusters = []
    for i, v in enumerate(map(unit, np.asarray(vectors, float))):
        d = [1 - float(np.clip(unit(c["sum"]) @ v, -1, 1)) for c in clusters]
        if d and min(d) <= eps:
            c = clusters[int(np.argmin(d))]
            c["sum"], c["members"] = c["sum"] + v, [*c["members"], i]
        else:
            clusters.append({"sum": v.copy(), "members": [i]})
    again = True
    while again:
        again = False
        for a in range(len(clusters)):
            b = next((b for b in range(a + 1, len(clusters)) if 1 - float(np.clip(unit(clusters[a]["sum"]) @ unit(clusters[b]["sum"]), -1, 1)) <= eps * ratio), None)
            if b is not None:
                clusters[a]["sum"] += clusters[b]["sum"]
                clusters[a]["members"] += clusters.pop(b)["members"]
                again = True
                break
    return {frozenset(c["members"]) for c in clusters}


def blobs(counts, dim=32, jitter=0.08, seed=0):
    rng = np.random.default_rng(seed)
    out = [(c + rng.normal(size=dim) * jitter, k) for k, n in enumerate(counts) for c in [np.random.default_rng(seed + 100 + k).normal(size=dim)] for _ in range(n)]
    rng.shuffle(out := [(v.tolist(), k) for v, k in out])
    return out


@pytest.mark.parametrize("counts", [[7, 6, 5], [24, 20], [1, 1, 30]])
def test_clusters_equal_the_plain_sequence(spark, counts):
    data = blobs(counts)
    faces = spark.createDataFrame([(f"p{i:03d}#0", f"p{i:03d}", v) for i, (v, _) in enumerate(data)], "id string, photo_id string, vector array<float>")
    rows = people.cluster_faces(faces, 0.6).collect()
    got = {}
    for r in rows:
        got.setdefault(r.cluster, set()).add(int(r.photo_id[1:]))
    want = plain_clusters([np.float32(v) for v, _ in data], 0.6)
    assert {frozenset(v) for v in got.values()} == want
    report = people.report(people.cluster_faces(faces, 0.6)).orderBy("group_id").collect()
    assert [r["size"] for r in report] == sorted((n for n in map(len, want) if n >= 2), reverse=True)


def test_fusing_equals_the_scan_from_the_start(monkeypatch):
    for seed in range(25):
        rng = np.random.default_rng(seed)
        k, dim = int(rng.integers(1, 150)), int(rng.choice([3, 8, 32]))
        centres = rng.normal(size=(max(2, k // 6), dim))
        sums = (centres[rng.integers(0, len(centres), k)] + rng.normal(size=(k, dim)) * rng.choice([0.3, 0.8])).astype(np.float32)
        monkeypatch.setattr(people, "ROWS_AT_ONCE", int(rng.choice([4, 256])))
        left = [(s.copy(), {i}) for i, s in enumerate(sums)]
        again = True
        while again:
            near = ((a, b) for a in range(len(left)) for b in range(a + 1, len(left)) if 1 - np.clip(people.unit(left[a][0]) @ people.unit(left[b][0]), -1, 1) <= 0.4)
            again = next(near, None)
            if again:
                a, b = again
                left[a] = left[a][0] + left[b][0], left[a][1] | left[b][1]
                del left[b]
        ends = people.fuse(sums, people.unit(sums), 0.4)
        got = {}
        for i, e in enumerate(ends):
            got.setdefault(e, set()).add(i)
        assert list(map(frozenset, got.values())) == [frozenset(m) for _, m in left]
        assert all(min(m) == e for e, m in got.items())


@pytest.mark.parametrize("block_bytes", [16 << 20, 32 * 8 * 3])
def test_shards_find_the_same_people(spark, monkeypatch, block_bytes):
    data = blobs([40, 30, 20, 10, 1, 1], jitter=0.02)
    faces = spark.createDataFrame([(f"p{i:03d}#0", f"p{i:03d}", v) for i, (v, _) in enumerate(data)], "id string, photo_id string, vector array<float>")
    monkeypatch.setattr(people, "SHARD", 35)
    monkeypatch.setattr(products, "BLOCK_BYTES", block_bytes)
    rows = people.cluster_faces(faces, 0.6).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.cluster, set()).add(data[int(r.photo_id[1:])][1])
    assert len(rows) == 102 and len(seen) == 6 and all(len(v) == 1 for v in seen.values())


def test_shards_end_without_near_clusters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    faces = spark.createDataFrame([(f"{i:03d}", f"p{i}", rng.normal(size=4).tolist()) for i in range(120)], "id string, photo_id string, vector array<float>")
    monkeypatch.setattr(people, "SHARD", 20)
    sums = {}
    for r in people.cluster_faces(faces, 0.3).collect():
        sums[r.cluster] = sums.get(r.cluster, 0) + people.unit(np.array(r.vector))
    centres = people.unit(np.stack(list(sums.values())))
    d = people.distance(centres, centres) + 2 * np.eye(len(centres))
    assert 1 < len(sums) < 60 and d.min() > 0.3


def test_centroids_beyond_the_broadcast_go_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vectors, centres = rng.normal(size=(90, 6)), rng.normal(size=(25, 6))
    centres[7] = centres[3]  # of equals the first
    faces = spark.createDataFrame([(f"f{i}", v.tolist()) for i, v in enumerate(vectors)], "id string, vector array<float>")
    groups = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centres)], "group_id int, centroid array<double>")
    whole = {tuple(r) for r in people.assign(faces, groups, 0.5).withColumn("distance", F.round("distance", 9)).collect()}
    monkeypatch.setattr(people, "CENTROID_BYTES", 100)
    monkeypatch.setattr(products, "BLOCK_BYTES", 6 * 8 * 10)
    blocks = {tuple(r) for r in people.assign(faces, groups, 0.5).withColumn("distance", F.round("distance", 9)).collect()}
    assert whole == blocks and 10 < len(whole) < 90 and not any(g == 7 for _, g, _ in whole)
    assert people.assign(faces, groups.limit(0)).count() == 0 and people.assign(faces.limit(0), groups).count() == 0


def test_names_are_carried_once(spark):
    groups = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.99, 0.1]), (2, [0.0, 1.0])], "group_id int, centroid array<double>")
    old = spark.createDataFrame([("Ann", [1.0, 0.0]), ("Bob", [0.0, -1.0]), (None, [0.0, 1.0])], "name string, centroid array<double>")
    assert {r.group_id: r.name for r in people.carry_names(groups, old).collect()} == {0: "Ann", 1: None, 2: None}
    assert {r.group_id: r.name for r in people.carry_names(groups, old.limit(0)).collect()} == {0: None, 1: None, 2: None}


@pytest.mark.parametrize("seed", range(3))
def test_names_go_by_the_sequence_of_groups(spark, seed):
    rng = np.random.default_rng(seed)
    new, named = rng.normal(size=(14, 3)), [(f"n{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(9, 3)))]
    groups = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(new)], "group_id int, centroid array<double>")
    want, used = {}, set()
    for g, v in enumerate(new):
        near = sorted((1 - float(people.unit(v) @ people.unit(np.array(o))), n) for n, o in named if n not in used)
        want[g] = near[0][1] if near and near[0][0] <= 0.8 else None
        used.add(want[g])
    got = people.carry_names(groups, spark.createDataFrame(named, "name string, centroid array<double>"), 0.8).collect()
    assert {r.group_id: r.name for r in got} == want and None in want.values()


def test_regroup_reads_nobody_as_empty(spark):
    faces = spark.createDataFrame([("a#0", "a", [1.0, 0.0]), ("b#0", "b", [1.0, 0.01]), ("c#0", "c", [0.0, 1.0])], "id string, photo_id string, vector array<float>")
    assert {r.photo_id: r.people for r in people.regroup(faces, eps=0.5)[1].collect()} == {"a": [0], "b": [0], "c": []}


def test_plan_and_sink_track_each_chunk(spark, tmp_path):
    rows = [item(f"{i:02d}", dedup_key=f"k{i:02d}") for i in range(6)] + [item("x", dedup_key=None), item("y", is_owned=False), item("z", is_owned=None, dedup_key="z")]
    plan = decisions.plan(spark.createDataFrame(rows, ITEM).coalesce(1))
    one = decisions.summary(plan).first()
    assert (one.deletable, one.no_key, one.not_owned) == (7, 1, 1)
    calls = tmp_path / "calls"

    def sink(keys):
        with open(calls, "a") as f:
            f.write(",".join(keys) + "\n")
        if "k00" in keys and calls.read_text().count("k00") == 1:
            raise OSError("down")

    log = f"file:{tmp_path}/log"
    out = {r.id: (r.outcome, r.error) for r in decisions.run_sink(plan, sink, log, size=3).collect()}
    assert out == {f"{i:02d}": ("failed", "down") if i < 3 else ("done", None) for i in range(6)} | {"z": ("done", None)}
    outcomes = decisions.run_sink(plan, sink, log, size=3)  # a repeat sends what isn't done, and nothing else
    assert decisions.outcome_counts(outcomes).first().asDict() == {"requested": 7, "done": 7, "failed": 0, "unsent": 0, "errors": []}
    assert sorted(calls.read_text().split()) == ["k00,k01,k02"] * 2 + ["k03,k04,k05", "z"]

    def refuse(keys):
        raise PermissionError("auth")

    one = decisions.outcome_counts(decisions.run_sink(plan, refuse, f"file:{tmp_path}/other", size=3, writers=1)).first()
    assert (one.requested, one.done, one.unsent, one.errors) == (7, 0, 7 - one.failed, ["auth"]) and 0 < one.failed <= 3


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_are_refreshed(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**62, 12)

    def rows(ids):
        out = []
        for i in ids:
            r = np.random.default_rng(i)
            h = int(base[i % 12]) ^ (1 << int(r.integers(0, 60))) ^ (1 << int(r.integers(0, 60)))
            out.append((f"i{i:03d}", int(r.integers(0, 400)), False, (f"{h:016x}" if i % 17 else None, f"{h:016x}")))
        return out

    kind = "id string, ts long, is_video boolean, features struct<dhash:string,ahash:string>"
    old, new = rng.choice(200, 150, replace=False).tolist(), rng.choice(200, 150, replace=False).tolist()
    old, new = rows(old), rows(new)
    new = [(i, t + 37, v, f) if k % 20 == 0 else (i, t, v, (f[1][::-1], f[1])) if k % 20 == 1 else (i, t, v, f) for k, (i, t, v, f) in enumerate(new)]
    items = spark.createDataFrame(new, kind)
    want = duplicates.NearDuplicates.of(items, 5, 9)
    got = duplicates.NearDuplicates.of(spark.createDataFrame(old, kind), 5, 9).refreshed(items)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(got.pairs.select("a", "b", "rn_a", "rn_b")) == as_set(want.pairs.select("a", "b", "rn_a", "rn_b"))
    assert as_set(got.sets.select("root", "id", "rn")) == as_set(want.sets.select("root", "id", "rn")) and got.sets.count() > 20


def test_params():
    assert RunParams.migrate({"scanMaxPerPass": 500, "analyzeMaxPerPass": 200, "scanZoom": 1}).max_per_run == 200
    assert RunParams.migrate({"scanMaxPerPass": 500, "max_per_run": 0}).max_per_run == 0
    assert QueryParams(sort="nonsense", lens="x").sort == "suspicion" and QueryParams(lens="x").lens == "all"
    with pytest.raises(ValueError):
        QueryParams(enabled={"nope"})
    p = QueryParams().toggle_person(4)
    assert p.person_ids == (4,) and p.enabled == {"withPerson"} and p.toggle_person(4).enabled == frozenset()
    assert QueryParams(enabled={"withPerson"}).blocked(True)[0].enabled == frozenset()
    assert QueryParams(blur_min=0.1).reset("blur_min").blur_min == 0.6


def test_tile_facts(spark):
    rows = [item("a", size_bytes=2048, features={"face_score": 0.2, "skin_frac": 0.0}), item("b", is_video=True, duration=125, ts=None)]
    out = orders.tile_facts(LibraryQuery(spark.createDataFrame(rows, ITEM), QueryParams(enabled={"noFace", "longVideo"})).matches())
    assert {r.id: tuple(r)[1:] for r in out.collect()} == {"a": (["noFace"], "1 Jan 2023", "2.0 KB", None, "20%"), "b": (["longVideo"], "Unknown date", None, "2m05", None)}
