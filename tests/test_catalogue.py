"""The versioned catalogue: parts, conflicts and crashes; passes that follow it; stops."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from lumisift import schema
from lumisift.params import RunParams
from lumisift.plans.passes import page_json
from lumisift.sources import catalogue as C
from lumisift.sources import listing
from lumisift.sources import pages as P
from lumisift.streaming import ingest


def page_item(k: int, ts: int):
    return [f"i{k}", ["https://lh3.googleusercontent.com/x", 10, 10], ts, f"d{k}", 0, ts, None, [[1]], None, None, None, None, None, False, {}]


def write_pages(folder, pages, per_page=4, first=0):
    for p in range(first, first + pages):
        (folder / f"{p:03d}.jsonl").write_text(page_json([page_item(p * per_page + k, 1000 - p * per_page - k) for k in range(per_page)]) + "\n")


def rows_of(spark, ids, label="x"):
    return spark.createDataFrame([(i, label) for i in ids], "id string, label string")


@pytest.fixture
def cat(spark, tmp_path):
    return C.Catalogue(spark, f"file:{tmp_path}/cat", parts=64)


@pytest.fixture
def kernel(cat):
    kind = cat.read("items").schema["features"].dataType.simpleString()
    fields = [f.strip().split(":") for f in kind[len("struct<") : -1].split(",")]
    good = F.struct(*[F.lit(0.9 if n == "face_score" else None).cast(t).alias(n) for n, t in fields])

    def run(todo):
        return todo.select("id", good.alias("features"), F.when(F.col("id") == "i5", "decode").alias("error"))

    return run


def detect(todo):
    one = F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")
    return todo.select(F.concat("id", F.lit("#0")).alias("id"), F.col("id").alias("photo_id"), F.lit(True).alias("ok"), F.array(F.lit(0.0)).alias("box"), F.lit(0.9).alias("score"), one.alias("vector"))


def files(cat):
    return cat._state("items")[1]["files"]


def test_a_batch_rewrites_its_parts_only(spark, cat):
    cat.upsert(rows_of(spark, [f"{i}" for i in range(3000)]))
    before = files(cat)
    assert len(before) == 64
    batch = rows_of(spark, ["7", "8", "new"], "y")
    cat.upsert(batch)
    after = files(cat)
    touched = {p for p in after if after[p] != before.get(p)}
    assert touched == set(cat._parts_of(batch, 64)) and len(touched) <= 3
    got = {r.id: r.label for r in cat.read("items").collect()}
    assert len(got) == 3001 and {i for i, l in got.items() if l == "y"} == {"7", "8", "new"}
    assert cat.read_near("items", batch).count() < 500


def test_old_versions_go_and_kept_ones_stay_readable(spark, tmp_path):
    cat = C.Catalogue(spark, f"file:{tmp_path}/cat", parts=2, keep=3)
    cat.upsert(rows_of(spark, ["a", "b", "c", "d"]))
    early = cat.read("items")
    for k in range(2):
        cat.upsert(rows_of(spark, ["a", "b", "c", "d"], f"v{k}"))
    assert {r.label for r in early.collect()} == {"x"}
    for k in range(4):
        cat.upsert(rows_of(spark, ["a", "b", "c", "d"], f"w{k}"))
    names = cat._names()
    assert len([n for n in names if n.startswith("items.v")]) == 3
    data = [n for n in names if n.startswith("items-") and any(x.startswith("_part=") for x in cat._names(n))]
    assert len(data) <= 4 and {r.label for r in cat.read("items").collect()} == {"w3"}


def test_a_crash_leaves_the_old_version(spark, cat, monkeypatch):
    cat.upsert(rows_of(spark, ["a", "b"]))
    version, before = cat.version("items"), files(cat)

    def crash(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(cat, "_publish", crash)  # all is written, nothing is published
        cat.upsert(rows_of(spark, ["a", "c"], "y"))
    assert cat.version("items") == version and files(cat) == before
    assert {r.id: r.label for r in cat.read("items").collect()} == {"a": "x", "b": "x"}
    cat.upsert(rows_of(spark, ["a", "c"], "y"))
    assert {r.id: r.label for r in cat.read("items").collect()} == {"a": "y", "b": "x", "c": "y"}


@pytest.mark.parametrize("parts", [1, 64])
def test_writers_come_one_on_top_of_the_other(spark, tmp_path, parts):
    cat, other = (C.Catalogue(spark, f"file:{tmp_path}/cat", parts=parts) for _ in range(2))
    cat.upsert(rows_of(spark, ["a"]))
    merged = []

    def slow(old):
        if not merged:
            other.upsert(rows_of(spark, ["b"], "second"))  # between reading and publishing
        merged.append(1)
        return C.upsert_items(old, rows_of(spark, ["a"], "first")).select(old.columns)

    cat.change("items", rows_of(spark, ["a"]), slow)
    assert {r.id: r.label for r in cat.read("items").collect()} == {"a": "first", "b": "second"}
    assert len(merged) == (2 if parts == 1 else 1)  # anew only where both touched one part


def test_parallel_writers_lose_nothing(spark, tmp_path):
    cat = C.Catalogue(spark, f"file:{tmp_path}/cat", parts=2)
    threads = [threading.Thread(target=lambda k=k: [cat.upsert(rows_of(spark, [f"{k}-{n}"])) for n in range(3)]) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {r.id for r in cat.ids().collect()} == {f"{k}-{n}" for k in range(3) for n in range(3)}


def test_marks_deletions_meta_and_layout(spark, cat):
    cat.upsert(rows_of(spark, ["a", "b", "c"]))
    faces = spark.createDataFrame([("a#0", "a", [0.0], 0.9, [1.0]), ("b#0", "b", [0.0], 0.9, [1.0])], schema.FACE)
    cat.save_faces(faces, spark.createDataFrame([("a",), ("b",)], "photo_id string"))
    cat.mark_kept(rows_of(spark, ["a"]), True, 5)
    cat.mark_ids(rows_of(spark, ["b"]), {"is_archived": True})
    rows = {r.id: r for r in cat.read("items").collect()}
    assert (rows["a"].kept, rows["a"].kept_at, rows["b"].is_archived, rows["c"].is_archived) == (True, 5, True, None)
    assert rows["a"].people == [] and rows["a"].people_scanned and rows["c"].people is None
    cat.delete(rows_of(spark, ["b"]))
    assert cat.counts() == {"items": 2, "faces": 1}
    cat.deal_anew("items", 3)
    assert cat._state("items")[1]["parts"] == 3 and cat.counts()["items"] == 2
    assert {r.id for r in C.clear_kept(cat.read("items")).filter("kept is null").collect()} == {"a", "c"}
    assert cat.get_meta("named") is None and cat.get_meta("named", 3) == 3
    cat.set_meta("named", [{"name": "Ann"}])
    assert cat.get_meta("named") == [{"name": "Ann"}]


def test_a_follower_sees_what_is_listed_later_and_repeats_nothing(spark, tmp_path, cat, kernel):
    folder = tmp_path / "pages"
    folder.mkdir()
    tried = []

    def counting(todo):
        tried.extend(r.id for r in todo.select("id").collect())
        return kernel(todo)

    query = ingest.follow_analysis(cat, counting, str(tmp_path / "follow"))  # nothing is listed yet
    write_pages(folder, 2)
    ingest.list_pages(spark, str(folder), cat, RunParams(), str(tmp_path / "cp"), batch_files=1)
    query.processAllAvailable()
    query.stop()
    assert sorted(tried) == sorted(f"i{k}" for k in range(8))
    assert {r.id for r in cat.read("items").filter("analyzed").collect()} == {f"i{k}" for k in range(8)} - {"i5"}
    write_pages(folder, 1, first=2)
    ingest.list_pages(spark, str(folder), cat, RunParams(), str(tmp_path / "cp"))
    query = ingest.follow_analysis(cat, counting, str(tmp_path / "follow"))
    query.processAllAvailable()
    query.stop()
    assert sorted(tried) == sorted(f"i{k}" for k in range(12))  # also what failed isn't tried again


def test_passes_side_by_side_end_like_passes_in_turn(spark, tmp_path, cat, kernel):
    folder = tmp_path / "pages"
    folder.mkdir()
    write_pages(folder, 6)
    first, listed = [], []

    def noting(todo):
        first.append(time.time())
        return kernel(todo)

    run = RunParams()
    upsert = cat.upsert
    cat.upsert = lambda batch: (upsert(batch), listed.append(time.time()), time.sleep(1.5))[0]
    out = ingest.full_run(spark, str(folder), cat, run, str(tmp_path / "cp"), noting, detect, batch_files=1)
    assert out["listing"].discovered == 24 and out["analysis"] == {"analysed": 23, "failed": 1} and out["faces"] == {"read": 23}
    assert first[0] < listed[-1]  # they overlap
    plain = C.Catalogue(spark, f"file:{tmp_path}/plain")
    ingest.list_pages(spark, str(folder), plain, run, str(tmp_path / "cp2"))
    ingest.analyse_pending(plain, kernel)
    ingest.scan_faces(plain, detect)
    ingest.regroup(plain, run.eps)
    key = lambda c: {tuple(map(str, r)) for r in c.read("items").collect()}
    assert key(cat) == key(plain)


@pytest.mark.parametrize("parts, size", [(64, 30), (3, 30)])
def test_each_slice_rewrites_its_own_parts_only(spark, tmp_path, kernel, parts, size):
    cat = C.Catalogue(spark, f"file:{tmp_path}/of{parts}", parts=parts)
    cat.upsert(rows_of(spark, [f"i{k}" for k in range(200)]).withColumn("url", F.lit("u")))
    slices, touched, apply = [], [], cat._apply

    def noting(table, near, merge):
        touched.append((table, set(near(cat._state(table)[1]))))
        return apply(table, near, merge)

    def work(todo):
        slices.append({r.id for r in todo.select("id").collect()})
        return kernel(todo)

    cat._apply = noting
    assert ingest.analyse_pending(cat, work, size=size) == {"tried": 200, "failed": 1}
    assert sum(map(len, slices)) == 200 and set().union(*slices) == {f"i{k}" for k in range(200)}
    assert max(map(len, slices)) <= (size if parts == 64 else 1.7 * size)  # shares of a part are about as large
    times = [sum(p in t for _, t in touched) for p in range(parts)]
    assert max(times) == (1 if parts == 64 else 3) and len(touched) == len(slices) > 5
    touched.clear()
    assert ingest.scan_faces(cat, detect, size=size) == {"read": 199} and cat.counts() == {"items": 200, "faces": 199}
    assert max(sum(p in t for table, t in touched if table == "items") for p in range(parts)) == max(times)


def test_faces_of_a_slice_go_to_its_own_parts(spark, cat, kernel):
    cat.upsert(rows_of(spark, [f"i{k}" for k in range(100)]).withColumn("url", F.lit("u")))
    ingest.analyse_pending(cat, kernel)
    touched, apply = [], cat._apply

    def noting(table, near, merge):
        touched.append((table, tuple(near(cat._state(table)[1]))))
        return apply(table, near, merge)

    cat._apply = noting
    assert ingest.scan_faces(cat, detect, size=40) == {"read": 99} and cat.counts() == {"items": 100, "faces": 99}
    for table in ("faces", "items"):
        parts = [p for t, ps in touched if t == table for p in ps]
        assert len(parts) == len(set(parts)) > 40  # each once, in one slice
    assert [ps for t, ps in touched if t == "faces"] == [ps for t, ps in touched if t == "items"]


def test_a_stop_in_a_slice_keeps_earlier_slices(spark, tmp_path, cat, kernel):
    cat.upsert(rows_of(spark, [f"i{k}" for k in range(40)]).withColumn("url", F.lit("u")))
    abort, calls = ingest.Abort(spark), []

    def slow(todo):
        calls.append(1)
        if len(calls) < 3:
            return kernel(todo)
        threading.Timer(2, abort.stop).start()

        def wait(frames):
            time.sleep(200)
            yield from frames

        return kernel(todo).mapInPandas(wait, kernel(todo).schema)

    began = time.time()
    out = ingest.analyse_pending(cat, slow, size=10, abort=abort)
    assert out["stopped"] and time.time() - began < 100 and len(calls) == 3
    done = cat.read("items").filter("analyzed or analysis_error is not null").count()
    assert 0 < done == out["tried"] < 40
    assert ingest.analyse_pending(cat, kernel, size=10, abort=abort) == {"tried": 0, "failed": 0, "stopped": True}
    assert ingest.analyse_pending(cat, kernel, size=10)["tried"] >= 40 - done


def test_a_stopped_run_goes_on_later(spark, tmp_path, cat, kernel):
    folder = tmp_path / "pages"
    folder.mkdir()
    write_pages(folder, 5)
    abort, upsert = ingest.Abort(spark), cat.upsert

    def stopping(batch):
        upsert(batch)
        abort._set.set()

    cat.upsert = stopping
    out = ingest.full_run(spark, str(folder), cat, RunParams(), str(tmp_path / "cp"), kernel, detect, abort=abort, batch_files=1)
    assert out["stopped"] and out["listing"].discovered == 4 and cat.counts()["items"] == 4
    cat.upsert = upsert
    again = ingest.full_run(spark, str(folder), cat, RunParams(), str(tmp_path / "cp"), kernel, detect, batch_files=1)
    assert cat.counts() == {"items": 20, "faces": 19} and again["analysis"] == {"analysed": 19, "failed": 1}


def marking_client(folder, marks, fails=0):
    """Leaves a mark for every fetch, and fails the first ones of a page. Its class is sent to tasks with it."""

    class Marking(listing.FolderClient):
        def fetch(self, token):
            with open(f"{marks}/{token}", "a") as f:
                f.write("x")
            with open(f"{marks}/{token}") as f:
                tries = len(f.read())
            if tries <= fails:
                raise P.ListingError("network", f"try {tries}")
            return listing.FolderClient.fetch(self, token)

    folder, marks = str(folder), str(marks)
    return Marking(folder)


def test_pages_within_the_window_left_out_are_not_fetched(spark, tmp_path, cat):
    folder, marks = tmp_path / "pages", tmp_path / "marks"
    folder.mkdir(), marks.mkdir()
    for p in range(6):  # from new to old; a page reaches from 1000 - 4p down to 997 - 4p
        (folder / f"{p:03d}-{997 - 4 * p}.jsonl").write_text(page_json([page_item(p * 4 + k, 1000 - p * 4 - k) for k in range(4)]) + "\n")
    pages = listing.stream_pages(spark, marking_client(folder, marks), older_than=990, per_task=2)
    s = ingest.list_pages(spark, None, cat, RunParams(older_than=990), str(tmp_path / "cp"), pages=pages)
    assert sorted(m.name for m in marks.iterdir()) == [f"{p:03d}-{997 - 4 * p}.jsonl" for p in range(2, 6)]
    assert (s.pages, s.skipped_recent, s.discovered) == (4, 3, 13)
    (folder / "006-973.jsonl").write_text(page_json([page_item(24, 973)]) + "\n")
    pages = listing.stream_pages(spark, marking_client(folder, marks), older_than=990)
    assert ingest.list_pages(spark, None, cat, RunParams(older_than=990), str(tmp_path / "cp"), pages=pages).discovered == 1
    assert all(m.read_text() == "x" for m in marks.iterdir())  # each once


def test_a_flaky_page_is_fetched_within_its_tries(spark, tmp_path, cat):
    folder, marks = tmp_path / "pages", tmp_path / "marks"
    folder.mkdir(), marks.mkdir()
    write_pages(folder, 2)
    pages = listing.stream_pages(spark, marking_client(folder, marks, fails=3), wait=0.01)
    assert ingest.list_pages(spark, None, cat, RunParams(), str(tmp_path / "cp"), pages=pages).discovered == 8
    assert {m.read_text() for m in marks.iterdir()} == {"xxxx"}
