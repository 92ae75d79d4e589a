"""Scalars, kernels, detection, catalogue, listing and incremental runs."""

import datetime as dt
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.functions import kernels as K
from lumisift.functions import scalars as S
from lumisift.operators import detection as D
from lumisift.params import RunParams
from lumisift.plans import passes
from lumisift.plans.passes import page_json
from lumisift.sources import catalogue as C
from lumisift.sources import images
from lumisift.sources import pages as P
from lumisift.streaming import ingest


def ms(*a):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1000)


DATES = [
    ("Photo - Paysage - 12 mars 2023, 14:05", ms(2023, 3, 12, 14, 5), "day"),
    ("Photo - Portrait - Aug 3, 2021, 9:07:30 PM", ms(2021, 8, 3, 21, 7, 30), "day"),
    ("2020-02-30", ms(2020, 3, 1), "day"),
    ("le 31/12/1999", ms(1999, 12, 31), "day"),
    ("12/25/2020", ms(2020, 12, 25), "day"),
    ("IMG_ 20190704", ms(2019, 7, 4), "day"),
    ("1er août 2018", ms(2018, 8, 1), "day"),
    ("février 2017", ms(2017, 2, 1), "month"),
    ("Holiday 2015", ms(2015, 1, 1), "year"),
    ("3 May 2022 at 12:00 AM", ms(2022, 5, 3), "day"),
    ("Video - 0:32", None, None),
    ("", None, None),
    (None, None, None),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(DATES)], "i int, t string").withColumn("p", S.parse_date(F.col("t")))
    assert [(r.ts, r.precision) for r in df.orderBy("i").select("p.*").collect()] == [(a, b) for _, a, b in DATES]


def test_small_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    L = F.lit
    assert [one(S.parse_duration(L(t))) for t in ("Video - 1:05", "1:02:03", "at 10:30", None)] == [65, 3723, None, None]
    odd = {" 0:32\t": 32, "VIDÉO, 2:00": 120, "Durée:1:00:01": 3601, "videos 1:00": None, "length 1:2": None, "123:45": None, "1:00:00:00": None, "film 1:00": None, "": None}
    assert {t: one(S.parse_duration(L(t))) for t in odd} == odd
    assert [one(S.is_video_label(L(t))) for t in ("My Movie", "film.", "video_1", "vidéo", None)] == [True, True, False, True, False]
    assert [one(S.format_bytes(L(n))) for n in (0, 1023, 1024, 150 * 1024, 1536 * 1024)] == ["0 B", "1023 B", "1.0 KB", "150 KB", "1.5 MB"]
    assert [one(S.duration_text(L(n))) for n in (45, 120, 125)] == ["45s", "2 min", "2m05"]
    assert one(S.with_thumb_size(L("https://x/a=w1-h1-no?authuser=0"), 256)) == "https://x/a=w256-h256?authuser=0"
    assert one(S.with_thumb_size(L("https://x/a=b/c"), 9)) == "https://x/a=b/c=w9-h9"
    assert [one(S.is_image_host(L(u))) for u in ("https://lh3.googleusercontent.com/a", "http://lh5.google.com", "https://googleusercontent.com.evil.com/", "ftp://lh3.googleusercontent.com", None)] == [True, True, False, False, False]
    assert [one(S.account_of(L(p))) for p in ("/u/2/photo", "/x/u/2/", "/u/2")] == [2, None, None]
    assert [one(S.hamming(L("f" * 16), L(x))) for x in ("0" * 16, "f" * 15 + "e", None)] == [64, 1, 64]
    assert [one(S.round_up(L(x), 1)) for x in (0.25, -0.25, 2.34)] == [0.3, -0.2, 2.3]
    assert [one(S.screen_aspect(L(w), L(h))) for w, h in ((9, 16), (4, 3), (0, 5))] == [1.0, 0.0, 0.0]
    assert one(S.group_label(L(None).cast("string"), L(2))) == "Person 3"
    with pytest.raises(Exception, match="empty vector"):
        one(S.normalised(F.array().cast("array<double>")))


def _noise(n=64, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (n, n, 3)).astype(np.uint8)


def _smooth(n=160):
    x = np.linspace(0, 255, n)
    return np.repeat(((x[:, None] + x[None, :]) / 2)[..., None], 3, 2).astype(np.uint8)


def test_kernels_on_generated_rasters():
    noise, smooth = K.to_gray(_noise()), K.to_gray(_smooth())
    assert K.laplacian_variance(noise) > 1000 and K.laplacian_variance(smooth) < 5
    assert K.local_sharpness(noise) > 1000 and K.laplacian_variance(np.zeros((2, 9))) == 0
    two = np.zeros((32, 32))
    two[:16] = 255
    assert K.bimodality(two) > 0.9 and K.bimodality(np.full((8, 8), 7.0)) == 0
    assert K.flat_ratio(np.full((32, 32), 9.0)) == 1 and K.flat_ratio(noise) == 0
    stripes = np.zeros((64, 64))
    stripes[:, ::8] = 255
    assert K.axial_ratio(stripes) > 0.8 and K.band_uniformity(np.full((40, 9), 3.0), 0, 0.045) == 1
    lum = K.luminance(np.full((4, 4), 30.0))
    assert lum["lum_mean"] == 30 and lum["lum_p05"] == lum["lum_p95"] == 30 and lum["dark_frac"] == 1
    assert K.color(np.full((8, 8, 3), [200, 10, 10], np.uint8))["sat_mean"] == pytest.approx(0.95)
    assert K.ahash(np.full((16, 16), 5.0)) == "0" * 16 and len(K.dhash(noise)) == 16
    a, b = (int(K.dhash(K.to_gray(K.shrunk(_smooth(256), n))), 16) for n in (256, 176))
    assert (a ^ b).bit_count() <= 4
    assert K.resize_gray(np.arange(4.0).reshape(2, 2), 4, 4)[0].tolist() == [0, 0, 1, 1]


def test_regions_by_flood_fill():
    rng = np.random.default_rng(3)
    mask = rng.random((20, 30)) < 0.55
    seen, want = np.zeros_like(mask), []
    for y in range(20):
        for x in range(30):
            if mask[y, x] and not seen[y, x]:
                todo, area = [(y, x)], 0
                seen[y, x] = True
                while todo:
                    a, b = todo.pop()
                    area += 1
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < 20 and 0 <= d < 30 and mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
                want.append(area)
    assert [a for a, _, _ in K.regions(mask)] == want


def test_skin_face_finds_a_portrait_and_no_wall():
    img = np.full((120, 160, 3), (90, 120, 160), np.uint8)
    y, x = np.mgrid[:120, :160]
    img[((x - 80) / 24) ** 2 + ((y - 60) / 30) ** 2 <= 1] = (205, 150, 125)
    for cx, cy in ((71, 52), (89, 52), (80, 72)):
        img[cy - 3 : cy + 3, cx - 5 : cx + 5] = (50, 30, 30)
    found = K.skin_face(img)
    assert found["face_score"] > 0.5 and found["face_box"] is not None
    assert K.skin_face(np.full((64, 64, 3), (90, 120, 160), np.uint8)) == {"face_score": 0.0, "skin_frac": 0.0, "face_box": None}


def _png(path, rgb):
    h, w = rgb.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_measure_image_files(spark, tmp_path):
    img = _noise(96)
    _png(tmp_path / "a.png", img)
    (tmp_path / "b.png").write_bytes(b"nothing")
    rows = {r.id.rsplit("/", 1)[1]: r for r in K.features(K.measure(images.read_images(spark, str(tmp_path)))).collect()}
    want = K.measurements(img)
    assert rows["a.png"].dhash == want["dhash"] and rows["a.png"].lap_var == pytest.approx(want["lap_var"], abs=0.06)
    assert rows["a.png"].error is None and rows["b.png"].error and rows["b.png"].dhash is None
    assert images.looks_like_onnx(b"\x08" + bytes(2000), 2000) and not images.looks_like_onnx(b"<html" + bytes(2000)) and not images.looks_like_onnx(b"\x08" + bytes(2000), 9000)


def test_detection_geometry(spark):
    boxes, scores = np.array([[0, 0, 0.5, 0.5], [0.01, 0, 0.5, 0.5], [0.6, 0.6, 0.9, 0.9]]), np.array([0.9, 0.95, 0.7])
    assert D.suppress(boxes, scores) == [1, 2] and D.suppress(boxes, scores, most=1) == [1]
    b, s = D.decode([0.1, 0.9, 0.5, 0.5, 0.2, 0.8], [-1, 0, 0.5, 0.5, 0, 0, 1, 1, 0.3, 0.3, 0.301, 0.9])
    assert b.tolist() == [[0, 0, 0.5, 0.5]] and s.tolist() == [0.9]
    tensor, pad = D.input_tensor(_noise(100))
    assert tensor.shape == (3, 240, 320) and (pad["ox"], pad["oy"]) == (40, 0) and not tensor[:, :, :40].any()
    assert np.allclose(D.unpad(np.array([[40 / 320, 0, 280 / 320, 1]]), pad), [[0, 0, 1, 1]])
    assert D.face_tensor(np.full((112, 112, 3), 255, np.uint8)).max() == 1
    box = F.array(*[F.lit(x) for x in (0.0, 0.0, 0.5, 0.5)])
    r = spark.range(1).select(D.crop_rect(box, F.lit(100), F.lit(100)).alias("r")).first().r
    assert (r.left, r.top, r.side, r.sx, r.sw, r.dx) == (-6, -6, 63, 0, 57, 6)
    raw = spark.createDataFrame([("p", [0.1, 0.9, 0.2, 0.8], [0.0, 0.0, 0.5, 0.5, 0.5, 0.5, 1.0, 1.0])], "photo_id string, scores array<double>, boxes array<double>")
    one = D.summarise(D.decode_detections(raw)).first()
    assert (one.face_score, one.face_count, one.face_box, one.face_area) == (0.9, 2, [0, 0, 0.5, 0.5], 0.5)


def test_reading_photos_is_all_or_nothing(spark):
    img = bytearray(100 * 100 * 3)
    photos = spark.createDataFrame([("a", 100, 100, 3, img), ("b", 100, 100, 3, img), ("c", 100, 100, 3, bytearray(5))], "id string, width int, height int, channels int, data binary")
    detect = lambda rgb: (np.array([[0, 0, 0.5, 0.5], [0, 0, 0.1, 0.1]]), np.array([0.9, 0.9]))
    rows = D.read_photos(photos, detect, lambda rgb, box: np.ones(4)).collect()
    assert {(r.photo_id, r.ok, r.id, r.skipped) for r in rows} == {("a", True, "a#0", 1), ("b", True, "b#0", 1), ("c", False, None, 0)}
    assert not any(r.ok for r in D.read_photos(photos, detect, lambda rgb, box: None).collect())


def _item(key, ts, thumb="https://lh3.googleusercontent.com/x", video=False, **over):
    options = {"163238866": [True]} | ({P.DURATION: [61_400]} if video else {})
    return [key, [thumb, 640, 480] if thumb else None, ts, over.get("dedup", "d"), 0, ts, None, over.get("owners", [[1]]), None, None, None, None, None, over.get("archived", False), options]


def test_wire_format(spark):
    page = page_json([_item("a", 5, video=True), _item("b", "7", thumb=None, owners=[[3, 27]]), [], None, "junk", [None], _item("c", None, archived=True)], "next", 4)
    df = spark.createDataFrame([(page,), ("not json",)], "value string")
    rows = {r.media_key: r for r in P.parse_items(df).collect()}
    assert rows.keys() == {"a", "b", "c"}
    assert rows["a"].is_video and rows["a"].duration == 61 and rows["a"].is_favourite and rows["a"].is_owned
    assert rows["b"].timestamp == 7 and rows["b"].thumb is None and not rows["b"].is_owned
    assert rows["c"].timestamp is None and rows["c"].is_archived and not rows["c"].is_video
    assert [tuple(r) for r in P.parse_page(df).collect()] == [("next", 4), (None, None)]
    info = '[[null,[["a",[null,null,null,"f.jpg",null,null,5,null,null,900,[1,450,2]]],["b",[null]],[]]]]'
    got = {r.id: r for r in P.parse_media_info(spark.createDataFrame([(info,)], "value string")).collect()}
    assert (got["a"].file_name, got["a"].size_bytes, got["a"].takes_up_space, got["a"].space_taken, got["a"].is_original_quality) == ("f.jpg", 900, True, 450, True)
    assert got.keys() == {"a", "b"} and got["b"].size_bytes is None


def _taken(spark, folder, checkpoint):
    """The rows of a stream of listing files, and its pages in order."""
    out = []

    def look(batch, _):
        out.append((batch.collect(), [r.value for r in P.page_lines(batch).orderBy("page").collect()]))

    P.read_pages(spark, str(folder)).writeStream.foreachBatch(look).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return [r for rows, _ in out for r in rows], [v for _, values in out for v in values]


def test_a_large_listing_file_is_read_by_lines_in_blocks(spark, tmp_path):
    folder, size = tmp_path / "pages", spark.conf.get("spark.sql.files.maxPartitionBytes")
    folder.mkdir()
    pages = [page_json([_item(f"i{p}-{k}", 1000 - p) for k in range(1 + p % 3)]) for p in range(70)]
    (folder / "1.jsonl").write_text("\n".join(pages[:60]) + "\n\n")
    (folder / "2.jsonl").write_text("\r\n".join(pages[60:]) + "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows, values = _taken(spark, folder, tmp_path / "cp")
        cat = C.Catalogue(spark, f"file:{tmp_path}/cat")
        s = ingest.list_pages(spark, str(folder), cat, RunParams(max_per_run=100), str(tmp_path / "cp2"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert max(len(r.value) for r in rows) <= max(map(len, pages)) + 1  # no row holds a file
    assert len({(r.file, r.start) for r in rows}) > 5
    assert [v.strip() for v in values] == pages
    order = [i[0] for p in pages for i in json.loads(p)[0]]
    assert (s.pages, s.discovered) == (70, 100) and {r.id for r in cat.ids().collect()} == set(order[:100])


def test_listing_files_hold_a_bounded_number_of_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(passes, "PAGES_A_FILE", 3)
    passes._write_pages(spark.range(40).select(F.col("id").alias("page"), F.format_string("%03d", "id").alias("value")).repartition(4), f"{tmp_path}/pages")
    files = [f.read_text().split() for f in sorted((tmp_path / "pages").glob("part-*"))]
    assert max(map(len, files)) <= 3 and [v for f in files for v in f] == [f"{k:03d}" for k in range(40)]


def test_plan_start_and_retries():
    c = P.Cursor(last_timestamp=9, page_id="p")
    assert P.plan_start(c, resume=False).reason == "no-resume" and P.plan_start(None).reason == "first-run"
    assert P.plan_start(c, 5) == P.Start(5, None, "window-changed") and P.plan_start(P.Cursor(reached_end=True)).reason == "completed"
    assert P.plan_start(P.Cursor()).reason == "no-position" and P.plan_start(c) == P.Start(9, "p", "resume")
    assert P.Cursor.from_json(c.to_json()) == c
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise P.ListingError("network")
        return 7

    assert P.with_retries(flaky, sleep=waits.append) == 7 and waits == [0.6, 1.2]
    for kind, refresh, n in (("shape", None, 1), ("auth", None, 1), ("auth", lambda: None, 2), ("http", None, 5)):
        calls.clear()

        def fail(kind=kind):
            calls.append(1)
            raise P.ListingError(kind)

        with pytest.raises(P.ListingError):
            P.with_retries(fail, refresh, sleep=lambda _: None)
        assert len(calls) == n


def test_listing_and_passes_are_incremental(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "1.jsonl").write_text(page_json([_item("a", 50), _item("b", 40, thumb=None), _item("z", 99)], "n") + "\n" + page_json([_item("c", 30), _item("a", 50)], None) + "\n")
    cat = C.Catalogue(spark, f"file:{tmp_path}/cat")
    run = RunParams(older_than=90)
    s = ingest.list_pages(spark, str(folder), cat, run, str(tmp_path / "cp"), batch_files=1)
    assert (s.pages, s.discovered, s.already_known, s.skipped_recent, s.skipped_no_thumb) == (2, 2, 1, 1, 1)
    assert {r.id for r in cat.ids().collect()} == {"a", "c"} and cat.get_meta("progress") == {"oldest": 30}
    (folder / "2.jsonl").write_text(page_json([_item("d", 20)]) + "\n")
    assert ingest.list_pages(spark, str(folder), cat, run, str(tmp_path / "cp")).discovered == 1
    assert ingest.list_pages(spark, str(folder), cat, run, str(tmp_path / "cp2")).discovered == 0
    assert cat.note_progress(500) == 20
    features = F.struct(*[F.lit(0.9 if n == "face_score" else None).cast(t).alias(n) for n, t in (x.strip().split(": ") for x in "face_score: double, screenshot_score: double, document_score: double, blur_score: double, dark_score: double, bright_score: double, face_method: string, skin_frac: double, lap_var: double, nat_w: int, nat_h: int, dhash: string, ahash: string".split(","))])
    kernel = lambda todo: todo.select("id", features.alias("features"), F.when(F.col("id") == "c", "decode").alias("error"))
    assert ingest.analyse_pending(cat, kernel) == {"tried": 3, "failed": 1}
    assert {r.id: (r.analyzed, r.analysis_error) for r in cat.read("items").collect()} == {"a": (True, None), "c": (False, "decode"), "d": (True, None)}
    faces = lambda todo: todo.select(F.concat("id", F.lit("#0")).alias("id"), F.col("id").alias("photo_id"), F.lit(True).alias("ok"), F.array(F.lit(0.0)).alias("box"), F.lit(0.9).alias("score"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vector"))
    assert ingest.scan_faces(cat, faces) == {"read": 2} and ingest.scan_faces(cat, faces) == {"read": 0}
    assert ingest.regroup(cat).first()["size"] == 2
    assert {r.id: r.people for r in cat.read("items").collect()} == {"a": [0], "c": None, "d": [0]}
    cat.clear()
    assert cat.counts() == {"items": 0, "faces": 0} and cat.get_meta("progress") == {"oldest": 20}


def test_metadata_is_fetched_in_chunks_with_retries(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(7)], "id string").coalesce(1)

    def fetch(some):
        if "k3" in some:
            raise P.ListingError("shape")
        return [json.dumps(some)]

    assert sorted(x for r in P.fetch_info(keys, fetch, size=2).collect() for x in json.loads(r.value)) == ["k0", "k1", "k4", "k5", "k6"]


def test_a_stopped_pass_keeps_what_is_written(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "1.jsonl").write_text(page_json([_item(f"i{k}", 90 - k) for k in range(12)]) + "\n")
    cat = C.Catalogue(spark, f"file:{tmp_path}/cat")
    ingest.list_pages(spark, str(folder), cat, RunParams(), str(tmp_path / "cp"))
    features, calls = cat.read("items").schema["features"].dataType, []

    def kernel(todo):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return todo.select("id", F.lit(None).cast(features).alias("features"), F.lit(None).cast("string").alias("error"))

    with pytest.raises(RuntimeError):
        ingest.analyse_pending(cat, kernel, size=5)
    first = cat.read("items").filter("analyzed").count()
    assert 0 < first < 12
    assert ingest.analyse_pending(cat, kernel, size=5) == {"tried": 12 - first, "failed": 0}


def test_run_limit_counts_new_items(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "1.jsonl").write_text(page_json([_item(f"i{k}", 90 - k) for k in range(9)]) + "\n")
    cat = C.Catalogue(spark, f"file:{tmp_path}/cat")
    s = ingest.list_pages(spark, str(folder), cat, RunParams(max_per_run=4), str(tmp_path / "cp"))
    assert s.discovered == 4 and s.limit_reached and {r.id for r in cat.ids().collect()} == {"i0", "i1", "i2", "i3"}


def test_limited_runs_on_one_checkpoint_end_with_all_rows(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "1.jsonl").write_text(page_json([_item(f"i{k}", 90 - k) for k in range(5)]) + "\n" + page_json([_item(f"i{k}", 90 - k) for k in range(5, 9)]) + "\n")
    cat = C.Catalogue(spark, f"file:{tmp_path}/cat")
    run = lambda: ingest.list_pages(spark, str(folder), cat, RunParams(max_per_run=4), str(tmp_path / "cp"))
    first, second = run(), run()
    assert first.discovered == second.discovered == 4 and {r.id for r in cat.ids().collect()} == {f"i{k}" for k in range(8)}
    third = run()
    assert third.discovered == 1 and not third.limit_reached and {r.id for r in cat.ids().collect()} == {f"i{k}" for k in range(9)}
    assert run().discovered == 0 and cat.read("pending").count() == 0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x", True), ("b", None, "y", False)], "id string, ts long, label string, analyzed boolean")
    batch = spark.createDataFrame([("a", None, "new", None), ("c", 5, None, None)], "id string, ts long, label string, analyzed boolean")
    once = C.upsert_items(old, batch).drop("added", "touched")
    assert {tuple(r) for r in once.collect()} == {("a", 1, "new", True), ("b", None, "y", False), ("c", 5, None, False)}
    assert {tuple(r) for r in C.upsert_items(once, batch).drop("added", "touched").collect()} == {tuple(r) for r in once.collect()}
    assert {tuple(r) for r in C.upsert_items(once, batch.select("id")).drop("added", "touched").collect()} == {tuple(r) for r in once.collect()}


def test_detector_tiers(spark):
    measured = spark.createDataFrame([("a", 0.4, 0, None, 0.0, "heuristic", 0.3), ("b", 0.6, 1, None, 0.0, "heuristic", 0.2)], "id string, face_score double, face_count int, face_box array<double>, face_area double, face_method string, skin_frac double")
    found = spark.createDataFrame([("a", 0.9, 2, [0.0, 0.0, 0.5, 0.5], 0.25)], "photo_id string, face_score double, face_count int, face_box array<double>, face_area double")
    got = {r.id: (r.face_score, r.face_count, r.face_method, r.skin_frac) for r in K.with_detections(measured, found).collect()}
    assert got == {"a": (0.9, 2, "ultraface", 0.0), "b": (0.6, 1, "heuristic", 0.2)}


def test_full_run(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "1.jsonl").write_text(page_json([_item("a", 50), _item("b", 40)]) + "\n")
    cat = C.Catalogue(spark, f"file:{tmp_path}/cat")
    info = spark.createDataFrame([("a", "f.jpg", 9, 8, True, True)], "id string, file_name string, size_bytes long, space_taken long, takes_up_space boolean, is_original_quality boolean")
    out = ingest.full_run(spark, str(folder), cat, RunParams(), str(tmp_path / "cp"), info=info)
    assert out["listing"].discovered == 2
    assert {r.id: (r.size_bytes, r.label) for r in cat.read("items").collect()} == {"a": (9, "f.jpg"), "b": (None, None)}
    cat.export_json(f"file:{tmp_path}/out", {"sort": "newest"})
    assert spark.read.json(f"file:{tmp_path}/out/items").count() == 2
