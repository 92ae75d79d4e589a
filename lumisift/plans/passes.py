"""Driver queries of the scalar functions, image passes, catalogue merges and incremental listing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from lumisift import schema
from lumisift.functions import kernels, scalars, scores
from lumisift.operators import detection, stats
from lumisift.operators.orders import shared_folder
from lumisift.plans import adapters
from lumisift.plans.adapters import FACES_SQL, ITEMS_SQL
from lumisift.plans.library import query
from lumisift.sources import catalogue as C
from lumisift.sources import pages as P

# dates and durations in labels made from events

_LABEL_SQL = """
labels_ AS (
  SELECT event_id, date_add(DATE '2001-01-01', INTERVAL (event_id * 37 % 8000) DAY) AS d, event_id % 24 AS h, event_id % 60 AS mi, event_id % 8 AS form FROM events
), texts AS (
  SELECT *, CASE form WHEN 0 THEN 'Photo - ' || strftime(d, '%Y-%m-%d') WHEN 1 THEN 'Photo - ' || day(d) || ' ' || strftime(d, '%B %Y') || ', ' || h || ':' || printf('%02d', mi)
    WHEN 2 THEN strftime(d, '%B') || ' ' || day(d) || ', ' || year(d) WHEN 3 THEN 'le ' || printf('%02d/%02d/%d', day(d), month(d), year(d)) WHEN 4 THEN 'IMG ' || strftime(d, '%Y%m%d') || ' x'
    WHEN 5 THEN strftime(d, '%B %Y') WHEN 6 THEN 'Summer ' || year(d) ELSE 'Video - ' || h || ':' || printf('%02d', mi) END AS text
  FROM labels_
)"""


def _texts(spark, d):
    e = adapters.table(spark, d, "events").select("event_id", F.date_add(F.lit("2001-01-01").cast("date"), (F.col("event_id") * 37 % 8000).cast("int")).alias("d"), (F.col("event_id") % 24).alias("h"), (F.col("event_id") % 60).alias("mi"), (F.col("event_id") % 8).alias("form"))
    day, year = F.dayofmonth("d").cast("string"), F.year("d").cast("string")
    clock = F.concat(F.col("h").cast("string"), F.lit(":"), F.lpad(F.col("mi").cast("string"), 2, "0"))
    text = (
        F.when(F.col("form") == 0, F.concat(F.lit("Photo - "), F.date_format("d", "yyyy-MM-dd")))
        .when(F.col("form") == 1, F.concat(F.lit("Photo - "), day, F.lit(" "), F.date_format("d", "MMMM yyyy"), F.lit(", "), clock))
        .when(F.col("form") == 2, F.concat(F.date_format("d", "MMMM"), F.lit(" "), day, F.lit(", "), year))
        .when(F.col("form") == 3, F.concat(F.lit("le "), F.date_format("d", "dd/MM/yyyy")))
        .when(F.col("form") == 4, F.concat(F.lit("IMG "), F.date_format("d", "yyyyMMdd"), F.lit(" x")))
        .when(F.col("form") == 5, F.date_format("d", "MMMM yyyy"))
        .when(F.col("form") == 6, F.concat(F.lit("Summer "), year))
        .otherwise(F.concat(F.lit("Video - "), clock))
    )
    return e.withColumn("text", text)


@query(
    "parse_dates",
    """
SELECT event_id, text, epoch_ms(CAST(CASE WHEN form = 1 THEN CAST(d AS TIMESTAMP) + INTERVAL (h * 60 + mi) MINUTE WHEN form = 5 THEN CAST(date_trunc('month', d) AS TIMESTAMP) WHEN form = 6 THEN CAST(date_trunc('year', d) AS TIMESTAMP) WHEN form < 5 THEN CAST(d AS TIMESTAMP) END AS TIMESTAMP)) AS ts,
  CASE WHEN form < 5 THEN 'day' WHEN form = 5 THEN 'month' WHEN form = 6 THEN 'year' END AS "precision"
FROM texts""",
    _LABEL_SQL,
)
def parse_dates(spark, d):
    return _texts(spark, d).withColumn("p", scalars.parse_date(F.col("text"))).select("event_id", "text", "p.ts", "p.precision")


@query("parse_durations", "SELECT event_id, CASE WHEN form = 7 THEN CAST(h * 60 + mi AS BIGINT) END AS seconds, form = 7 AS is_video FROM texts", _LABEL_SQL)
def parse_durations(spark, d):
    t = _texts(spark, d)
    return t.select("event_id", scalars.parse_duration(F.col("text")).alias("seconds"), scalars.is_video_label(F.col("text")).alias("is_video"))


@query("calendar_keys", "SELECT id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, strftime(make_timestamp(ts * 1000), '%Y-%m') AS month, strftime(make_timestamp(ts * 1000), '%Y') AS year, CASE WHEN ts IS NULL THEN 'Unknown date' ELSE day(make_timestamp(ts * 1000)) || strftime(make_timestamp(ts * 1000), ' %b %Y') END AS text FROM items", ITEMS_SQL)
def calendar_keys(spark, d):
    ts = F.col("ts")
    return adapters.items(spark, d).select("id", scalars.day_key(ts).alias("day"), scalars.month_key(ts).alias("month"), scalars.year_key(ts).alias("year"), scalars.format_date(ts, F.lit("day")).alias("text"))


_THUMB = "regexp_replace(split_part({u}, '?', 1), '=[-\\w]*$', '') || '=w256-h256' || CASE WHEN contains({u}, '?') THEN substr({u}, strpos({u}, '?')) ELSE '' END"


@query("thumb_urls", f"SELECT page_id, {_THUMB.format(u='url')} AS thumb, {_THUMB.format(u=_THUMB.format(u='url'))} AS again, regexp_matches(url, '(?i)^https?://([^/?#]*\\.)?(googleusercontent\\.com|ggpht\\.com|usercontent\\.google\\.com)([/?#:]|$)') AS hosted FROM pages")
def thumb_urls(spark, d):
    u = F.col("url")
    once = scalars.with_thumb_size(u, 256)
    return adapters.table(spark, d, "pages").select("page_id", once.alias("thumb"), scalars.with_thumb_size(once, 256).alias("again"), scalars.is_image_host(u).alias("hosted"))


# image passes

#: Measurements made from an item's k, for the arithmetic of the scores.
_MEASURED = {
    "lap_var": "k * 3", "local_sharp": "k * 5", "lum_sd": "k / 2", "lum_mean": "k * 2.5", "dark_frac": "k / 100", "lum_p95": "k * 2", "bright_frac": "k / 120", "axial_ratio": "k / 110", "flat_ratio": "k / 130",
    "palette_frac": "k / 900", "aspect_score": "k / 100", "top_bar": "k / 105", "bottom_bar": "k / 115", "sat_mean": "k / 400", "bimodality": "k / 100", "text_score": "k / 125",
}


def _c(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


_SCORES_SQL = {
    "blur_score": "1.0::DOUBLE / (1 + greatest(lap_var, 0.75::DOUBLE * local_sharp) / (110.0::DOUBLE * greatest(0.35::DOUBLE, least(1.0::DOUBLE, lum_sd / 45.0::DOUBLE))))",
    "dark_score": f"0.5::DOUBLE * {_c('(95 - lum_mean) / 95.0::DOUBLE')} + 0.3::DOUBLE * {_c('1.4::DOUBLE * dark_frac')} + 0.2::DOUBLE * {_c('(70 - lum_p95) / 70.0::DOUBLE')}",
    "bright_score": f"0.6::DOUBLE * {_c('(lum_mean - 195) / 60.0::DOUBLE')} + 0.4::DOUBLE * {_c('(bright_frac - 0.4::DOUBLE) / 0.5::DOUBLE')}",
    "screenshot_score": f"0.3::DOUBLE * {_c('(axial_ratio - 0.42::DOUBLE) / 0.35::DOUBLE')} + 0.25::DOUBLE * {_c('(flat_ratio - 0.15::DOUBLE) / 0.45::DOUBLE')} + 0.15::DOUBLE * {_c('(0.11::DOUBLE - palette_frac) / 0.1::DOUBLE')} + 0.15::DOUBLE * aspect_score + 0.15::DOUBLE * {_c('greatest(top_bar, bottom_bar) - 0.55::DOUBLE')}",
    "document_score": f"0.2::DOUBLE * {_c('(lum_mean - 130) / 90.0::DOUBLE')} + 0.2::DOUBLE * {_c('(0.18::DOUBLE - sat_mean) / 0.18::DOUBLE')} + 0.2::DOUBLE * bimodality + 0.3::DOUBLE * text_score + 0.1::DOUBLE * {_c('(axial_ratio - 0.4::DOUBLE) / 0.4::DOUBLE')}",
}


@query(
    "composed_scores",
    "SELECT event_id, " + ", ".join(f"floor({_c(x)} * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS {k}" for k, x in _SCORES_SQL.items()) + " FROM m",
    "m AS (SELECT event_id, " + ", ".join(f"{x.replace('k', 'k').replace('2.5', '2.5::DOUBLE')} AS {n}" for n, x in _MEASURED.items()) + " FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))",
)
def composed_scores(spark, d):
    e = adapters.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))
    m = e.select("event_id", *[F.expr(x.replace("2.5", "2.5D")).cast("double").alias(n) for n, x in _MEASURED.items()])
    return m.select("event_id", *[c.alias(n) for n, c in scores.composed_scores().items()])


def _rasters(spark, d):
    """8 by 8 gray images from embeddings."""
    e = adapters.table(spark, d, "embeddings")
    byte = F.transform("embedding", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 400 + 128)))), 2, "0"))
    return e.select(F.col("vec_id").cast("string").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), F.unhex(F.array_join(byte, "")).alias("data"))


@query("raster_features")
def raster_features(spark, d):
    return kernels.features(kernels.measure(_rasters(spark, d))).select("id", "lum_mean", "lum_sd", "lap_var", "dhash", "ahash", "blur_score", "dark_score", "document_score")


def _sized_rasters(spark, d):
    """Gray images of 8 by 8, 7 by 9 and 64 by 64 pixels from embeddings: their values, the first of them, and sums of two."""
    e = adapters.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    byte = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 400 + 128)))), 2, "0")
    pixels = {(8, 8): F.col("e"), (9, 7): F.slice("e", 1, 63), (64, 64): F.flatten(F.transform("e", lambda a: F.transform("e", lambda b: a + b)))}
    sized = F.array(*[F.struct(F.lit(h).alias("height"), F.lit(w).alias("width"), F.unhex(F.array_join(F.transform(v, byte), "")).alias("data")) for (h, w), v in pixels.items()])
    rows = e.select("vec_id", F.explode(sized).alias("x"))
    return rows.select(F.concat(F.col("vec_id").cast("string"), F.lit("/"), F.col("x.width").cast("string")).alias("id"), "x.width", "x.height", F.lit(1).alias("channels"), "x.data")


#: Pixels, their neighbours' differences and boxes, by image; a box of a resized image is [y0, y1) by [x0, x1).
_PIXELS_SQL = """
px AS (
  SELECT id, w, h, i // w AS y, i % w AS x, greatest(0, least(255, floor(v * 400 + 128))) AS g FROM (
    SELECT vec_id || '/8' AS id, 8 AS w, 8 AS h, unnest(range(0, 64)) AS i, unnest(e) AS v FROM e8
    UNION ALL SELECT vec_id || '/7', 7, 9, unnest(range(0, 63)), unnest(e[1:63]) FROM e8
    UNION ALL SELECT vec_id || '/64', 64, 64, unnest(range(0, 4096)), unnest(flatten(list_transform(e, lambda a: list_transform(e, lambda b: a + b)))) FROM e8
  )
), lap AS (
  SELECT id, x, y, w, h, 4 * g - lag(g) OVER r - lead(g) OVER r - lag(g) OVER c - lead(g) OVER c AS v FROM px WINDOW r AS (PARTITION BY id, y ORDER BY x), c AS (PARTITION BY id, x ORDER BY y)
), laps AS (SELECT id, var_pop(v) AS lap_var FROM lap WHERE v IS NOT NULL GROUP BY id
), blocks AS (
  SELECT id, max(v) AS sharp FROM (SELECT id, x // 24, y // 24, var_pop(v) AS v FROM lap WHERE w = 64 AND x < 48 AND y < 48 AND x % 24 BETWEEN 1 AND 22 AND y % 24 BETWEEN 1 AND 22 GROUP BY ALL) GROUP BY id
), lum AS (
  SELECT id, avg(g) AS lum_mean, stddev_pop(g) AS lum_sd, quantile_disc(g, 0.05) AS lum_p05, quantile_disc(g, 0.5) AS lum_p50, quantile_disc(g, 0.95) AS lum_p95,
    count(*) FILTER (g < 40) / count(*) AS dark_frac, count(*) FILTER (g >= 220) / count(*) AS bright_frac FROM px GROUP BY id
), flat AS (
  SELECT id, avg(CASE WHEN v < 12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS flat_ratio FROM (SELECT id, x // 8, y // 8, var_pop(g) AS v FROM px WHERE x < w // 8 * 8 AND y < h // 8 * 8 GROUP BY ALL) GROUP BY id
), cells AS (
  SELECT s.w, s.h, n, cy, cx, least(s.h - 1, cy * s.h // 8) AS y0, least(s.w - 1, cx * s.w // n) AS x0, least(s.h, greatest(least(s.h - 1, cy * s.h // 8) + 1, (cy + 1) * s.h // 8)) AS y1,
    least(s.w, greatest(least(s.w - 1, cx * s.w // n) + 1, (cx + 1) * s.w // n)) AS x1
  FROM (VALUES (8, 8), (7, 9), (64, 64)) AS s(w, h), (VALUES (8), (9)) AS c(n), range(8) AS a(cy), range(9) AS b(cx) WHERE cx < n
), small AS (
  SELECT id, n, cy, cx, CAST(avg(g) AS FLOAT) AS v FROM px JOIN cells AS c ON c.w = px.w AND c.h = px.h AND y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY ALL
), bits AS (
  SELECT id, 'd' AS kind, cy * 8 + cx AS k, v > lead(v) OVER (PARTITION BY id, cy ORDER BY cx) AS bit FROM small WHERE n = 9 QUALIFY cx < 8
  UNION ALL SELECT id, 'a', cy * 8 + cx, v > avg(CAST(v AS DOUBLE)) OVER (PARTITION BY id) FROM small WHERE n = 8
), hashes AS (
  SELECT id, string_agg(digit, '' ORDER BY q) FILTER (kind = 'd') AS dhash, string_agg(digit, '' ORDER BY q) FILTER (kind = 'a') AS ahash
  FROM (SELECT id, kind, k // 4 AS q, printf('%x', CAST(sum(CASE WHEN bit THEN 8 >> CAST(k % 4 AS INTEGER) ELSE 0 END) AS INTEGER)) AS digit FROM bits GROUP BY ALL) GROUP BY id
), m AS (SELECT *, coalesce(sharp, lap_var) AS local_sharp FROM lum JOIN laps USING (id) JOIN hashes USING (id) LEFT JOIN blocks USING (id) LEFT JOIN flat USING (id))"""


@query(
    "raster_measures",
    "SELECT id, round(lum_mean, 6) AS lum_mean, round(lum_sd, 6) AS lum_sd, CAST(lum_p05 AS INTEGER) AS lum_p05, CAST(lum_p50 AS INTEGER) AS lum_p50, CAST(lum_p95 AS INTEGER) AS lum_p95, round(dark_frac, 6) AS dark_frac, round(bright_frac, 6) AS bright_frac, round(lap_var, 4) AS lap_var, "
    f"round(local_sharp, 4) AS local_sharp, round(coalesce(flat_ratio, 0), 6) AS flat_ratio, dhash, ahash, floor({_c(_SCORES_SQL['blur_score'])} * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS blur_score, floor({_c(_SCORES_SQL['dark_score'])} * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS dark_score, floor({_c(_SCORES_SQL['bright_score'])} * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS bright_score FROM m",
    "e8 AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)",
    _PIXELS_SQL,
)
def raster_measures(spark, d):
    named = ("blur_score", "dark_score", "bright_score")
    m = kernels.measure(_sized_rasters(spark, d)).withColumns({k: v for k, v in scores.composed_scores().items() if k in named})
    six = ("lum_mean", "lum_sd", "dark_frac", "bright_frac", "flat_ratio")
    return m.select("id", "lum_p05", "lum_p50", "lum_p95", "dhash", "ahash", *named, *[F.round(c, 4).alias(c) for c in ("lap_var", "local_sharp")], *[F.round(c, 6).alias(c) for c in six])


@query(
    "screen_aspect",
    "SELECT event_id, " + _c("1.0::DOUBLE - list_min(list_transform([" + ", ".join(f"CAST({t!r} AS DOUBLE)" for t in scalars.SCREEN_RATIOS) + "], lambda t: abs(w / h - t) / t)) / 0.035::DOUBLE") + " AS score FROM (SELECT event_id, CAST(100 + event_id % 900 AS DOUBLE) AS w, CAST(100 + event_id % 700 AS DOUBLE) AS h FROM events)",
)
def screen_aspect(spark, d):
    e = adapters.table(spark, d, "events")
    return e.select("event_id", scalars.screen_aspect(F.lit(100) + F.col("event_id") % 900, F.lit(100) + F.col("event_id") % 700).alias("score"))


_BOXES_SQL = "b AS (SELECT vec_id, vec_id % 50 AS photo, abs(CAST(embedding[1] AS DOUBLE)) AS x1, abs(CAST(embedding[2] AS DOUBLE)) AS y1, abs(CAST(embedding[1] AS DOUBLE)) + 0.2::DOUBLE AS x2, abs(CAST(embedding[2] AS DOUBLE)) + 0.2::DOUBLE AS y2 FROM embeddings)"


def _boxes(spark, d):
    x, y = F.abs(F.col("embedding")[0].cast("double")), F.abs(F.col("embedding")[1].cast("double"))
    return adapters.table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("photo"), F.array(x, y, x + F.lit(0.2), y + F.lit(0.2)).alias("box"))


@query("iou_pairs", """
SELECT a.vec_id AS a, b.vec_id AS b, round(CASE WHEN w <= 0 OR h <= 0 THEN 0.0::DOUBLE ELSE w * h / (aa + ab - w * h) END, 9) AS iou
FROM (SELECT a, b, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab FROM b AS a JOIN b ON b.vec_id = a.vec_id + 50)""", _BOXES_SQL)
def iou_pairs(spark, d):
    b = _boxes(spark, d)
    other = b.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 50).alias("vec_id"), F.col("box").alias("other"))
    return b.join(other, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(detection.iou(F.col("box"), F.col("other")), 9).alias("iou"))


@query("nms", """
SELECT CAST(photo AS VARCHAR) AS photo_id, least(1.0::DOUBLE, max(s)) AS face_score, CAST(count(*) AS INTEGER) AS face_count, round(least(1.0::DOUBLE, sum((x2 - x1) * (y2 - y1))), 6) AS face_area
FROM (SELECT photo, k.s AS s, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM (SELECT photo, unnest(kept) AS k FROM (SELECT photo, arg_max(kept, k) AS kept FROM walk GROUP BY photo))) GROUP BY photo""", _BOXES_SQL, """
walk AS (
  WITH RECURSIVE c AS (
    SELECT photo, vec_id, (vec_id % 97) / 97.0::DOUBLE AS s, least(1.0::DOUBLE, x1) AS x1, least(1.0::DOUBLE, y1) AS y1, least(1.0::DOUBLE, x2) AS x2, least(1.0::DOUBLE, y2) AS y2 FROM b
  ), ok AS (
    SELECT photo, {'s': s, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} AS n, row_number() OVER (PARTITION BY photo ORDER BY s DESC, vec_id) AS k FROM c WHERE s >= 0.6::DOUBLE AND x2 - x1 >= 0.012::DOUBLE AND y2 - y1 >= 0.012::DOUBLE
  ), w AS (
    SELECT photo, k, [n] AS kept FROM ok WHERE k = 1
    UNION ALL
    SELECT w.photo, ok.k, CASE WHEN len(kept) < 64 AND len(list_filter(kept, lambda e: CASE WHEN least(e.x2, n.x2) > greatest(e.x1, n.x1) AND least(e.y2, n.y2) > greatest(e.y1, n.y1) THEN
        (least(e.x2, n.x2) - greatest(e.x1, n.x1)) * (least(e.y2, n.y2) - greatest(e.y1, n.y1)) / ((e.x2 - e.x1) * (e.y2 - e.y1) + (n.x2 - n.x1) * (n.y2 - n.y1) - (least(e.x2, n.x2) - greatest(e.x1, n.x1)) * (least(e.y2, n.y2) - greatest(e.y1, n.y1))) ELSE 0 END > 0.35::DOUBLE)) = 0
      THEN list_append(kept, n) ELSE kept END
    FROM w JOIN ok ON ok.photo = w.photo AND ok.k = w.k + 1
  )
  SELECT * FROM w
)""")
def nms(spark, d):
    score = F.col("vec_id") % 97 / F.lit(97.0)
    raw = _boxes(spark, d).groupBy(F.col("photo").cast("string").alias("photo_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "box", score.alias("s")))).alias("x"))
    raw = raw.select("photo_id", F.flatten(F.transform("x", lambda e: F.array(F.lit(1.0) - e["s"], e["s"]))).alias("scores"), F.flatten(F.transform("x", lambda e: e["box"])).alias("boxes"))
    return detection.summarise(detection.decode_detections(raw)).select("photo_id", "face_score", "face_count", F.round("face_area", 6).alias("face_area"))


# catalogue

_BATCH_SQL = "batch AS (SELECT id, 'n' || id AS dedup_key, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN NULL ELSE ts + 1 END AS ts FROM items WHERE CAST(id AS BIGINT) % 3 = 0 UNION ALL SELECT 'x' || id, 'n' || id, ts FROM items WHERE CAST(id AS BIGINT) % 100 = 1)"


def _batch(items):
    n = F.col("id").cast("long")
    some = items.filter(n % 3 == 0).select("id", F.concat(F.lit("n"), F.col("id")).alias("dedup_key"), F.when(n % 4 != 0, F.col("ts") + 1).alias("ts"))
    return some.unionByName(items.filter(n % 100 == 1).select(F.concat(F.lit("x"), F.col("id")).alias("id"), F.concat(F.lit("n"), F.col("id")).alias("dedup_key"), "ts"))


@query("catalogue_upsert", "SELECT coalesce(b.id, i.id) AS id, coalesce(b.ts, i.ts) AS ts, CASE WHEN b.id IS NOT NULL THEN b.dedup_key ELSE i.dedup_key END AS dedup_key, CASE WHEN i.id IS NULL THEN false ELSE i.analyzed END AS analyzed, i.size_bytes, i.fs AS face_score, i.id IS NULL AS added FROM items i FULL JOIN batch b ON i.id = b.id", ITEMS_SQL, _BATCH_SQL)
def catalogue_upsert(spark, d):
    items = adapters.items(spark, d)
    merged = C.upsert_items(items, _batch(items))
    return merged.select("id", "ts", "dedup_key", "analyzed", "size_bytes", F.col("features.face_score").alias("face_score"), F.coalesce("added", F.lit(False)).alias("added"))


@query("catalogue_upsert_counts", "SELECT count(*) FILTER (i.id IS NULL) AS added, count(*) FILTER (i.id IS NOT NULL) AS updated FROM batch b LEFT JOIN items i ON i.id = b.id", ITEMS_SQL, _BATCH_SQL)
def catalogue_upsert_counts(spark, d):
    items = adapters.items(spark, d)
    return C.upsert_counts(C.upsert_items(items, _batch(items)))


@query("catalogue_features", "SELECT id, CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN false WHEN CAST(id AS BIGINT) % 3 = 0 THEN true ELSE analyzed END AS analyzed, CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 'failed' WHEN CAST(id AS BIGINT) % 3 = 0 THEN NULL ELSE analysis_error END AS analysis_error, fs AS face_score FROM items", ITEMS_SQL)
def catalogue_features(spark, d):
    items = adapters.items(spark, d)
    n = F.col("id").cast("long")
    results = items.filter(n % 3 == 0).select("id", "features", F.when(n % 6 == 0, "failed").alias("error"))
    return C.save_features(items, results).select("id", "analyzed", "analysis_error", F.col("features.face_score").alias("face_score"))


@query("catalogue_faces_replace", "SELECT id, photo_id FROM faces WHERE CAST(photo_id AS BIGINT) % 2 = 1 UNION ALL SELECT 'new' || photo_id, photo_id FROM (SELECT DISTINCT photo_id FROM faces WHERE CAST(photo_id AS BIGINT) % 4 = 0)", FACES_SQL)
def catalogue_faces_replace(spark, d):
    faces = adapters.faces(spark, d).select("id", "photo_id")
    photo = F.col("photo_id").cast("long")
    analysed = faces.filter(photo % 2 == 0).select("photo_id").distinct()
    found = analysed.filter(photo % 4 == 0).select(F.concat(F.lit("new"), F.col("photo_id")).alias("id"), "photo_id")
    return C.save_faces(adapters.items(spark, d), faces, found, analysed)[1]


@query("catalogue_people", "SELECT id, CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN '' ELSE array_to_string(people, ',') END AS people, CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN true ELSE people IS NOT NULL END AS is_read FROM items", ITEMS_SQL)
def catalogue_people(spark, d):
    items = adapters.items(spark, d)
    new = items.filter(F.col("id").cast("long") % 9 == 0).select(F.col("id").alias("photo_id"), F.array().cast("array<int>").alias("people"))
    return C.save_people(items, new).select("id", F.array_join("people", ",").alias("people"), F.col("people").isNotNull().alias("is_read"))


@query("catalogue_kept", "SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN true ELSE kept END AS kept FROM items", ITEMS_SQL)
def catalogue_kept(spark, d):
    items = adapters.items(spark, d)
    return C.mark_kept(items, items.filter(F.col("id").cast("long") % 4 == 0), True).select("id", "kept")


@query("catalogue_delete", "SELECT id, 'item' AS kind FROM items WHERE CAST(id AS BIGINT) % 3 <> 0 UNION ALL SELECT id, 'face' FROM faces WHERE CAST(photo_id AS BIGINT) % 3 <> 0", ITEMS_SQL, FACES_SQL)
def catalogue_delete(spark, d):
    items, faces = adapters.items(spark, d), adapters.faces(spark, d)
    i, f = C.delete_items(items, faces, items.filter(F.col("id").cast("long") % 3 == 0))
    return i.select("id", F.lit("item").alias("kind")).unionByName(f.select("id", F.lit("face").alias("kind")))


@query("pending", "SELECT id FROM items WHERE NOT analyzed AND url IS NOT NULL ORDER BY id LIMIT 500", ITEMS_SQL)
def pending(spark, d):
    return C.pending(adapters.items(spark, d), 500).select("id")


@query("people_candidates", "SELECT id FROM items WHERE analyzed AND url IS NOT NULL AND NOT is_video AND NOT people_scanned AND coalesce(fs, 0) >= 0.35 ORDER BY id LIMIT 240", ITEMS_SQL)
def people_candidates(spark, d):
    return C.people_candidates(adapters.items(spark, d)).select("id")


@query("people_attachment", "SELECT id, CASE WHEN people IS NOT NULL THEN coalesce((SELECT max(size) FROM groups WHERE list_contains(people, group_id)), 0) END AS attachment FROM items", ITEMS_SQL, adapters.GROUPS_SQL)
def people_attachment(spark, d):
    from lumisift.operators.orders import with_attachment

    items = adapters.items(spark, d)
    return with_attachment(items, stats.group_sizes(items)).select("id", "attachment")


# listing

_WIRE_SQL = "wire AS (SELECT event_id, epoch_us(ts) // 1000 AS t, event_type = 'view' AS video, CAST(floor(value) AS BIGINT) AS sec FROM events)"


def _pages_of(spark, d, page_size: int = 500):
    """Events as listing pages of JSON text, newest first within a page."""
    e = adapters.table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") == "view").alias("video"), F.floor("value").cast("long").alias("sec"))
    i = F.col("event_id").cast("string")
    options = F.concat(F.lit("{"), F.when(F.col("video"), F.concat(F.lit(f'"{P.DURATION}":['), (F.col("sec") * 1000).cast("string"), F.lit("],"))).otherwise(""), F.lit(f'"{P.FAVOURITE}":['), (F.col("event_id") % 2 == 0).cast("string"), F.lit("]}"))
    thumb = F.when(F.col("event_id") % 31 == 0, F.lit("null")).otherwise(F.concat(F.lit('["https://lh3.googleusercontent.com/i'), i, F.lit('",640,480]')))
    owners = F.when(F.col("event_id") % 17 == 0, F.lit("[[27]]")).otherwise(F.lit("[[1]]"))
    item = F.concat(F.lit('["m'), i, F.lit('",'), thumb, F.lit(","), F.col("t").cast("string"), F.lit(',"d'), i, F.lit('",0,'), F.col("t").cast("string"), F.lit(",null,"), owners, F.lit(",null,null,null,null,null,"), (F.col("event_id") % 5 == 0).cast("string"), F.lit(","), options, F.lit("]"))
    page = F.floor(F.col("event_id") / page_size)
    text = F.concat(F.lit("[["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("t"), "event_id", "item"))), lambda x: x["item"]), ","), F.lit('],"next",'), F.min("t").cast("string"), F.lit("]"))
    return e.withColumn("item", item).groupBy(page.alias("page")).agg(text.alias("value"))


#: Pages that a listing file holds at most: some 90 MB, as each has 500 items.
PAGES_A_FILE = 1000


def _write_pages(pages, folder: str) -> None:
    """Pages as listing files, which are more where there are more pages; their names ascend with the pages."""
    pages.orderBy("page").select("value").write.option("maxRecordsPerFile", PAGES_A_FILE).text(folder)


@query("parse_items", f"SELECT 'm' || event_id AS media_key, CASE WHEN event_id % 31 <> 0 THEN 'https://lh3.googleusercontent.com/i' || event_id END AS thumb, CASE WHEN event_id % 31 <> 0 THEN 640 END AS width, t AS timestamp, 'd' || event_id AS dedup_key, video AS is_video, CASE WHEN video THEN sec END AS duration, event_id % 5 = 0 AS is_archived, event_id % 2 = 0 AS is_favourite, event_id % 17 <> 0 AS is_owned FROM wire", _WIRE_SQL)
def parse_items(spark, d):
    return P.parse_items(_pages_of(spark, d)).select("media_key", "thumb", "width", "timestamp", "dedup_key", "is_video", "duration", "is_archived", "is_favourite", "is_owned")


@query("listing_rows", "SELECT 'm' || event_id AS id, 'https://lh3.googleusercontent.com/i' || event_id || '=w176-h176?authuser=1' AS url, t AS ts, 'exact' AS \"precision\", video AS is_video FROM wire WHERE event_id % 31 <> 0", _WIRE_SQL)
def listing_rows(spark, d):
    rows = P.to_rows(P.parse_items(_pages_of(spark, d)).filter("thumb is not null"), 176, 0, 1)
    return rows.select("id", "url", "ts", "precision", "is_video")


@query("listing_incremental", "SELECT 'm' || event_id AS id, t AS ts, video AS is_video, false AS analyzed FROM wire WHERE event_id % 31 <> 0", _WIRE_SQL)
def listing_incremental(spark, d):
    """The stream over pages, run twice, against the batch result: the second run adds nothing."""
    from lumisift.params import RunParams
    from lumisift.streaming import ingest

    pages = _pages_of(spark, d)
    root = shared_folder(pages)
    lines = f"{root}/pages"
    _write_pages(pages, lines)
    cat = C.Catalogue(spark, f"{root}/catalogue")
    for k in range(2):
        ingest.list_pages(spark, lines, cat, RunParams(), f"{root}/checkpoint-{k}-{uuid.uuid4().hex}", batch_files=10 if k == 0 else 200)
    return cat.read("items").select("id", "ts", "is_video", "analyzed")


def _listed(spark, d):
    """A catalogue with the events' pages, and a folder for checkpoints."""
    from lumisift.params import RunParams
    from lumisift.streaming import ingest

    pages = _pages_of(spark, d)
    root = shared_folder(pages)
    _write_pages(pages, f"{root}/pages")
    cat = C.Catalogue(spark, f"{root}/catalogue")
    ingest.list_pages(spark, f"{root}/pages", cat, RunParams(), f"{root}/checkpoint")
    return cat


def _stopping_at(call: int, abort, work):
    """work, whose call of that number presses the button."""
    calls = []

    def run(todo):
        calls.append(1)
        if len(calls) == call:
            abort.stop()
        return work(todo)

    return run


def _measured(todo):
    """Features of listed items by arithmetic; every thirteenth can't be decoded."""
    n = F.expr("cast(substr(id, 2) as long)")
    fields = ((f.strip().partition(":")[0], f.strip().partition(":")[2]) for f in schema.FEATURES[len("struct<") : -1].split(","))
    score = F.round(n % 100 / 100, 2)
    return todo.select("id", F.struct(*[(score if name == "face_score" else F.lit(None)).cast(kind).alias(name) for name, kind in fields]).alias("features"), F.when(n % 13 == 0, "decode").alias("error"))


def _one_face(todo):
    n = F.expr("cast(substr(id, 2) as long)")
    return todo.select(F.concat("id", F.lit("#0")).alias("id"), F.col("id").alias("photo_id"), (n % 11 != 0).alias("ok"), F.array(F.lit(0.0)).alias("box"), F.lit(0.9).alias("score"), F.array((n % 7).cast("float"), F.lit(1.0).cast("float")).alias("vector"))


_ANALYSED_SQL = "analysed_ AS (SELECT event_id, 'm' || event_id AS id, video, event_id % 13 <> 0 AS ok, CAST(event_id % 100 AS DOUBLE) / 100 AS fs FROM wire WHERE event_id % 31 <> 0)"


@query("analysis_incremental", "SELECT id, ok AS analyzed, CASE WHEN NOT ok THEN 'decode' END AS analysis_error, CASE WHEN ok THEN round(fs, 2) END AS face_score FROM analysed_", _WIRE_SQL, _ANALYSED_SQL)
def analysis_incremental(spark, d):
    """Analysis in slices that is stopped in two runs and ends in the third."""
    from lumisift.streaming import ingest

    cat = _listed(spark, d)
    size = -(-cat.ids().count() // 3)
    for _ in range(2):
        abort = ingest.Abort(spark)
        ingest.analyse_pending(cat, _stopping_at(2, abort, _measured), size=size, abort=abort)
    ingest.analyse_pending(cat, _measured)
    return cat.read("items").select("id", "analyzed", "analysis_error", F.col("features.face_score").alias("face_score"))


@query("faces_incremental", "SELECT id, id || '#0' AS face, CAST(event_id % 7 AS DOUBLE) AS x FROM analysed_ WHERE ok AND NOT video AND fs >= 0.35 AND event_id % 11 <> 0", _WIRE_SQL, _ANALYSED_SQL)
def faces_incremental(spark, d):
    """Faces in slices over analysed items, stopped once; photos that fail have none."""
    from lumisift.streaming import ingest

    cat = _listed(spark, d)
    ingest.analyse_pending(cat, _measured)
    abort = ingest.Abort(spark)
    size = -(-C.people_candidates(cat.read("items"), None).count() // 3)
    ingest.scan_faces(cat, _stopping_at(2, abort, _one_face), size=size, abort=abort)
    ingest.scan_faces(cat, _one_face)
    scanned = cat.read("items").filter("people_scanned").select("id")
    return cat.read("faces").join(scanned.withColumnRenamed("id", "photo_id"), "photo_id").select(F.col("photo_id").alias("id"), F.col("id").alias("face"), F.get("vector", F.lit(0)).cast("double").alias("x"))


def page_json(items: list, next_page: str | None = None, last: int | None = None) -> str:
    """A page of the wire format, for fixtures."""
    return json.dumps([items, next_page, last])
