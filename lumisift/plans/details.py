"""Driver queries of display texts, selections, resets of the catalogue and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumisift.functions import scalars
from lumisift.operators import decisions, people, stats
from lumisift.plans import adapters
from lumisift.plans.adapters import FACES_SQL, ITEMS_SQL
from lumisift.plans.library import ORACLES, QUERIES, query
from lumisift.sources import catalogue as C


@query("display_texts", """
SELECT event_id, CAST(floor(event_id % 101 / 100.0::DOUBLE * 100 + 0.5::DOUBLE) AS BIGINT) || '%' AS share, CASE WHEN event_id % 9 = 0 THEN '0' ELSE format('{:,}', event_id * 1000) END AS number,
  CASE WHEN s < 60 THEN s || 's' WHEN s % 60 = 0 THEN (s // 60) || ' min' ELSE (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS duration,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE strftime(DATE '1970-01-01' + CAST(event_id % 20000 AS INTEGER), '%Y-%m-%d') END AS day
FROM (SELECT event_id, event_id % 700 AS s FROM events)""")
def display_texts(spark, d):
    e = adapters.table(spark, d, "events").select("event_id")
    known = F.col("event_id") % 9 != 0
    return e.select(
        "event_id",
        scalars.percent((F.col("event_id") % 101) / F.lit(100.0)).alias("share"),
        scalars.number_text(F.when(known, F.col("event_id") * 1000)).alias("number"),
        scalars.duration_text(F.col("event_id") % 700).alias("duration"),
        scalars.date_input(F.when(known, (F.col("event_id") % 20000) * 86_400_000)).alias("day"),
    )


@query("months_ago", "SELECT event_id, " + ", ".join(f"epoch_ms(CAST(CAST(d - INTERVAL {n} MONTH AS DATE) AS TIMESTAMP)) AS m{n}" for n in (1, 6, 24)) + " FROM (SELECT event_id, DATE '2001-01-01' + CAST(event_id % 8000 AS INTEGER) AS d FROM events)")
def months_ago(spark, d):
    day = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("event_id") % 8000).cast("int"))
    return adapters.table(spark, d, "events").select("event_id", *[scalars.months_ago(n, day).alias(f"m{n}") for n in (1, 6, 24)])


@query("section_members", f"SELECT id FROM ({ORACLES['sections_person']}) WHERE section = 'person:none'")
def section_members(spark, d):
    return QUERIES["sections_person"](spark, d).filter("section = 'person:none'").select("id")


_HALF_SQL = "picked AS (SELECT id FROM items WHERE CAST(id AS BIGINT) % 10 = 0), touched AS (SELECT id FROM items WHERE CAST(id AS BIGINT) % 15 = 0)"


@query("selection_toggled", "SELECT id, true AS ticked FROM (SELECT id FROM picked UNION SELECT id FROM touched) UNION ALL SELECT id, false FROM picked WHERE id NOT IN (SELECT id FROM touched)", ITEMS_SQL, _HALF_SQL)
def selection_toggled(spark, d):
    items = adapters.items(spark, d).select("id")
    n = F.col("id").cast("long")
    picked, touched = items.filter(n % 10 == 0), items.filter(n % 15 == 0)
    on, off = (decisions.toggled(picked, touched, x).select("id", F.lit(x).alias("ticked")) for x in (True, False))
    return on.unionByName(off)


@query("usable_items", "SELECT id FROM items WHERE url IS NOT NULL", ITEMS_SQL)
def usable_items(spark, d):
    return decisions.drop_unusable(adapters.items(spark, d)).select("id")


@query("people_cover", """
SELECT label AS group_id, coalesce((SELECT string_agg(photo_id, ',' ORDER BY photo_id) FROM (SELECT DISTINCT photo_id FROM faces AS g WHERE g.label = f.label AND photo_id IN (SELECT id FROM items WHERE url IS NOT NULL) ORDER BY photo_id LIMIT 3)), '') AS cover
FROM (SELECT DISTINCT label FROM faces) AS f""", ITEMS_SQL, FACES_SQL)
def people_cover(spark, d):
    groups = adapters.faces(spark, d).groupBy(F.col("label").alias("group_id")).agg(F.array_sort(F.collect_set("photo_id")).alias("photo_ids"))
    return people.for_display(groups, adapters.items(spark, d)).select("group_id", F.array_join("cover", ",").alias("cover"))


@query("catalogue_cleared", """
SELECT 'people' AS reset, count(*) AS items, count(*) FILTER (people_scanned) AS scanned, 0 AS named, (SELECT count(*) FROM faces) AS faces FROM items
UNION ALL SELECT 'faces', count(*), 0, 0, 0 FROM items""", ITEMS_SQL, FACES_SQL)
def catalogue_cleared(spark, d):
    items, faces = adapters.items(spark, d), adapters.faces(spark, d)
    rows = []
    for name, (i, f) in {"people": (C.clear_people(items), faces), "faces": C.clear_faces(items, faces)}.items():
        one = i.agg(F.count("*").alias("items"), F.count_if("people_scanned").alias("scanned"), F.count_if(F.col("people").isNotNull()).alias("named"))
        rows.append(one.crossJoin(f.agg(F.count("*").alias("faces"))).select(F.lit(name).alias("reset"), "*"))  # one row each
    return rows[0].unionByName(rows[1])


@query("face_row_ids", "SELECT photo_id || '#' || id AS face, photo_id FROM faces WHERE photo_id = '7'", FACES_SQL)
def face_row_ids(spark, d):
    return C.faces_of(adapters.faces(spark, d), "7").select(C.face_row_id(F.col("photo_id"), F.col("id")).alias("face"), "photo_id")


@query("analysis_phases", """
SELECT a / t AS fetch_share, b / t AS decode_share, c / t AS measure_share, CASE greatest(a, b, c) WHEN c THEN 'measure' WHEN b THEN 'decode' ELSE 'fetch' END AS worst
FROM (SELECT *, a + b + c AS t FROM (SELECT CAST(sum(event_id % 7) AS DOUBLE) AS a, CAST(sum(event_id % 11) AS DOUBLE) AS b, CAST(sum(event_id % 5) AS DOUBLE) AS c FROM events))""")
def analysis_phases(spark, d):
    e = adapters.table(spark, d, "events").select(*[(F.col("event_id") % n).alias(name) for name, n in (("fetch", 7), ("decode", 11), ("measure", 5))])
    return stats.phases(e, ["fetch", "decode", "measure"])


@query("progress_milestones", """
SELECT user_id, n AS analysed, n = t AS complete, CASE WHEN n = t THEN 'complete' WHEN n >= 10000 THEN '10k' WHEN n >= 1000 THEN '1k' END AS milestone
FROM (SELECT user_id % 4 AS user_id, count(*) FILTER (event_id % 10 > user_id % 4) * 100 AS n, count(*) FILTER (event_id % 10 > 0) * 100 AS t FROM events GROUP BY 1)""")
def progress_milestones(spark, d):
    e = adapters.table(spark, d, "events")
    seen = e.groupBy((F.col("user_id") % 4).alias("user_id")).agg((F.count_if(F.col("event_id") % 10 > F.col("user_id") % 4) * 100).alias("analysed"), (F.count_if(F.col("event_id") % 10 > 0) * 100).alias("t"))
    return stats.milestones(seen.select("user_id", "analysed", (F.col("analysed") == F.col("t")).alias("complete")))
