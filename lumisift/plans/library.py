"""Queries of the library engine by name, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions import scalars as S
from lumisift.operators import criteria, decisions, duplicates, orders, people, stats
from lumisift.params import CRITERIA, ORDERS, QueryParams
from lumisift.plans import adapters
from lumisift.plans.adapters import DOCUMENT_ITEMS_SQL, FACES_SQL, GROUPS_SQL, ITEMS_SQL
from lumisift.plans.query import LibraryQuery

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *with_: str):
    """Register a query; with_ are the SQL's common table expressions."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (f"WITH RECURSIVE {', '.join(with_)}\n" if with_ else "") + sql.strip()
        return f

    return add


#: The parameters that the driver queries use.
FOUND = QueryParams(enabled={"blurry", "dark", "largeFile", "withPerson"}, person_ids=(1, 3), large_file_mb=100)
DATES = {"date_from": 1_704_067_200_000, "date_to": 1_711_929_600_000}

_PHOTO = "NOT coalesce(is_video, false)"


def predicates_sql(p: QueryParams) -> dict[str, str]:
    chosen = f"CAST([{', '.join(map(str, p.person_ids))}] AS INTEGER[])"
    read = f"people IS NOT NULL AND {bool(p.person_ids)}".lower()
    bounds = [f"ts >= {p.date_from}"] * (p.date_from is not None) + [f"ts <= {p.date_to}"] * (p.date_to is not None)
    table = {
        "noFace": f"has_f AND {_PHOTO} AND NOT coalesce(fs > {p.no_face_max}, false) AND (coalesce(fm IN ('ultraface', 'FaceDetector'), false) OR coalesce(skin, 0) <= {p.no_face_max_skin})",
        "hasFace": f"fs >= {p.has_face_min}", "screenshot": f"ss >= {p.screenshot_min}", "document": f"ds >= {p.document_min}",
        "blurry": f"{_PHOTO} AND bs >= {p.blur_min}", "dark": f"{_PHOTO} AND dk >= {p.dark_min}", "bright": f"{_PHOTO} AND br >= {p.bright_min}",
        "duplicates": "dup_selectable", "longVideo": f"is_video AND coalesce(duration, 0) >= {p.long_video_sec}",
        "largeFile": f"bytes > 0 AND bytes >= {p.large_file_mb * 1048576}", "dateRange": " AND ".join(bounds) or "true",
        "withPerson": f"{read} AND list_has_any(people, {chosen})", "withoutPerson": f"{read} AND NOT list_has_any(people, {chosen})",
    }
    return {k: f"coalesce({table[k]}, false)" for k in CRITERIA}


def matched_sql(p: QueryParams) -> str:
    parts = [f"CASE WHEN {c} THEN '{k}' END" for k, c in predicates_sql(p).items() if k in p.enabled]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)" if parts else "CAST([] AS VARCHAR[])"


def pool_sql(p: QueryParams, source: str = "items") -> str:
    lens = {"all": "true", "photo": _PHOTO, "video": "coalesce(is_video, false)"}[p.lens]
    kept = "NOT coalesce(kept, false)" if p.hide_kept else "true"
    return f"pool AS (SELECT *, false AS dup_selectable FROM {source} WHERE {kept} AND {lens})"


def found_sql(p: QueryParams) -> str:
    need = 0 if not p.enabled else len(p.enabled) if p.mode == "all" else 1
    return f"found AS (SELECT * FROM (SELECT *, {matched_sql(p)} AS matched FROM pool) WHERE len(matched) >= {need})"


_TIES = "coalesce(ts, 0) DESC, id ASC"
_KEYS = {
    "suspicion": ("len(matched)", "DESC"), "noPeople": (f"CASE WHEN {_PHOTO} THEN fs END", "ASC"), "rarePeople": ("attachment", "ASC"), "similar": ("similar_size", "DESC"),
    "biggest": ("nullif(bytes, 0)", "DESC"), "blurry": (f"CASE WHEN {_PHOTO} THEN bs END", "DESC"), "dark": (f"CASE WHEN {_PHOTO} THEN dk END", "DESC"), "oldest": ("ts", "ASC"), "newest": ("ts", "DESC"),
}


def order_sql(order: str) -> str:
    key, way = _KEYS[order]
    return f"{key} {way} NULLS LAST, {_TIES}"


def dup_sql(distance: int, window: int, keep: str = "sharpest", source: str = "items", ts: str = "coalesce(ts, 0)", score: str = "coalesce(lap, 0) + coalesce(nw, 0) * coalesce(nh, 0) * 1e-5") -> list[str]:
    """Common table expressions el, pairs, reach, dup (root, id, rn), keepers and selectable."""
    half = lambda side, h, at: f"CAST('0x' || substr({side}.{h}, {at}, 8) AS BIGINT)"
    far = lambda h: " + ".join(f"bit_count(xor({half('a', h, at)}, {half('b', h, at)}))" for at in (1, 9))
    best = {"sharpest": f"{score} DESC", "first": "coalesce(CAST(ts AS DOUBLE), 1e300) ASC", "last": "coalesce(CAST(ts AS DOUBLE), -1e300) DESC"}.get(keep)
    keepers = f"SELECT root, id FROM (SELECT root, dup.id, row_number() OVER (PARTITION BY root ORDER BY {best}, rn) AS k FROM dup JOIN {source} USING (id)) WHERE k = 1" if best else "SELECT root, id FROM dup WHERE false"
    return [
        f"el AS (SELECT id, dhash, ahash, row_number() OVER (ORDER BY {ts}, id) AS rn FROM {source} WHERE dhash IS NOT NULL)",
        f"near AS (SELECT a.id AS a, b.id AS b, a.rn AS rn_a, b.rn AS rn_b FROM el a JOIN el b ON b.rn // {window} IN (a.rn // {window}, a.rn // {window} + 1) AND b.rn > a.rn AND b.rn <= a.rn + {window} WHERE {far('dhash')} <= {distance} AND {far('ahash')} <= {distance + 6})",
        "both_ways AS (SELECT rn_a AS x, rn_b AS y FROM near UNION SELECT rn_b, rn_a FROM near)",
        "reach AS (SELECT x AS node, x AS to_node FROM both_ways UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON r.to_node = b.x)",
        "dup AS (SELECT r.id AS root, m.id AS id, m.rn AS rn FROM (SELECT node, min(to_node) AS least FROM reach GROUP BY node) z JOIN el m ON m.rn = z.node JOIN el r ON r.rn = z.least)",
        f"keepers AS ({keepers})",
        "selectable AS (SELECT root, id FROM dup WHERE id NOT IN (SELECT id FROM keepers))",
    ]


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", "ts", F.array_join("matched", ",").alias("matched"), F.size("matched").cast("long").alias("n_matched"), *more)


_SHOWN = "id, ts, array_to_string(matched, ',') AS matched, CAST(len(matched) AS BIGINT) AS n_matched"


# pools and criteria


@query("pool_lens_counts", "SELECT count(*) AS \"all\", count(*) FILTER (is_video) AS video, count(*) FILTER (NOT is_video) AS photo FROM items WHERE NOT kept", ITEMS_SQL)
def pool_lens_counts(spark, d):
    return criteria.count_media(criteria.undecided(adapters.items(spark, d)))


_UNITS = "CASE WHEN v < 1024 THEN CAST(CAST(v AS BIGINT) AS VARCHAR) || ' B' " + " ".join(
    f"WHEN v < {1024 ** (i + 1)} OR {str(u == 'TB').lower()} THEN CASE WHEN v / {1024**i} >= 100 THEN CAST(CAST(floor(v / {1024**i} + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', v / {1024**i}) END || ' {u}'" for i, u in list(enumerate(("B", "KB", "MB", "GB", "TB")))[1:]
) + " END"


@query("item_bytes", f"SELECT id, bytes, {_UNITS} AS text FROM (SELECT *, CAST(bytes AS DOUBLE) AS v FROM items)", ITEMS_SQL)
def item_bytes(spark, d):
    b = S.item_bytes(F.col("space_taken"), F.col("size_bytes"))
    return adapters.items(spark, d).select("id", b.alias("bytes"), S.format_bytes(b).alias("text"))


_ALL = QueryParams(enabled=set(CRITERIA), person_ids=(1, 3), large_file_mb=100, **DATES)


@query("criteria_counts", "SELECT " + ", ".join(f"count(*) FILTER ({c}) AS \"{k}\"" for k, c in predicates_sql(_ALL).items()) + " FROM (SELECT items.*, s.id IS NOT NULL AS dup_selectable FROM items LEFT JOIN selectable s USING (id) WHERE NOT kept)", ITEMS_SQL, *dup_sql(8, 80))
def criteria_counts(spark, d):
    items = adapters.items(spark, d)
    return LibraryQuery(items, _ALL, adapters.person_groups(items)).badges()


def _filter_query(name: str, p: QueryParams) -> None:
    @query(name, f"SELECT {_SHOWN} FROM found", ITEMS_SQL, pool_sql(p), found_sql(p))
    def run(spark, d):
        return _shown(LibraryQuery(adapters.items(spark, d), p, spark.range(0)).matches())


_filter_query("filter_any", FOUND)
_filter_query("filter_all", QueryParams(enabled={"blurry", "largeFile"}, mode="all", lens="photo"))
_filter_query("filter_browse", QueryParams(lens="video"))
_filter_query("filter_dates", QueryParams(enabled={"dateRange", "noFace"}, mode="all", **DATES))
_filter_query("filter_without_person", QueryParams(enabled={"withoutPerson"}, person_ids=(2,)))

_DUP_FOUND = QueryParams(enabled={"duplicates", "blurry"})


@query("filter_duplicates", f"SELECT {_SHOWN} FROM found", ITEMS_SQL, *dup_sql(8, 80), "pool AS (SELECT items.*, s.id IS NOT NULL AS dup_selectable FROM items LEFT JOIN selectable s USING (id) WHERE NOT kept)", found_sql(_DUP_FOUND))
def filter_duplicates(spark, d):
    return _shown(LibraryQuery(adapters.items(spark, d), _DUP_FOUND).matches())


# orders and sections


def _order_query(order: str) -> None:
    p = QueryParams(enabled=FOUND.enabled, person_ids=FOUND.person_ids, large_file_mb=100, sort=order)
    parts, source = [ITEMS_SQL, pool_sql(p), found_sql(p)], "found"
    if order == "rarePeople":
        parts += [GROUPS_SQL, "r AS (SELECT found.*, CASE WHEN people IS NOT NULL THEN coalesce((SELECT max(size) FROM groups WHERE list_contains(people, group_id)), 0) END AS attachment FROM found)"]
        source = "r"
    elif order == "similar":
        parts += [*dup_sql(8, 80), "r AS (SELECT found.*, n AS similar_size FROM found LEFT JOIN (SELECT dup.id, count(*) OVER (PARTITION BY root) AS n FROM dup) z USING (id))"]
        source = "r"

    @query(f"order_{order}", f"SELECT {_SHOWN}, row_number() OVER (ORDER BY {order_sql(order)}) AS rank FROM {source}", *parts)
    def run(spark, d):
        items = adapters.items(spark, d)
        return _shown(LibraryQuery(items, p, adapters.person_groups(items)).ranked(), "rank")


for _o in ORDERS:
    _order_query(_o)


@query("top_k_suspicion", f"SELECT {_SHOWN} FROM found ORDER BY {order_sql('suspicion')} LIMIT 300", ITEMS_SQL, pool_sql(FOUND), found_sql(FOUND))
def top_k_suspicion(spark, d):
    return _shown(LibraryQuery(adapters.items(spark, d), FOUND, spark.range(0)).top(300))


_RANKED = f"ranked AS (SELECT *, row_number() OVER (ORDER BY {{}}) AS rank FROM {{}})"


def _sectioned(df: DataFrame) -> DataFrame:
    return df.select("id", "section", "title", F.col("section_rank").cast("long").alias("section_rank"), F.col("row_rank").cast("long").alias("row_rank"))


_PERSON = QueryParams(enabled={"blurry", "dark"}, sort="rarePeople")


@query(
    "sections_person",
    """
SELECT id, CASE WHEN g IS NULL THEN 'person:none' ELSE 'person:' || g END AS section, CASE WHEN g IS NULL THEN 'Nobody recognised' ELSE coalesce(name, 'Person ' || (g + 1)) END AS title,
  dense_rank() OVER (ORDER BY size NULLS LAST, g NULLS LAST) AS section_rank, row_number() OVER (PARTITION BY g ORDER BY rank) AS row_rank
FROM ranked LEFT JOIN rarest USING (id)""",
    ITEMS_SQL, pool_sql(_PERSON), found_sql(_PERSON), GROUPS_SQL,
    "r AS (SELECT found.*, CASE WHEN people IS NOT NULL THEN coalesce((SELECT max(size) FROM groups WHERE list_contains(people, group_id)), 0) END AS attachment FROM found)",
    _RANKED.format(order_sql("rarePeople"), "r"),
    "rarest AS (SELECT id, group_id AS g, size, name FROM (SELECT f.id, group_id, size, name, row_number() OVER (PARTITION BY f.id ORDER BY size, pos) AS k FROM (SELECT id, unnest(people) AS p, generate_subscripts(people, 1) AS pos FROM found) f JOIN groups ON p = group_id) WHERE k = 1)",
)
def sections_person(spark, d):
    items = adapters.items(spark, d)
    return _sectioned(LibraryQuery(items, _PERSON, adapters.person_groups(items)).sectioned())


_DAY = QueryParams(enabled={"blurry", "dark"}, sort="newest")


@query(
    "sections_day",
    """
SELECT id, 'day:' || day AS section, CASE WHEN day = 'none' THEN 'No date' ELSE day END AS title, CAST(section_rank AS BIGINT) AS section_rank, row_number() OVER (PARTITION BY section_rank ORDER BY rank) AS row_rank
FROM (SELECT *, sum(CASE WHEN day IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS section_rank FROM (SELECT *, lag(day) OVER (ORDER BY rank) AS before FROM days))""",
    ITEMS_SQL, pool_sql(_DAY), found_sql(_DAY), _RANKED.format(order_sql("newest"), "found"),
    "days AS (SELECT *, CASE WHEN ts IS NULL THEN 'none' ELSE strftime(make_timestamp(ts * 1000), '%Y-%m-%d') END AS day FROM ranked)",
)
def sections_day(spark, d):
    return _sectioned(LibraryQuery(adapters.items(spark, d), _DAY).sectioned())


_SIMILAR = QueryParams(enabled={"blurry", "dark"}, sort="similar", dup_window=200)


@query(
    "sections_similar",
    """
SELECT id, CASE WHEN root IS NULL THEN 'similar:none' ELSE 'similar:' || root END AS section, CASE WHEN root IS NULL THEN 'Nothing resembles these' ELSE n || ' lookalikes' END AS title,
  dense_rank() OVER (ORDER BY CASE WHEN root IS NULL THEN 1 ELSE 0 END, n DESC, root) AS section_rank, row_number() OVER (PARTITION BY root ORDER BY rank) AS row_rank
FROM (SELECT *, CASE WHEN root IS NOT NULL THEN count(*) OVER (PARTITION BY root) END AS n FROM ranked)""",
    ITEMS_SQL, pool_sql(_SIMILAR), found_sql(_SIMILAR), *dup_sql(8, 200),
    "r AS (SELECT found.*, z.root, z.size AS similar_size FROM found LEFT JOIN (SELECT root, dup.id, count(*) OVER (PARTITION BY root) AS size FROM dup) z USING (id))",
    _RANKED.format(order_sql("similar"), "r"),
)
def sections_similar(spark, d):
    return _sectioned(LibraryQuery(adapters.items(spark, d), _SIMILAR).sectioned())


@query("neighbours_newest", "SELECT id, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM items WINDOW w AS (ORDER BY ts DESC NULLS LAST, coalesce(ts, 0) DESC, id)", ITEMS_SQL)
def neighbours_newest(spark, d):
    return orders.neighbours(adapters.items(spark, d), "newest")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Blurry, dark or duplicate photos, the most suspicious first."""
    p = QueryParams(enabled={"blurry", "dark", "duplicates"}, lens="photo")
    return _shown(LibraryQuery(adapters.items(spark, d), p).ranked(), "rank").filter("rank <= 50")


# statistics

_HIST = "SELECT strftime(make_timestamp(ts * 1000), '{}') AS key, count(*) AS n FROM items WHERE ts IS NOT NULL GROUP BY 1"


@query("stats_scalar", "SELECT count(*) AS total, count(*) FILTER (analyzed) AS analyzed, count(*) FILTER (is_video) AS videos, CAST(coalesce(sum(duration) FILTER (is_video), 0) AS BIGINT) AS video_seconds, count(*) FILTER (ts IS NULL) AS no_date, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (bytes > 0) AS sized FROM items", ITEMS_SQL)
def stats_scalar(spark, d):
    return stats.scalars(adapters.items(spark, d))


for _unit, _format in (("year", "%Y"), ("month", "%Y-%m"), ("day", "%Y-%m-%d")):
    query(f"stats_{_unit}", _HIST.format(_format), ITEMS_SQL)(lambda spark, d, unit=_unit: stats.histogram(adapters.items(spark, d), unit))


@query("stats_histograms", " UNION ALL ".join(f"SELECT '{u}' AS unit, * FROM ({_HIST.format(f)})" for u, f in (("year", "%Y"), ("month", "%Y-%m"), ("day", "%Y-%m-%d"))), ITEMS_SQL)
def stats_histograms(spark, d):
    return stats.histograms(adapters.items(spark, d))


@query("stats_weekday", "SELECT w AS weekday, count(ts) AS n FROM range(7) r(w) LEFT JOIN items ON dayofweek(make_timestamp(ts * 1000)) = w GROUP BY w", ITEMS_SQL)
def stats_weekday(spark, d):
    return stats.by_weekday(adapters.items(spark, d))


@query("stats_hour", "SELECT h AS hour, count(ts) AS n FROM range(24) r(h) LEFT JOIN items ON hour(make_timestamp(ts * 1000)) = h GROUP BY h", ITEMS_SQL)
def stats_hour(spark, d):
    return stats.by_hour(adapters.items(spark, d))


@query("stats_traits", "SELECT " + ", ".join(f"count(*) FILTER ({c}) AS \"{k}\"" for k, c in predicates_sql(QueryParams()).items() if k in stats.TRAITS) + " FROM items WHERE has_f", ITEMS_SQL)
def stats_traits(spark, d):
    return stats.traits(adapters.items(spark, d).withColumn("dup_selectable", F.lit(False)))


@query("busiest_days", f"SELECT * FROM ({_HIST.format('%Y-%m-%d')}) ORDER BY n DESC, key LIMIT 12", ITEMS_SQL)
def busiest_days(spark, d):
    return stats.busiest_days(adapters.items(spark, d))


@query("latest_months", f"SELECT * FROM ({_HIST.format('%Y-%m')}) ORDER BY key DESC LIMIT 24", ITEMS_SQL)
def latest_months(spark, d):
    return stats.latest_months(adapters.items(spark, d))


@query("no_date", "SELECT count(*) FILTER (ts IS NULL) AS undated, count(*) FILTER (ts IS NULL AND date_source IS NULL) AS legacy FROM items", ITEMS_SQL)
def no_date(spark, d):
    return stats.no_date(adapters.items(spark, d))


@query("group_sizes", "SELECT group_id, size FROM groups", ITEMS_SQL, GROUPS_SQL)
def group_sizes(spark, d):
    return stats.group_sizes(adapters.items(spark, d))


_FACE = f"analyzed AND url IS NOT NULL AND {_PHOTO} AND coalesce(fs, 0) >= 0.35"


@query("progress", f"""
SELECT total, analysed, pending, face_total, face_done, face_total - face_done AS face_pending, CAST(analysed + face_done AS DOUBLE) / (total + face_total) AS ratio,
  total + face_total > 0 AND pending = 0 AND face_done >= face_total AS complete
FROM (SELECT count(*) AS total, count(*) FILTER (analyzed) AS analysed, count(*) FILTER (NOT analyzed AND url IS NOT NULL) AS pending, count(*) FILTER ({_FACE}) AS face_total, count(*) FILTER ({_FACE} AND people_scanned) AS face_done FROM items)""", ITEMS_SQL)
def progress(spark, d):
    return stats.progress(adapters.items(spark, d))


@query("cleanup_score", """
SELECT total, caught, CAST(caught AS DOUBLE) * 100 / total AS share, CASE WHEN caught = 0 THEN 'No matches' WHEN caught * 100.0 / total >= 25 THEN 'Big clean-up ahead' WHEN caught * 100.0 / total >= 8 THEN 'Good potential' ELSE 'A few catches' END AS verdict
FROM (SELECT (SELECT count(*) FROM items) AS total, (SELECT count(*) FROM found) AS caught)""", ITEMS_SQL, pool_sql(FOUND), found_sql(FOUND))
def cleanup_score(spark, d):
    items = adapters.items(spark, d)
    caught = LibraryQuery(items, FOUND, spark.range(0)).matches().agg(F.count("*").alias("caught"))
    return stats.cleanup_score(items.agg(F.count("*").alias("total")).crossJoin(caught))  # a row each


@query("storage_line", "SELECT CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (bytes > 0) AS measured, count(*) AS total FROM items", ITEMS_SQL)
def storage_line(spark, d):
    return stats.storage_line(adapters.items(spark, d))


@query("failure_reasons", "SELECT analysis_error AS reason, count(*) AS n FROM items WHERE analysis_error IS NOT NULL GROUP BY 1", ITEMS_SQL)
def failure_reasons(spark, d):
    return stats.failures(adapters.items(spark, d))


# near duplicates

_DOC = dict(source="ditems", ts="ts", score="lap")


@query("dup_pairs", "SELECT a, b FROM near", DOCUMENT_ITEMS_SQL, *dup_sql(8, 80, **_DOC))
def dup_pairs(spark, d):
    return duplicates.pairs(adapters.document_items(spark, d)).select("a", "b")


@query("dup_groups", "SELECT root, id FROM dup", DOCUMENT_ITEMS_SQL, *dup_sql(8, 1000, **_DOC))
def dup_groups(spark, d):
    return duplicates.groups(adapters.document_items(spark, d), window=1000).select("root", "id")


@query("dup_pairs_near", "SELECT a, b FROM near", adapters.BURST_ITEMS_SQL, *dup_sql(8, 80, **_DOC))
def dup_pairs_near(spark, d):
    """Pairs on both sides of both thresholds."""
    return duplicates.pairs(adapters.burst_items(spark, d)).select("a", "b")


@query("dup_groups_near", "SELECT root, id FROM dup", adapters.BURST_ITEMS_SQL, *dup_sql(5, 80, **_DOC))
def dup_groups_near(spark, d):
    return duplicates.groups(adapters.burst_items(spark, d), distance=5).select("root", "id")


@query("dup_groups_incremental", "SELECT root, id FROM dup", adapters.BURST_ITEMS_SQL, *dup_sql(5, 80, **_DOC))
def dup_groups_incremental(spark, d):
    """Sets of a state without every seventh item, with others besides and some at another time, refreshed to the items."""
    items = adapters.burst_items(spark, d)
    n = F.col("id").cast("long")
    moved = F.when(n % 50 == 0, F.col("ts") + 30).otherwise(F.col("ts"))
    before = items.filter(n % 7 != 0).withColumn("ts", moved)
    gone = items.filter(n % 40 == 1).withColumn("id", F.concat(F.lit("gone"), F.col("id")))
    return duplicates.NearDuplicates.of(before.unionByName(gone), distance=5).refreshed(items).sets.select("root", "id")


for _keep in ("sharpest", "first", "last"):

    @query(f"dup_keepers_{_keep}", "SELECT root, id FROM keepers", DOCUMENT_ITEMS_SQL, *dup_sql(8, 1000, _keep, **_DOC))
    def dup_keepers(spark, d, keep=_keep):
        items = adapters.document_items(spark, d)
        return duplicates.keepers(duplicates.groups(items, window=1000), items, keep)


@query("dup_selectable", "SELECT root, id FROM selectable", ITEMS_SQL, *dup_sql(8, 80))
def dup_selectable(spark, d):
    return LibraryQuery(adapters.items(spark, d), QueryParams()).selectable


@query("dup_set_sizes", "SELECT id, count(*) OVER (PARTITION BY root) AS similar_size FROM dup", ITEMS_SQL, *dup_sql(8, 80))
def dup_set_sizes(spark, d):
    return duplicates.set_sizes(LibraryQuery(adapters.items(spark, d), QueryParams()).duplicate_sets)


@query("hamming", """
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(CAST('0x' || substr(a.dhash, 1, 8) AS BIGINT), CAST('0x' || substr(b.dhash, 1, 8) AS BIGINT))) + bit_count(xor(CAST('0x' || substr(a.dhash, 9, 8) AS BIGINT), CAST('0x' || substr(b.dhash, 9, 8) AS BIGINT))) AS BIGINT) AS bits
FROM ditems a JOIN ditems b ON b.ts = a.ts + 1""", DOCUMENT_ITEMS_SQL)
def hamming(spark, d):
    i = adapters.document_items(spark, d).select("id", "ts", F.col("features.dhash").alias("h"))
    b = i.select(F.col("id").alias("b"), (F.col("ts") - 1).alias("ts"), F.col("h").alias("hb"))
    return i.join(b, "ts").select(F.col("id").alias("a"), "b", S.hamming(F.col("h"), F.col("hb")).cast("long").alias("bits"))


# people

_CENTROIDS = [
    FACES_SQL,
    "u AS (SELECT id, photo_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM faces)",
    "s AS (SELECT label, i, sum(v[i]) AS x FROM u, range(1, 65) r(i) GROUP BY label, i)",
    "n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM s GROUP BY label)",
    "c AS (SELECT label, list(x / norm ORDER BY i) AS c FROM s JOIN n USING (label) GROUP BY label)",
    "far AS (SELECT u.id, u.photo_id, u.label, c.label AS g, 1 - list_sum(list_transform(range(1, 65), lambda i: u.v[i] * c.c[i])) AS dist FROM u, c)",
]


def _labelled(spark, d):
    faces = adapters.faces(spark, d)
    return faces, people.centroids(faces, "label").withColumnRenamed("label", "group_id")


@query("face_centroids", "SELECT label AS group_id, CAST(i - 1 AS BIGINT) AS i, round(x / norm, 5) AS x FROM s JOIN n USING (label)", *_CENTROIDS)
def face_centroids(spark, d):
    return _labelled(spark, d)[1].select("group_id", F.posexplode("centroid").alias("i", "x")).select("group_id", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


@query("face_spread", "SELECT g AS group_id, count(*) AS size, round(avg(dist), 5) AS spread FROM far WHERE label = g GROUP BY g", *_CENTROIDS)
def face_spread(spark, d):
    faces, c = _labelled(spark, d)
    near = S.cosine_distance(S.normalised(F.col("vector")), F.col("centroid"))
    return faces.join(c, faces.label == c.group_id).groupBy("group_id").agg(F.count("*").alias("size"), F.round(F.avg(near), 5).alias("spread"))


@query("face_assign", "SELECT id, g AS group_id, round(dist, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, g) AS k FROM far) WHERE k = 1 AND dist <= 0.75", *_CENTROIDS)
def face_assign(spark, d):
    faces, c = _labelled(spark, d)
    return people.assign(faces, c, people.SHIPPED_EPS).select("id", "group_id", F.round("distance", 5).alias("distance"))


@query("people_by_photo", "SELECT photo_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS people FROM faces GROUP BY photo_id", FACES_SQL)
def people_by_photo(spark, d):
    groups = adapters.faces(spark, d).groupBy(F.col("label").alias("group_id")).agg(F.collect_set("photo_id").alias("photo_ids"))
    return people.people_by_photo(groups).select("photo_id", F.array_join("people", ",").alias("people"))


@query("face_clusters", """
SELECT group_id, count(*) AS size, floor(avg(d) * 10000 + 0.5) / 10000 AS spread, string_agg(DISTINCT photo_id, ',' ORDER BY photo_id) AS photo_ids FROM clusters GROUP BY group_id""", adapters.FACES_SQL, adapters.CLUSTERS_SQL)
def face_clusters(spark, d):
    groups = people.report(people.cluster_faces(adapters.faces(spark, d), people.SHIPPED_EPS))
    return groups.select("group_id", "size", "spread", F.array_join("photo_ids", ",").alias("photo_ids"))


@query("regroup", """
SELECT f.photo_id, coalesce(people, '') AS people FROM (SELECT DISTINCT photo_id FROM faces) AS f LEFT JOIN (
  SELECT photo_id, string_agg(CAST(group_id AS VARCHAR), ',' ORDER BY group_id) AS people FROM (SELECT DISTINCT photo_id, group_id FROM clusters) GROUP BY photo_id) AS p USING (photo_id)""", adapters.FACES_SQL, adapters.CLUSTERS_SQL)
def regroup(spark, d):
    return people.regroup(adapters.faces(spark, d))[1].select("photo_id", F.array_join("people", ",").alias("people"))


#: Old names: two for three labels' faces, with the centroids that those have; the choice as a walk over the groups.
_NAMED_SQL = """
old AS (
  SELECT 'N' || third || '-' || m AS name, list(x / norm ORDER BY i) AS o FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY third, m)) AS norm
    FROM (SELECT label // 3 AS third, CAST(id AS BIGINT) % 2 AS m, i, sum(v[i]) AS x FROM u, range(1, 65) r(i) GROUP BY ALL)) GROUP BY third, m
), edges AS (
  SELECT label AS g, list({'d': d, 'n': name} ORDER BY d, name) AS e FROM (SELECT label, name, 1 - list_sum(list_transform(range(1, 65), lambda i: c.c[i] * old.o[i])) AS d FROM c, old) WHERE d <= 0.75 GROUP BY label
), walk AS (
  WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY g) AS k FROM edges), w AS (
    SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS INTEGER) AS g, CAST(NULL AS VARCHAR) AS name, CAST([] AS VARCHAR[]) AS used
    UNION ALL
    SELECT o.k, o.g, f, CASE WHEN f IS NULL THEN used ELSE list_append(used, f) END
    FROM (SELECT w.used, o.*, list_filter(o.e, lambda x: NOT list_contains(w.used, x.n))[1].n AS f FROM w JOIN o ON o.k = w.k + 1) AS o
  )
  SELECT g, name FROM w
)"""


@query("carried_names", "SELECT label AS group_id, name FROM (SELECT DISTINCT label FROM faces) LEFT JOIN walk ON g = label", *_CENTROIDS, _NAMED_SQL)
def carried_names(spark, d):
    faces, groups = _labelled(spark, d)
    third = F.floor(F.col("label") / 3).cast("string")
    named = faces.select("vector", F.concat(F.lit("N"), third, F.lit("-"), (F.col("id").cast("long") % 2).cast("string")).alias("name"))
    return people.carry_names(groups, people.centroids(named, "name"), people.SHIPPED_EPS).select("group_id", "name")


# decisions

_DISPOSITION = "CASE WHEN NOT coalesce(is_owned, true) THEN 'notOwned' WHEN coalesce(dedup_key, '') = '' THEN 'noKey' ELSE 'deletable' END"


@query("plan_trash", f"SELECT id, dedup_key, {_DISPOSITION} AS disposition, bytes FROM items", ITEMS_SQL)
def plan_trash(spark, d):
    return decisions.plan(adapters.items(spark, d))


@query("plan_trash_summary", f"""
SELECT *, {_UNITS} AS text FROM (SELECT *, CAST(bytes AS DOUBLE) AS v FROM (SELECT count(*) FILTER (p = 'deletable') AS deletable, count(*) FILTER (p = 'noKey') AS no_key, count(*) FILTER (p = 'notOwned') AS not_owned, CAST(sum(bytes) FILTER (p = 'deletable') AS BIGINT) AS bytes, count(*) FILTER (p = 'deletable' AND bytes > 0) AS sized FROM (SELECT *, {_DISPOSITION} AS p FROM items)))""".replace("SELECT *, CASE WHEN v", "SELECT * EXCLUDE (v), CASE WHEN v", 1), ITEMS_SQL)
def plan_trash_summary(spark, d):
    return decisions.summary(decisions.plan(adapters.items(spark, d)))


_CHUNKS_SQL = """
chunked AS (
  SELECT *, first_value(dedup_key) OVER (PARTITION BY k ORDER BY id) AS head FROM (SELECT id, dedup_key, (row_number() OVER (ORDER BY id) - 1) // 100 AS k FROM (SELECT id, dedup_key, {disposition} AS p FROM items) WHERE p = 'deletable')
)""".replace("{disposition}", _DISPOSITION)


@query("trash_outcomes", "SELECT id, dedup_key, CASE WHEN right(head, 1) IN ('3', '7') THEN 'failed' ELSE 'done' END AS outcome, CASE WHEN right(head, 1) IN ('3', '7') THEN 'refused ' || head END AS error FROM chunked", ITEMS_SQL, _CHUNKS_SQL)
def trash_outcomes(spark, d):
    """Chunks sent to an action that refuses some; the run is repeated, which sends only those again."""

    def action(keys):
        if keys[0][-1] in "37":
            raise OSError(f"refused {keys[0]}")

    planned = decisions.plan(adapters.items(spark, d))
    log = orders.shared_folder(planned)
    for _ in range(2):
        outcomes = decisions.run_sink(planned, action, log)
    return outcomes.select("id", "dedup_key", "outcome", "error")


@query("selection_trim", "SELECT id FROM items WHERE CAST(id AS BIGINT) % 10 = 0 AND id IN (SELECT id FROM found)", ITEMS_SQL, pool_sql(FOUND), found_sql(FOUND))
def selection_trim(spark, d):
    items = adapters.items(spark, d)
    selection = items.filter(F.col("id").cast("long") % 10 == 0).select("id")
    return decisions.trim_selection(selection, LibraryQuery(items, FOUND, spark.range(0)).matches())


@query("keep_rest", "SELECT id FROM found WHERE CAST(id AS BIGINT) % 10 <> 0", ITEMS_SQL, pool_sql(FOUND), found_sql(FOUND))
def keep_rest(spark, d):
    items = adapters.items(spark, d)
    selection = items.filter(F.col("id").cast("long") % 10 == 0).select("id")
    return decisions.keep_rest(LibraryQuery(items, FOUND, spark.range(0)).matches(), selection)


@query("shift_range", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY coalesce(ts, 0) DESC, id) AS r, max(CASE WHEN id = '5' THEN rn WHEN id = '99' THEN rn END) OVER () AS hi, min(CASE WHEN id = '5' THEN rn WHEN id = '99' THEN rn END) OVER () AS lo FROM (SELECT *, row_number() OVER (ORDER BY coalesce(ts, 0) DESC, id) AS rn FROM items)) WHERE r BETWEEN lo AND hi", ITEMS_SQL)
def shift_range(spark, d):
    ranked = orders.with_rank(adapters.items(spark, d).select("id", "ts"), orders.grid_order())
    return decisions.shift_range(ranked, "5", "99")


from lumisift.plans import details as _details, passes as _passes  # noqa: E402,F401  these register their queries too
