"""Driver tables seen as a library: rules that Spark and SQL state alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows from events."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    i, k = F.col("event_id"), F.col("k")
    every = lambda n, r=0: i % n == r
    score = lambda p: ((k * p) % 100).cast("double") / F.lit(100.0)
    size = F.when(~every(7), F.floor(F.col("value") * F.lit(1e6)).cast("long"))
    digest = F.md5(F.concat(F.col("user_id").cast("string"), F.lit("-"), k.cast("string")).cast("binary"))
    features = F.struct(
        score(1).alias("face_score"), score(29).alias("screenshot_score"), score(53).alias("document_score"), score(7).alias("blur_score"), score(13).alias("dark_score"), score(37).alias("bright_score"),
        F.when(every(3), "ultraface").when(every(3, 1), "heuristic").alias("face_method"), ((k % 10).cast("double") / F.lit(100.0)).alias("skin_frac"), F.col("value").alias("lap_var"),
        (F.lit(1000) + k).cast("int").alias("nat_w"), F.lit(1000).alias("nat_h"), F.substring(digest, 1, 16).alias("dhash"), F.substring(digest, 17, 16).alias("ahash"),
    )
    return e.select(
        i.cast("string").alias("id"),
        F.when(~every(23), F.concat(F.lit("https://lh3.googleusercontent.com/p"), i.cast("string"), F.lit("=w100-h100"))).alias("url"),
        F.when(~every(20), F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"),
        F.when(~every(29), "api").alias("date_source"),
        (F.col("event_type") == "view").alias("is_video"),
        (~every(17)).alias("is_owned"),
        F.when(F.col("event_type") == "view", F.floor("value").cast("long")).alias("duration"),
        F.when(~every(13), F.concat(F.lit("d"), i.cast("string"))).alias("dedup_key"),
        size.alias("size_bytes"),
        F.when(every(3), F.floor(size / 2).cast("long")).alias("space_taken"),
        (~every(11)).alias("analyzed"),
        F.when(every(11), F.when(every(2), "timeout").otherwise("decode")).alias("analysis_error"),
        F.when(~every(11), features).alias("features"),
        F.when(every(5), None).when(every(5, 1), F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(F.array((F.col("user_id") % 40).cast("int"), (F.col("user_id") % 7).cast("int"))))).alias("people"),
        (every(2)).alias("people_scanned"),
        (every(19)).alias("kept"),
    )


ITEMS_SQL = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id AS i FROM events),
items AS (
  SELECT CAST(i AS VARCHAR) AS id, CASE WHEN i % 23 <> 0 THEN 'https://lh3.googleusercontent.com/p' || i || '=w100-h100' END AS url,
    CASE WHEN i % 20 <> 0 THEN epoch_us(ts) // 1000 END AS ts, CASE WHEN i % 29 <> 0 THEN 'api' END AS date_source,
    event_type = 'view' AS is_video, i % 17 <> 0 AS is_owned, CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END AS duration,
    CASE WHEN i % 13 <> 0 THEN 'd' || i END AS dedup_key, CASE WHEN i % 7 <> 0 THEN CAST(floor(value * 1e6) AS BIGINT) END AS size_bytes,
    CASE WHEN i % 3 = 0 AND i % 7 <> 0 THEN CAST(floor(value * 1e6) AS BIGINT) // 2 END AS space_taken, i % 11 <> 0 AS analyzed, i % 11 <> 0 AS has_f,
    CASE WHEN i % 11 = 0 THEN CASE WHEN i % 2 = 0 THEN 'timeout' ELSE 'decode' END END AS analysis_error,
    CASE WHEN i % 11 <> 0 THEN CAST((k * 1) % 100 AS DOUBLE) / 100 END AS fs, CASE WHEN i % 11 <> 0 THEN CAST((k * 7) % 100 AS DOUBLE) / 100 END AS bs,
    CASE WHEN i % 11 <> 0 THEN CAST((k * 13) % 100 AS DOUBLE) / 100 END AS dk, CASE WHEN i % 11 <> 0 THEN CAST((k * 29) % 100 AS DOUBLE) / 100 END AS ss,
    CASE WHEN i % 11 <> 0 THEN CAST((k * 37) % 100 AS DOUBLE) / 100 END AS br, CASE WHEN i % 11 <> 0 THEN CAST((k * 53) % 100 AS DOUBLE) / 100 END AS ds,
    CASE WHEN i % 11 <> 0 THEN CASE i % 3 WHEN 0 THEN 'ultraface' WHEN 1 THEN 'heuristic' END END AS fm,
    CASE WHEN i % 11 <> 0 THEN CAST(k % 10 AS DOUBLE) / 100 END AS skin, CASE WHEN i % 11 <> 0 THEN value END AS lap, CASE WHEN i % 11 <> 0 THEN 1000 + k END AS nw, 1000 AS nh,
    CASE WHEN i % 11 <> 0 THEN substr(md5(user_id || '-' || k), 1, 16) END AS dhash, CASE WHEN i % 11 <> 0 THEN substr(md5(user_id || '-' || k), 17, 16) END AS ahash,
    CASE WHEN i % 5 = 0 THEN NULL WHEN i % 5 = 1 THEN CAST([] AS INTEGER[]) ELSE list_sort(list_distinct([CAST(user_id % 40 AS INTEGER), CAST(user_id % 7 AS INTEGER)])) END AS people,
    i % 2 = 0 AS people_scanned, i % 19 = 0 AS kept,
    CAST(coalesce(nullif(CASE WHEN i % 3 = 0 AND i % 7 <> 0 THEN CAST(floor(value * 1e6) AS BIGINT) // 2 END, 0), nullif(CASE WHEN i % 7 <> 0 THEN CAST(floor(value * 1e6) AS BIGINT) END, 0), 0) AS BIGINT) AS bytes
  FROM e
)"""


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose fingerprints are those of document texts: exact copies are near duplicates."""
    d = table(spark, sf_dir, "documents")
    h = F.md5(F.col("text").cast("binary"))
    features = F.struct(F.substring(h, 1, 16).alias("dhash"), F.substring(h, 17, 16).alias("ahash"), F.col("n_chars").cast("double").alias("lap_var"), F.lit(0).alias("nat_w"), F.lit(0).alias("nat_h"))
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ts"), F.lit(False).alias("is_video"), features.alias("features"))


DOCUMENT_ITEMS_SQL = """
ditems AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ts, substr(md5(text), 1, 16) AS dhash, substr(md5(text), 17, 16) AS ahash, CAST(n_chars AS DOUBLE) AS lap FROM documents)"""


def burst_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of twelve items whose fingerprints drift apart: the k-th has its k lowest dhash bits and 2k lowest ahash bits flipped."""
    i = F.col("doc_id")
    digest = F.md5(F.floor(i / 12).cast("string").cast("binary"))

    def drifted(start: int, bits: int):
        base = F.conv(F.substring(digest, start, 13), 16, 10).cast("long")
        flipped = (F.pow(F.lit(2.0), (i % 12) * bits) - 1).cast("long")
        return F.lower(F.lpad(F.hex(base.bitwiseXOR(flipped)), 16, "0"))

    features = F.struct(drifted(1, 1).alias("dhash"), drifted(17, 2).alias("ahash"), F.col("n_chars").cast("double").alias("lap_var"), F.lit(0).alias("nat_w"), F.lit(0).alias("nat_h"))
    return table(spark, sf_dir, "documents").select(i.cast("string").alias("id"), i.alias("ts"), F.lit(False).alias("is_video"), features.alias("features"))


BURST_ITEMS_SQL = """
ditems AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ts, CAST(n_chars AS DOUBLE) AS lap,
    printf('%016x', xor(CAST('0x' || substr(h, 1, 13) AS BIGINT), CAST(pow(2, doc_id % 12) AS BIGINT) - 1)) AS dhash, printf('%016x', xor(CAST('0x' || substr(h, 17, 13) AS BIGINT), CAST(pow(2, (doc_id % 12) * 2) AS BIGINT) - 1)) AS ahash
  FROM (SELECT *, md5(CAST(doc_id // 12 AS VARCHAR)) AS h FROM documents)
)"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), (F.col("vec_id") % 200).cast("string").alias("photo_id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("vector"))


FACES_SQL = "faces AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(vec_id % 200 AS VARCHAR) AS photo_id, CAST(label AS INTEGER) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


#: Leader clustering and fusing as recursion: a cluster has its number, the sum of its unit vectors and its members' places.
CLUSTERS_SQL = """
clusters AS (
  WITH RECURSIVE ord AS (SELECT row_number() OVER (ORDER BY photo_id, id) AS i, id, photo_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM faces),
  lead_ AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT("no" INTEGER, s DOUBLE[], m BIGINT[])[]) AS c
    UNION ALL
    SELECT i, CASE WHEN len(c) = 0 OR list_min(d) > 0.75 THEN list_append(c, {'no': CAST(len(c) AS INTEGER), 's': u, 'm': [i]})
      ELSE list_transform(c, lambda x, j: CASE WHEN j = list_position(d, list_min(d)) THEN {'no': x."no", 's': list_transform(list_zip(x.s, u), lambda z: z[1] + z[2]), 'm': list_append(x.m, i)} ELSE x END) END
    FROM (SELECT o.i, o.u, l.c, list_transform(l.c, lambda x: 1 - greatest(-1, least(1, list_inner_product(x.s, o.u) / sqrt(list_inner_product(x.s, x.s))))) AS d FROM lead_ AS l JOIN ord AS o ON o.i = l.i + 1)
  ), fuse AS (
    SELECT 0 AS step, c FROM (SELECT c FROM lead_ ORDER BY i DESC LIMIT 1)
    UNION ALL
    SELECT step + 1, list_filter(list_transform(c, lambda x, j: CASE WHEN j = p // 100000 THEN {'no': x."no", 's': list_transform(list_zip(x.s, c[p % 100000].s), lambda z: z[1] + z[2]), 'm': list_concat(x.m, c[p % 100000].m)} ELSE x END), lambda x, j: j <> p % 100000)
    FROM (SELECT step, c, list_min(flatten(list_transform(range(1, len(c) + 1), lambda a: list_transform(range(a + 1, len(c) + 1), lambda b:
      CASE WHEN 1 - list_inner_product(c[a].s, c[b].s) / sqrt(list_inner_product(c[a].s, c[a].s) * list_inner_product(c[b].s, c[b].s)) <= 0.75 THEN a * 100000 + b END)))) AS p FROM fuse) WHERE p IS NOT NULL
  ), ended AS (SELECT unnest(c) AS c FROM (SELECT c FROM fuse ORDER BY step DESC LIMIT 1)), large AS (
    SELECT c, row_number() OVER (ORDER BY len(c.m) DESC, c."no") - 1 AS g FROM ended WHERE len(c.m) >= 2
  )
  SELECT CAST(g AS INTEGER) AS group_id, o.photo_id, 1 - list_inner_product(l.c.s, o.u) / sqrt(list_inner_product(l.c.s, l.c.s)) AS d
  FROM (SELECT g, c, unnest(c.m) AS i FROM large) AS l JOIN ord AS o ON o.i = l.i
)"""


def person_groups(items: DataFrame) -> DataFrame:
    """Groups as the items name them: size is the rows of each; even ones are named."""
    from lumisift.operators.stats import group_sizes

    return group_sizes(items).withColumn("name", F.when(F.col("group_id") % 2 == 0, F.concat(F.lit("N"), F.col("group_id").cast("string"))))


GROUPS_SQL = "groups AS (SELECT g AS group_id, count(*) AS size, CASE WHEN g % 2 = 0 THEN 'N' || g END AS name FROM (SELECT DISTINCT id, unnest(people) AS g FROM items) GROUP BY g)"
