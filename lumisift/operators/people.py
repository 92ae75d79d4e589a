"""People: clustering of face vectors, assignment to known groups, and what a library does with groups.

Leader clustering depends on the order of its input, so an exact run is one sequence, and up to SHARD faces it is that. Beyond, shards
of that size are clustered alone, each face in one shard by its own id, so a photo with many faces fills none. The shards' clusters are then
fused in rounds over the whole table: every cluster finds its nearest other by blocks of a matrix product, pairs that are
nearest to each other are fused at once, and only what touched them is held against the rest again. No round is one task; faces may be grouped
otherwise than by one sequence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumisift.functions.scalars import cosine_distance, normalised
from lumisift.operators.orders import with_rank
from lumisift.operators.shared import written
from lumisift.operators.products import distance, near, unit

#: The distance below which two faces are one person by default and as shipped, the ratio of it for merging
#: groups, the least size of a group, and the distance within which a group keeps a name.
DEFAULT_EPS, SHIPPED_EPS, MERGE_RATIO, MIN_SIZE, CARRY_EPS = 0.6, 0.75, 1.0, 2, 0.35
#: Faces in a shard.
SHARD = 20_000


def lead(vectors: np.ndarray, eps: float, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector in turn joins the nearest centroid within eps (the first of equals) or founds a cluster: labels, sums, centroids."""
    x = unit(vectors).astype(np.float32)
    w = np.ones(len(x), np.float32) if weights is None else weights.astype(np.float32)
    sums, centroids = np.zeros((16, x.shape[1]), np.float32), np.zeros((16, x.shape[1]))
    labels, k = np.empty(len(x), np.int64), 0
    for i, v in enumerate(x):
        best, at = 2.0, -1
        if k:
            d = 1 - np.clip(centroids[:k] @ v.astype(np.float64), -1, 1)
            at = int(d.argmin())
            best = d[at]
        if at < 0 or best > eps:
            if k == len(sums):
                sums, centroids = np.vstack([sums, np.zeros_like(sums)]), np.vstack([centroids, np.zeros_like(centroids)])
            at, k = k, k + 1
        sums[at] += v * w[i]
        centroids[at] = unit(sums[at])
        labels[i] = at
    return labels, sums[:k], centroids[:k]


#: Rows of centroids whose distances to all later ones are taken at once.
ROWS_AT_ONCE = 256


def fuse(sums: np.ndarray, centroids: np.ndarray, eps: float) -> np.ndarray:
    """Fuse the first pair of centroids within eps, again and again; the cluster that each one ends in.

    A scan from the start would find the same pairs: rows before the present one have no partner, so after two have been fused only
    the fused row can be new to them, and no later row has moved. That is a product of one row a fused pair, and of each row once.
    """
    sums, centroids, k = sums.copy(), centroids.copy(), len(sums)
    alive, into = np.ones(k, bool), np.arange(k)

    def first(lo: int, hi: int, a: int) -> int:
        for at in range(lo, hi, 4096):
            hit = np.flatnonzero(alive[at : min(at + 4096, hi)] & (distance(centroids[at : min(at + 4096, hi)], centroids[a]) <= eps))
            if len(hit):
                return at + int(hit[0])
        return -1

    for base in range(0, k, ROWS_AT_ONCE):
        close = distance(centroids[base : base + ROWS_AT_ONCE], centroids[base:]) <= eps
        for a in range(base, min(base + ROWS_AT_ONCE, k)):
            partners = np.flatnonzero(close[a - base, a - base + 1 :] & alive[a + 1 :]) if alive[a] else ()
            b = a + 1 + int(partners[0]) if len(partners) else -1
            while b >= 0:
                sums[a] += sums[b]
                centroids[a] = unit(sums[a])
                alive[b], into[b] = False, a
                earlier = first(0, a, a)
                a, b = (earlier, a) if earlier >= 0 else (a, first(a + 1, k, a))
    for i in range(k):  # what a cluster went into comes before it
        into[i] = into[into[i]]
    return into


def _shard(eps: float, merge_ratio: float):
    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["photo_id", "id"], ignore_index=True)
        labels, sums, centroids = lead(np.stack(pdf.vector), eps)
        labels = fuse(sums, centroids, eps * merge_ratio)[labels]
        shared = np.zeros((len(sums), sums.shape[1]))
        np.add.at(shared, labels, unit(np.stack(pdf.vector)))
        head = pd.Series(labels).duplicated().to_numpy()
        return pd.DataFrame(
            {"id": pdf.id, "photo_id": pdf.photo_id, "vector": pdf.vector, "cluster": pdf.shard.astype("int64") * (1 << 32) + labels, "sum": [None if again else shared[c] for c, again in zip(labels, head)]}
        )

    return cluster


def _fused_across(heads: DataFrame, eps: float) -> DataFrame:
    """(cluster, root) of clusters (cluster, sum), fused by pairs that are nearest to each other until no two are within eps.

    The nearest pair of all is nearest to each other, so every round fuses some.
    """
    least = lambda found: found.groupBy("id").agg(F.min(F.struct("distance", "key")).alias("n")).select("id", F.col("n.key").alias("key"), F.col("n.distance").alias("distance"))
    as_rows = lambda h: h.select(F.col("cluster").alias("id"), F.col("sum").alias("vector"))
    ends = written(heads.select("cluster", F.col("cluster").alias("root")))
    best = written(least(near(as_rows(heads), as_rows(heads).withColumnRenamed("id", "key"), eps, mutual=True)))
    while True:
        back = best.select(F.col("id").alias("key"), F.col("key").alias("id"))
        pairs = written(best.join(back, ["id", "key"]).filter("id < key").select(F.col("id").alias("into"), F.col("key").alias("gone")))
        if pairs.isEmpty():
            return ends
        joined = pairs.join(heads.select(F.col("cluster").alias("gone"), F.col("sum").alias("_more")), "gone").select(F.col("into").alias("cluster"), "_more")
        moved = heads.join(pairs.select(F.col("gone").alias("cluster")), "cluster", "left_anti").join(joined, "cluster", "left")
        heads = written(moved.select("cluster", F.when(F.col("_more").isNull(), F.col("sum")).otherwise(F.zip_with("sum", "_more", lambda x, y: x + y)).alias("sum")))
        ends = written(ends.join(pairs.withColumnRenamed("gone", "root"), "root", "left").select("cluster", F.coalesce("into", "root").alias("root")))
        gone, changed = pairs.select(F.col("gone").alias("id")), pairs.select(F.col("into").alias("id")).unionByName(pairs.select(F.col("gone").alias("id")))
        stale = best.join(changed.withColumnRenamed("id", "key"), "key", "left_semi").select("id")
        again = written(changed.unionByName(stale).distinct().join(gone, "id", "left_anti"))
        kept = best.join(again, "id", "left_anti").join(gone, "id", "left_anti")
        rows = as_rows(heads)
        best = written(least(kept.unionByName(near(rows.join(again, "id", "left_semi"), rows.withColumnRenamed("id", "key"), eps, mutual=True))))


def cluster_faces(faces: DataFrame, eps: float = DEFAULT_EPS, merge_ratio: float = MERGE_RATIO) -> DataFrame:
    """(id, photo_id, vector, cluster): faces (id, photo_id, vector) by person, singletons included.

    One shard is the exact sequence in order of (photo_id, id); with more, shards are dealt by id and their clusters fused across all.
    """
    shards = max(1, -(-faces.count() // SHARD))
    dealt = faces.select("id", "photo_id", "vector").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    kind = dict(faces.dtypes)
    local = dealt.groupBy("shard").applyInPandas(_shard(eps, merge_ratio), f"id {kind['id']}, photo_id {kind['photo_id']}, vector {kind['vector']}, cluster long, sum array<double>")
    if shards == 1:
        return local.drop("sum")
    local = written(local)
    ends = _fused_across(written(local.filter("sum is not null").select("cluster", "sum")), eps * merge_ratio)
    return local.drop("sum").join(ends, "cluster").select("id", "photo_id", "vector", F.col("root").alias("cluster"))


def centroids(members: DataFrame, by: str = "cluster") -> DataFrame:
    """(by, size, centroid): the unit vector along the sum of the members' unit vectors."""
    v = members.select(by, F.posexplode(normalised(F.col("vector"))).alias("i", "x"))
    summed = v.groupBy(by, "i").agg(F.sum("x").alias("x")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    sizes = members.groupBy(by).agg(F.count("*").alias("size"))
    return summed.join(sizes, by).select(by, "size", normalised(F.transform("v", lambda e: e["x"])).alias("centroid"))


def report(clustered: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Groups of at least min_size: group_id (rank by size, then first cluster), size, spread, centroid, members, photo_ids."""
    c = centroids(clustered)
    spread = clustered.join(c.select("cluster", "centroid"), "cluster").groupBy("cluster").agg(
        F.avg(cosine_distance(normalised(F.col("vector")), F.col("centroid"))).alias("s"), F.array_sort(F.collect_list("id")).alias("members"), F.array_sort(F.collect_set("photo_id")).alias("photo_ids")
    )
    large = c.filter(F.col("size") >= min_size)
    ranks = with_rank(large.select("cluster", "size"), [F.desc("size"), F.col("cluster").asc()], "place").select("cluster", (F.col("place") - 1).cast("int").alias("group_id"))
    out = large.join(ranks, "cluster").join(spread, "cluster")
    return out.select("group_id", "size", (F.floor(F.col("s") * 10_000 + 0.5) / 10_000).alias("spread"), "centroid", "members", "photo_ids")


def ungrouped(clustered: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    small = clustered.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") < min_size)
    return clustered.join(small, "cluster", "left_semi").select("id")


#: Bytes of centroids that are sent to every task; more meet the faces block by block. Faces that meet them at once.
CENTROID_BYTES, FACES_AT_ONCE = 32 << 20, 4096


def _nearest(ids: list, table: Broadcast, eps: float):
    """The nearest of these centroids for each face, by blocks of a matrix product."""

    def rows(batches):
        own = table.value
        for batch in batches:
            for at in range(0, batch.num_rows, FACES_AT_ONCE):
                part = batch.slice(at, FACES_AT_ONCE)
                d = distance(unit(np.stack(part.column("vector").to_numpy(zero_copy_only=False))), own)
                best = d.argmin(axis=1)  # the first of equals
                least = d[np.arange(len(best)), best]
                keep = np.flatnonzero(least <= eps)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(keep)), pa.array([ids[k] for k in best[keep]], pa.int64()), pa.array(least[keep])], names=["id", "group_id", "distance"])

    return rows


def assign(faces: DataFrame, groups: DataFrame, eps: float = DEFAULT_EPS) -> DataFrame:
    """(id, group_id, distance) of the nearest group (group_id, centroid) within eps; the first of equals. Others stay out.

    Centroids of at most CENTROID_BYTES are broadcast; beyond that blocks of faces and of centroids are cogrouped. Either way the
    faces are read in one pass.
    """
    rows = groups.select(F.col("group_id").cast("long").alias("key"), F.col("centroid").alias("vector"))
    first = rows.select(F.size("vector").alias("n")).first()
    kinds = dict(faces.dtypes)["id"], dict(groups.dtypes)["group_id"]
    if not first:
        return faces.sparkSession.createDataFrame([], f"id {kinds[0]}, group_id {kinds[1]}, distance double")
    if rows.count() * 8 * first.n <= CENTROID_BYTES:
        own = sorted((r.key, r.vector) for r in rows.collect())  # CENTROID_BYTES at most
        table = faces.sparkSession.sparkContext.broadcast(unit(np.array([v for _, v in own])))
        found = faces.select("id", "vector").mapInArrow(_nearest([k for k, _ in own], table, eps), f"id {kinds[0]}, group_id long, distance double")
    else:
        found = near(faces.select("id", "vector"), rows, eps).withColumnRenamed("key", "group_id")
    best = found.groupBy("id").agg(F.min(F.struct("distance", "group_id")).alias("b"))
    return best.select("id", F.col("b.group_id").cast(kinds[1]).alias("group_id"), "b.distance")


def carry_names(groups: DataFrame, previous: DataFrame, eps: float = CARRY_EPS) -> DataFrame:
    """groups with name: in order of group_id each takes the nearest unused old name within eps. previous: name, centroid.

    The sequence is run as rounds over the pairs within eps: where a group's nearest name has no earlier group left within reach,
    the two are fixed and leave with all their pairs. The first group that is left is always such a one, and most are at once. Of equally
    near names the first by text is taken; a name that is there twice can be given twice.
    """
    old = written(previous.filter("name is not null and centroid is not null").select("name", F.col("centroid").alias("vector"), F.monotonically_increasing_id().alias("key")))
    met = near(groups.select(F.col("group_id").alias("id"), F.col("centroid").alias("vector")), old.select("key", "vector"), eps, nearest=False)
    pairs = written(met.join(old.select("key", "name"), "key"))
    chosen = None
    while not pairs.isEmpty():
        nearest = pairs.groupBy("id").agg(F.min(F.struct("distance", "name", "key")).alias("n")).select("id", "n.key", "n.name")
        earliest = pairs.groupBy("key").agg(F.min("id").alias("id"))
        fixed = written(nearest.join(earliest, ["id", "key"]))
        chosen = fixed if chosen is None else chosen.unionByName(fixed)
        pairs = written(pairs.join(fixed.select("id"), "id", "left_anti").join(fixed.select("key"), "key", "left_anti"))
    out = groups.drop("name")
    if chosen is None:
        return out.withColumn("name", F.lit(None).cast("string"))
    return out.join(chosen.select(F.col("id").alias("group_id"), "name"), "group_id", "left")


def people_by_photo(groups: DataFrame) -> DataFrame:
    """(photo_id, people): ascending group ids of each photo in a group; photos in none are absent."""
    return groups.select("group_id", F.explode("photo_ids").alias("photo_id")).groupBy("photo_id").agg(F.sort_array(F.collect_set(F.col("group_id").cast("int"))).alias("people"))


def regroup(faces: DataFrame, previous: DataFrame | None = None, eps: float = SHIPPED_EPS) -> tuple[DataFrame, DataFrame]:
    """Groups with carried names, and (photo_id, people) of every photo with a face: an empty list where none is in a group."""
    groups = report(cluster_faces(faces, eps))
    groups = carry_names(groups, previous) if previous is not None else groups.withColumn("name", F.lit(None).cast("string"))
    photos = faces.select("photo_id").distinct().join(people_by_photo(groups), "photo_id", "left")
    return groups, photos.select("photo_id", F.coalesce("people", F.array().cast("array<int>")).alias("people"))


def for_display(groups: DataFrame, items: DataFrame) -> DataFrame:
    """Groups with cover: the first three photo ids that have a URL."""
    photos = groups.select("group_id", F.posexplode("photo_ids").alias("pos", "id")).join(items.filter("url is not null").select("id"), "id", "left_semi")
    w = Window.partitionBy("group_id").orderBy("pos")
    first = photos.withColumn("k", F.row_number().over(w)).filter("k <= 3").groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("cover"))
    return groups.join(first, "group_id", "left").withColumn("cover", F.coalesce("cover", F.array().cast("array<string>")))
