"""SimHash near-dedup over a vantage-point tree of fingerprints.

Equal fingerprints collapse first. A tree whose vantage points and radii come from a bounded sample cuts the rest into
shards: a fingerprint is stored in one leaf, and where its distance to a vantage point is so near the radius that the
triangle inequality can't rule out partners on the other side, a copy visits that side too. Each leaf finds its exact pairs
with the same rule on further vantage points and then block by block, and returns only a spanning forest of them. The
forests' links become components by repeated hooking and pointer jumping on tables in the shared folder.

Null and empty texts have fingerprint zero, linked like any other. A null doc_id gets a fingerprint, and the component of
the smallest doc_id there (null if none). Repeated rows each have their result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import blocks_of, byte_rows, saved, table

SHINGLE = 3
RADIUS = 2
#: Fingerprints from which the tree's vantage points and radii are taken, at least and for each leaf. They only place cuts.
TREE_SAMPLE, LEAF_SAMPLE = 20_000, 16
#: Fingerprints in a leaf of the distributed tree at most, about; in a leaf where that leaves cores idle; in a block that is compared pair
#: by pair. The copies that visit other sides grow with the number of leaves (README), so leaves are as large as a task can hold.
LEAF, SMALL_LEAF, BLOCK = 250_000, 8_000, 256


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(flat, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        of = xxhash.xxh64_intdigest
        hashes = [of(flat[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of these 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):  # bounds what is unpacked at once
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def rows(batches):
        for batch in blocks_of(batches, 8_000_000):
            fps = np.array([fingerprint(t, shingle) for t in byte_rows(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, fp long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _split(points: np.ndarray, seed: int):
    """A vantage point and the radius that best halves the points; None if they can't be cut."""
    vantage = points[(seed * 2654435761) % len(points)]
    d = np.sort(_distance(points, vantage))
    radius = int(d[(len(d) - 1) // 2])
    if radius == d[-1]:
        radius -= 1
    return (vantage, radius) if radius >= d[0] else None


def grow_tree(sample: np.ndarray, leaves: int, seed: int = 1) -> list:
    """Nodes (vantage point, radius, inner, outer) in breadth-first order; a child below zero is leaf -child - 1."""
    nodes, todo, made = [], [(sample, None)], 1
    slots = {}
    while todo:
        points, where = todo.pop(0)
        cut = _split(points, seed + len(nodes)) if made < leaves and len(points) > 3 else None
        if cut is None:
            slots[where] = None
            continue
        k = len(nodes)
        nodes.append([*cut, None, None])
        if where is not None:
            nodes[where[0]][where[1]] = k
        d = _distance(points, cut[0])
        todo += [(points[d <= cut[1]], (k, 2)), (points[d > cut[1]], (k, 3))]
        made += 1
    leaf = 0
    for node in nodes:
        for side in (2, 3):
            if node[side] is None:
                leaf += 1
                node[side] = -leaf
    return nodes


def route(fps: np.ndarray, nodes: list, radius: int):
    """(row, leaf, own): where each fingerprint is stored, and the leaves beyond a boundary that a copy of it visits.

    Of a pair that a radius parts, only the inner one visits the outer side, so each pair meets in one leaf.
    """
    if not nodes:
        return np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    found = []
    todo = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        k, rows, own = todo.pop()
        if not len(rows):
            continue
        if k < 0:
            found.append((rows, np.full(len(rows), -k - 1), own))
            continue
        vantage, cut, inner, outer = nodes[k]
        d = _distance(fps[rows], vantage)
        near = d > cut - radius
        inside = d <= cut
        todo.append((inner, rows[inside | (~own & (d <= cut + radius))], own[inside | (~own & (d <= cut + radius))]))
        go = ~inside | near
        todo.append((outer, rows[go], (own & ~inside)[go]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(fps: np.ndarray, own: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (own with own or visitor) within the radius, as pairs of places."""
    parent, links = np.arange(len(fps)), []

    def pairs(a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), BLOCK):
            left, right = np.nonzero(_distance(fps[a[i : i + BLOCK], None], fps[b][None, :]) <= radius)
            for x, y in zip(a[i : i + BLOCK][left].tolist(), b[right].tolist()):
                x, y = _find(parent, x), _find(parent, y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((x, y))

    todo = [(np.flatnonzero(own), np.flatnonzero(~own), 0)]
    while todo:
        mine, others, depth = todo.pop()
        cut = _split(fps[mine], depth + 7) if len(mine) > BLOCK and depth < 40 else None
        if cut is None:
            if len(mine):
                pairs(mine, np.concatenate([mine, others]))
            continue
        d, e = _distance(fps[mine], cut[0]), _distance(fps[others], cut[0])
        inside = d <= cut[1]
        todo.append((mine[inside], others[e <= cut[1] + radius], depth + 1))
        todo.append((mine[~inside], np.concatenate([others[e > cut[1] - radius], mine[inside & (d > cut[1] - radius)]]), depth + 1))
    return links


def links_of(distinct: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect all fingerprints (column fp, distinct) that differ in at most `radius` bits, a spanning forest a leaf."""
    leaves = max(1, -(-count // LEAF), min(distinct.sparkSession.sparkContext.defaultParallelism, count // SMALL_LEAF))
    wanted = max(TREE_SAMPLE, LEAF_SAMPLE * leaves)
    sample = distinct.filter(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(max(1, count // wanted))) == 0)
    nodes = grow_tree(np.sort(np.array([r.fp for r in sample.collect()], np.int64)).view(np.uint64), leaves) if leaves > 1 else []

    def deal(batches):
        for batch in batches:
            fps = np.asarray(batch.column("fp"))
            rows, leaf, own = route(fps.view(np.uint64), nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fps[rows]), pa.array(leaf.astype(np.int64)), pa.array(own)], names=["fp", "leaf", "own"])

    def leaf_links(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf.fp.to_numpy()
        found = np.array(_forest(fps.view(np.uint64), pdf.own.to_numpy(bool), radius), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fps[found[:, 0]], "b": fps[found[:, 1]]})

    return distinct.select("fp").mapInArrow(deal, "fp long, leaf long, own boolean").groupBy("leaf").applyInPandas(leaf_links, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of a link (a, b): root is the least node that can be reached.

    Each round hooks every root to the least root beside it and then jumps pointers; rounds grow with the logarithm of
    the longest path.
    """
    links = saved(links)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        a = label.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = label.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        crossing = links.join(a, "a").join(b, "b").filter("ra <> rb").select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("to"))
        hooks = saved(crossing.groupBy("root").agg(F.min("to").alias("to")))
        if hooks.isEmpty():  # a component's nodes share a root, and none is above its own node
            return label
        label = saved(label.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        up = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        label = saved(label.join(up, "root").select("node", F.col("up").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest doc_id that links of at most `radius` bits reach)."""
    fps = saved(fingerprints(docs, shingle))
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links_of(distinct, distinct.count(), radius))
    members = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = members.join(smallest, "root", "left").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple[int, str]], radius: int = RADIUS) -> dict[int, tuple[str, int]]:
    """The same rows from all pairs, for tests."""
    fps = {d: fingerprint((t or "").encode()) for d, t in docs}
    ids = sorted(fps)
    values = np.array([fps[d] for d in ids], np.uint64)
    parent = np.arange(len(ids))
    for i in range(len(ids)):
        for j in np.flatnonzero(_distance(values, values[i]) <= radius).tolist():
            x, y = _find(parent, i), _find(parent, j)
            parent[max(x, y)] = min(x, y)
    return {d: (f"{fps[d]:016x}", ids[_find(parent, i)]) for i, d in enumerate(ids)}
