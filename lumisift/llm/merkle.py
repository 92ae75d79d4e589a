"""Merkle manifest of a dataset: one tree a source, one over the sources' roots, and each row's proof.

Nodes lie in blocks of FAN ** DEPTH consecutive ones. A block is one row with an ordered array, which higher-order functions
collapse level by level (sequence, transform, slice, aggregate); the blocks' roots are the nodes of the next round, until a tree
is one node. Paths come back the same way: a block's own path above it, and within it one step a level, so a row's proof and
the root folded from it need no join of rows with nodes. A round shrinks a tree by FAN ** DEPTH, so three rounds take 6 * 10**10 rows.

A source of any size is dealt by range of doc_id (placing.placed). Nulls: a field is `-`; a null source has a tree of its own,
before all others; a null doc_id comes before other doc_ids and is never tampered with. Rows that share a doc_id are ordered by
their leaves, so equal rows take neighbouring places, in either order. No rows: no tree, no result. Further columns are not read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import saved, table
from lumisift.llm.placing import placed
from lumisift.llm.quality_rules import let

#: Nodes of a run, and levels that one block collapses.
FAN, DEPTH = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,after:string>"


def hashed(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row's fields, each with its length."""

    def framed(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return hashed(F.concat(*map(framed, fields)))


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def leaves_of(docs: DataFrame, every: int = 5) -> DataFrame:
    """(tree, source, doc_id, leaf, changed): changed is the leaf after tampering, where `every` divides the doc_id's crc32.

    tree orders as sources do, null first, and is not null.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    after = [lowered(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("source"),
        F.col("doc_id"),
        leaf_of([F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(tampered, leaf_of(after)).alias("changed"),
    )


def _runs(nodes: Column) -> Column:
    """Slices of FAN nodes, the last one shorter."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(starts, lambda r: F.slice(nodes, r * FAN + 1, F.lit(FAN)))


def _collapsed(nodes: Column) -> Column:
    return F.transform(_runs(nodes), lambda run: hashed(F.array_join(run, "")))


def _levels_of(total: Column) -> Column:
    """Levels that a block of a tree of so many nodes collapses: all, or as many as leave one node."""
    return reduce(lambda out, level: F.when(total <= FAN**level, F.lit(level)).otherwise(out), range(DEPTH - 1, -1, -1), F.lit(DEPTH))


def _with_levels(blocks: DataFrame) -> DataFrame:
    """blocks (total, items) with the nodes of all levels as arrays __0 to __DEPTH; the last has one node."""
    out = blocks.withColumn("__levels", _levels_of(F.col("total"))).withColumn("__0", F.transform("items", lambda x: x["node"]))
    for level in range(DEPTH):
        out = out.withColumn(f"__{level + 1}", F.when(F.col("__levels") > level, let(F.col(f"__{level}"), _collapsed)).otherwise(F.col(f"__{level}")))
    return out


def _step(run: Column, j: Column) -> Column:
    """What stands left and right of a node within its run."""
    return F.struct(F.array_join(F.slice(run, F.lit(1), j), "").alias("before"), F.array_join(F.slice(run, j + 2, F.lit(FAN)), "").alias("after"))


def _below(nodes: Column, above: Column) -> Column:
    """The nodes' paths, given those of the level above."""
    return F.flatten(F.transform(_runs(nodes), lambda run, r: F.transform(run, lambda _, j: F.concat(F.array(_step(run, j)), F.get(above, r)))))


def _with_paths(blocks: DataFrame) -> DataFrame:
    """blocks with levels and the path above them (`upper`), with the paths of their nodes at level 1 (of the one node, where there is none) as __paths."""
    out = blocks.withColumn("__paths", F.array("upper"))
    for level in range(DEPTH - 1, 0, -1):
        nodes = F.col(f"__{level}")
        own = let(F.col("__paths"), lambda above: _below(nodes, above))  # noqa: B023
        out = out.withColumn("__paths", F.when(F.col("__levels") > level, own).otherwise(F.col("__paths")))
    return out


def _finished(blocks: DataFrame, finish) -> DataFrame:
    """Rows of finish(item, path) for each item of the blocks; finish may name columns of the block."""

    def of_runs(above: Column) -> Column:
        own = lambda run, r: F.transform(F.slice("items", r * FAN + 1, F.lit(FAN)), lambda x, j: finish(x, F.concat(F.array(_step(run, j)), F.get(above, r))))
        return F.flatten(F.transform(_runs(F.col("__0")), own))

    alone = F.transform("items", lambda x: finish(x, F.get("__paths", F.lit(0))))
    return blocks.select(F.inline(F.when(F.col("__levels") > 0, let(F.col("__paths"), of_runs)).otherwise(alone)))


def _blocked(nodes: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(tree, block, total, items): consecutive nodes (tree, place, total, node) with what to keep of each, in order."""
    row = F.struct("place", "node", *keep)
    return nodes.groupBy("tree", F.floor(F.col("place") / FAN**DEPTH).alias("block")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(row)).alias("items"))


def _roots(nodes: DataFrame) -> DataFrame:
    return _with_levels(_blocked(nodes)).select("tree", F.col("block").alias("place"), "total", F.get(f"__{DEPTH}", F.lit(0)).alias("node"))


def _rounds(nodes: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Each round's nodes and the roots of their blocks; and (tree, node) of all trees' roots."""
    size, rounds, roots = FAN**DEPTH, [], None
    while True:
        found = saved(_roots(nodes))
        rounds.append((nodes, found))
        done = found.filter(F.col("total") <= size).select("tree", "node")
        roots = done if roots is None else roots.unionByName(done)
        nodes = found.filter(F.col("total") > size).withColumn("total", F.ceil(F.col("total") / size).cast("long"))
        if nodes.isEmpty():
            return rounds, saved(roots)


def _paths(rounds: list[tuple[DataFrame, DataFrame]], ends: DataFrame) -> DataFrame:
    """(tree, block, upper) of the first round's blocks; ends: (tree, upper) of the trees' roots."""
    above = None
    for nodes, found in reversed(rounds):
        finished = found.filter(F.col("total") <= FAN**DEPTH).select("tree", F.col("place").alias("block"))
        uppers = finished.join(ends, "tree")
        if above is not None:
            blocks = _with_paths(_with_levels(_blocked(above[0]).join(above[1], ["tree", "block"])))
            uppers = uppers.unionByName(_finished(blocks, lambda x, path: F.struct(F.col("tree"), x["place"].alias("block"), path.alias("upper"))))
        above = nodes, saved(uppers)
    return above[1]


def _folded(path: Column, start: Column) -> Column:
    return F.aggregate(path, start, lambda node, step: hashed(F.concat(step["before"], node, step["after"])))


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves as leaves_of() gives them, with subroot, root, proof (the digest of all siblings, left to right and level by level) and the root folded from what was changed."""
    rows = placed(saved(leaves), "tree", [F.col("doc_id").asc(), F.col("leaf").asc()])
    totals = rows.groupBy("tree").agg(F.count("*").alias("total"))
    nodes = rows.join(saved(totals), "tree").withColumn("node", F.col("leaf"))
    rounds, subroots = _rounds(nodes)

    # the tree over the sources' roots, which gives each of them its path
    sources = placed(subroots.select(F.lit("").alias("over"), "tree", "node"), "over", [F.col("tree").asc()])
    sources = sources.select(F.col("over").alias("tree"), F.col("tree").alias("name"), "node", "place", F.lit(subroots.count()).alias("total"))
    top, whole = _rounds(sources)
    root = whole.first()
    ends = _paths(top, whole.select("tree", F.array().cast(f"array<{STEP}>").alias("upper")))
    blocks = _with_paths(_with_levels(_blocked(sources, ["name"]).join(ends, ["tree", "block"])))
    named = saved(_finished(blocks, lambda x, path: F.struct(x["name"].alias("tree"), x["node"].alias("subroot"), path.alias("upper"))))

    def finish(x: Column, path: Column) -> Column:
        proof = lambda p: hashed(F.array_join(F.transform(p, lambda s: F.concat(s["before"], s["after"])), ""))
        fields = [x[c].alias(c) for c in ("source", "doc_id", "leaf")] + [F.col("subroot")]
        return let(path, lambda p: F.struct(*fields, proof(p).alias("proof"), _folded(p, F.coalesce(x["changed"], x["leaf"])).alias("folded")))

    uppers = _paths(rounds, named.select("tree", "upper")).join(named.select("tree", "subroot"), "tree")
    blocks = _with_paths(_with_levels(_blocked(nodes, ["source", "doc_id", "leaf", "changed"]).join(uppers, ["tree", "block"])))
    return _finished(blocks, finish).withColumn("root", F.lit(root and root.node).cast("string"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    out = manifest(leaves_of(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), d AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])) AS register
  FROM documents, crc
), f AS (
  SELECT doc_id, source, text, low, xor(register, 4294967295) % 5 = 0 AS tampered,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head
  FROM d
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS start
  FROM f
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, coalesce('=' || source, '') AS tree FROM leaves
), low AS (
  SELECT tree, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 15) // 16 FROM low WHERE n > 1 GROUP BY tree, level, place // 16
), subroots AS (
  SELECT tree, node AS subroot, level AS depth, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, place, subroot AS node, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 15) // 16 FROM high WHERE n > 1 GROUP BY level, place // 16
), root AS (SELECT node AS root FROM high WHERE n = 1
), steps AS (
  SELECT p.tree, p.place, l.level, coalesce(string_agg(l.node, '' ORDER BY l.place) FILTER (l.place < p.place // CAST(16 ** l.level AS BIGINT)), '') AS before,
    coalesce(string_agg(l.node, '' ORDER BY l.place) FILTER (l.place > p.place // CAST(16 ** l.level AS BIGINT)), '') AS after
  FROM placed AS p JOIN low AS l ON l.tree = p.tree AND l.n > 1 AND l.place // 16 = p.place // CAST(16 ** (l.level + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT p.tree, p.place, s.depth + h.level, coalesce(string_agg(h.node, '' ORDER BY h.place) FILTER (h.place < s.place // CAST(16 ** h.level AS BIGINT)), ''),
    coalesce(string_agg(h.node, '' ORDER BY h.place) FILTER (h.place > s.place // CAST(16 ** h.level AS BIGINT)), '')
  FROM placed AS p JOIN subroots AS s USING (tree) JOIN high AS h ON h.n > 1 AND h.place // 16 = s.place // CAST(16 ** (h.level + 1) AS BIGINT) GROUP BY ALL
), paths AS (
  SELECT tree, place, list({'b': before, 'a': after} ORDER BY level) AS path FROM steps GROUP BY tree, place
), fold AS (
  SELECT tree, place, 0 AS k, start AS node, coalesce(path, []) AS path FROM placed LEFT JOIN paths USING (tree, place)
  UNION ALL
  SELECT tree, place, k + 1, sha256(path[k + 1].b || node || path[k + 1].a), path FROM fold WHERE k < len(path)
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.b || s.a), '')) AS proof_sha256, fold.node AS folded_root, fold.node = root AS verified
FROM placed JOIN subroots USING (tree) JOIN fold ON fold.tree = placed.tree AND fold.place = placed.place AND k = len(path), root
"""
