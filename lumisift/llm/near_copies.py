"""SimHash near-dedup at a stated similarity: near copies share four fifths of their 5-word shingles.

Texts with the same shingles collapse first. Candidates then come from two sides, and exact shingle sets decide each:

* the vantage-point tree of `simhash` links fingerprints of 5-word shingles within RADIUS bits;
* a pair at similarity 0.8 differs in ten bits in the mean and up to some twenty, and with such a radius a vantage point excludes
  next to nothing (README has figures), so the tree can't find these. They meet in buckets: in one order of all shingles, the rarer
  first, two near copies share one of the first fifth of each text's (all but four fifths, and one more). No near pair meets nowhere.

Each bucket's members are held against two of them: the least, and the one whose buckets most others share (of a text's copies, the
text itself). What may be like neither pivot is held against pivots of its own, ROUNDS times in all. That joins a large group of copies
by as many comparisons as it has members. Then members of a bucket that aren't in one class meet, pair by pair. Places in the order,
numbers of shingles and parities rule pairs out first, within the join, so that pairs ruled out never become rows; none of these bounds
drops a near pair. Of what is left each text's likeliest pair is decided by sets, then those that aren't in one class by then. As classes rest on such bounds at first,
those that the sets then part meet once more: in the end each pair of a bucket is in one class, ruled out or decided by sets, so no link
between classes is lost. Null and empty texts have no shingles and are copies of each other. Repeated rows are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import blocks_of, byte_rows, discard, release, saved
from lumisift.llm.simhash import RADIUS, components, links_of, majority

SHINGLE = 5
#: Two texts are near copies if OVERLAP[0] / OVERLAP[1] of the shingles of both together are shared.
OVERLAP = (4, 5)
#: Times that a bucket gets pivots, before the pairs that are left.
ROUNDS = 2
#: Bits of a set's parities: two sets differ in at least as many shingles as in parities.
PARITIES = 512
#: Bits of those that are held against each other before sets are.
FINE = 4096
#: Shingles that come last in the order: those most often in a sample of texts (at least so many, and one in so many). They only
#: keep buckets small; any order gives the same links.
COMMON, SAMPLED, SHARE = 100_000, 4096, 64


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of runs of `size` words, sorted; a shorter text is one run, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh3_64_intdigest(flat)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-size].tolist()]
    of = xxhash.xxh3_64_intdigest
    return np.unique(np.array([of(flat[a:b]) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64))


def prefix(found: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which near copies share one. common: sorted shingles that come last, often: by what."""
    if not len(found):
        return found
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.argsort(np.where(common[at] == found, often[at], 0), kind="stable")]
    return found[: len(found) + OVERLAP[0] * len(found) // -OVERLAP[1] + 1]


def parities(found: np.ndarray, bits: int = PARITIES) -> np.ndarray:
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return OVERLAP[1] * shared >= OVERLAP[0] * (len(a) + len(b) - shared)


def _signed(last: Broadcast):
    def rows(batches):
        common, often = last.value
        for batch in blocks_of(batches, 8_000_000):
            sets = [shingles(t) for t in byte_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]),
                    pa.array([len(s) for s in sets]),
                    pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)),
                    pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
                    pa.array([prefix(s, common, often).view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["id", "same", "n", "fp", "odd", "prefix"],
            )

    return rows


def _each(batches):
    for batch in blocks_of(batches, 2_000_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t) for t in byte_rows(batch.column("text"))]).view(np.int64))], names=["shingle"])


def _sets(batches):
    for batch in blocks_of(batches, 4_000_000):
        sets = [shingles(t) for t in byte_rows(batch.column("text"))]
        values = [pa.array([len(x) for x in sets]), pa.array([parities(x, FINE).tobytes() for x in sets]), pa.array([x.tobytes() for x in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *values], names=["id", "n", "fine", "set"])


def _left(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("fine_a", "fine_b"))
        differ, both = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64), batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        yield batch.select(["a", "b"]).filter(pa.array(_few(differ, both)))


def _decided(batches):
    for batch in batches:
        a, b = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
        keep = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def _last(texts: DataFrame) -> Broadcast:
    """The shingles that come last in the order, sorted, and how often a sample has them."""
    every = max(1, min(SHARE, texts.count() // SAMPLED))
    seen = texts.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(every)) == 0).mapInArrow(_each, "shingle long").groupBy("shingle").agg(F.count("*").alias("times"))
    found = seen.filter("times > 2").orderBy(F.desc("times"), "shingle").limit(COMMON).collect()
    common, often = (np.array([r[i] for r in found], np.int64) for i in range(2))
    order = np.argsort(common.view(np.uint64))
    return texts.sparkSession.sparkContext.broadcast((common.view(np.uint64)[order], often[order]))


def _could(a: str, b: str):
    """Whether so many shingles as sets share at least, if they are near copies, are left from the first that they share on."""
    low, high = OVERLAP
    left = lambda x: F.col(f"{x}.n") - F.col(f"{x}.at")
    return F.least(left(a), left(b)) * (low + high) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * low


def _sized(a: str, b: str):
    """Whether the numbers of shingles leave near copies possible."""
    low, high = OVERLAP
    return F.least(f"{a}.n", f"{b}.n") * high >= F.greatest(f"{a}.n", f"{b}.n") * low


def _differ(a: str, b: str):
    """In how many parities two sets differ."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, PARITIES // 64)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def _few(differ, both):
    """Whether sets of so many shingles together can be near copies, by their parities."""
    low, high = OVERLAP
    return differ * (low + high) <= both * (high - low)


def _possible(distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct (a, b, differ), the less id first, of pairs of structs with id and n whose numbers of shingles and parities don't rule out near copies."""
    pairs = pairs.filter(_sized("a", "b"))
    pairs = saved(pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), (F.col("a.n") + F.col("b.n")).alias("both")).filter("a <> b").distinct())
    of = lambda x: distinct.select(F.col("id").alias(x), F.col("odd").alias(f"odd_{x}"))
    differ = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "both", _differ("odd_a", "odd_b").alias("differ"))
    found = saved(differ.filter(_few(F.col("differ"), F.col("both"))).select("a", "b", (F.col("differ") / F.col("both")).alias("differ")))
    discard(pairs)
    return found


def _linked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are near copies. Finer parities rule out most others before any set is fetched."""

    def both(found: DataFrame, *names: str) -> DataFrame:
        for x in ("a", "b"):
            found = found.join(sets.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names]), x)
        return found

    left = saved(both(pairs, "n", "fine").mapInArrow(_left, "a long, b long"))
    return saved(both(left, "set").mapInArrow(_decided, "a long, b long"))


def _links(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Near copies among the pairs (a, b, differ) that join all that such pairs join.

    Each text asks for its likeliest pair first: pairs that are within a class by then need no sets. All others are decided.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.struct("differ", "a", "b").alias("pair"))
    asked = saved(ends.groupBy("id").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct())
    links = _linked(sets, asked)
    classes = components(links)
    of = lambda x: classes.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    rest = pairs.select("a", "b").join(asked, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    release(sets.sparkSession)
    return links.union(_linked(sets, saved(rest.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))))


def _pivots(members: DataFrame) -> DataFrame:
    """(band, least, shared): of each bucket with several members; written, so that a hot bucket's join can be split."""
    chosen = members.groupBy("band").agg(F.min("self").alias("least"), F.max(F.struct("popular", "self")).self.alias("shared"), F.count("*").alias("n"))
    return saved(chosen.filter("n > 1").drop("n"))


def _apart(distinct: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b, differ) of members of a bucket that links don't join, but that could be near copies. Members of one class never meet.

    All bounds are conditions of the one join, so a bucket's pairs that they rule out are compared there and never become rows.
    """
    classes = components(links.select("a", "b"))
    at = saved(members.select("band", "self").join(classes, F.col("self.id") == F.col("node"), "left").select("band", F.coalesce("root", "self.id").alias("root"), "self"))
    several = saved(at.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("band"))
    met = at.join(several, "band").join(distinct.select(F.col("id").alias("of"), "odd"), F.col("self.id") == F.col("of")).drop("of")
    met = saved(met)
    discard(at)
    discard(several)
    of = lambda x: met.select("band", *[F.col(c).alias(f"{c}_{x}") for c in ("root", "odd")], F.col("self").alias(x))
    bounds = (F.col("root_a") < F.col("root_b")) & _sized("a", "b") & _could("a", "b") & _few(_differ("odd_a", "odd_b"), F.col("a.n") + F.col("b.n"))
    pairs = of("a").join(of("b").withColumnRenamed("band", "there"), (F.col("band") == F.col("there")) & bounds)
    differ = _differ("odd_a", "odd_b") / (F.col("a.n") + F.col("b.n"))
    found = saved(pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), differ.alias("differ")).distinct())
    discard(met)
    return found


def _members(signed: DataFrame, distinct: DataFrame) -> DataFrame:
    """(band, self, popular): the texts of each bucket of several, and how many meet each in all."""
    # of an empty set nothing is exploded
    firsts = signed.join(distinct.select("id"), "id", "left_semi").select("id", "n", F.posexplode("prefix").alias("at", "band"))
    several = saved(firsts.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"))
    entries = saved(firsts.join(several, "band"))
    popular = entries.groupBy("id").agg(F.sum("size").alias("popular"))
    members = saved(entries.join(popular, "id").select("band", F.struct("id", "n", "at").alias("self"), "popular"))
    discard(several)
    discard(entries)
    return members


def _by_pivots(distinct: DataFrame, members: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts and pivots of their buckets, and of those near, that may be near copies."""
    out = None
    for number in range(ROUNDS):
        pivots = _pivots(members)
        asked = members.join(pivots, "band").select("band", "self", F.explode(F.array("least", "shared")).alias("pivot")).filter("self.id <> pivot.id").filter(_could("self", "pivot"))
        pairs = asked.select(*[F.struct(f"{x}.id", f"{x}.n").alias(y) for x, y in (("self", "a"), ("pivot", "b"))])
        found = _possible(distinct, pairs if number else pairs.union(near))
        out = out.union(found) if number else found
        if number + 1 < ROUNDS:  # who is like no pivot goes on, without the pivots
            pair = [F.least("self.id", "pivot.id").alias("a"), F.greatest("self.id", "pivot.id").alias("b")]
            explained = asked.select("band", F.col("self.id").alias("id"), *pair).join(found.select("a", "b"), ["a", "b"]).select("band", "id")
            explained = explained.union(pivots.select("band", "least.id")).union(pivots.select("band", "shared.id")).distinct()
            rest = members.withColumn("id", F.col("self.id")).join(explained, ["band", "id"], "left_anti")
            members = saved(rest.drop("id"))
    return out


def near_copies(docs: DataFrame, key: str = "rid") -> DataFrame:
    """Per row: (id, root), the least key that near copies reach. docs has the key (a long, unique, not null) and text."""
    spark, texts = docs.sparkSession, docs.select(F.col(key).cast("long").alias("id"), "text")
    signed = saved(texts.mapInArrow(_signed(_last(texts)), "id long, same binary, n long, fp long, odd array<long>, prefix array<long>"))
    distinct = saved(signed.groupBy("same").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("odd").alias("odd")))

    members = _members(signed, distinct)
    rows = saved(signed.select("id", "same"))
    discard(signed)

    by_fp = saved(distinct.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("first")))
    tree = links_of(by_fp, by_fp.count(), RADIUS)
    near = tree.join(by_fp.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    near = saved(near.select(F.col("x").alias("a"), F.col("y").alias("b")))
    release(spark)

    pairs = _by_pivots(distinct, members, near)
    pairs = saved(pairs.union(_apart(distinct, members, pairs)).distinct())
    release(spark)
    sets = saved(texts.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").mapInArrow(_sets, "id long, n long, fine binary, set binary"))
    links = _links(sets, pairs)
    release(spark)
    # classes that rested on bounds alone and aren't any: their texts have sets already
    again = saved(_apart(distinct, members, links).join(pairs, ["a", "b"], "left_anti"))
    links = saved(links.union(_linked(sets, again)))
    for table in (members, sets, pairs, again):
        discard(table)

    same = rows.join(distinct.select("same", F.col("id").alias("to")), "same").filter("id <> to").select(F.col("to").alias("a"), F.col("id").alias("b"))
    ends = components(links.unionByName(same))
    release(spark)
    return rows.join(ends, rows.id == ends.node, "left").select(rows.id, F.coalesce("root", rows.id).alias("root"))


def brute_force(docs: list[tuple[int, str]]) -> dict[int, int]:
    """The same from all pairs, for tests."""
    sets = {d: shingles((t or "").encode()) for d, t in docs}
    ids, root = sorted(sets), {d: d for d in sets}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if root[a] != root[b] and (similar(sets[a], sets[b]) or not len(sets[a]) + len(sets[b])):
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    return root
