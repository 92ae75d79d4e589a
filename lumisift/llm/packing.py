"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are encoded and cut into pieces; full pieces are sequences of their own. The other pieces are dealt to islands of a
bounded number of pieces. On an island an individual is a grouping of all its pieces into sequences. Crossover takes whole
well-filled sequences of one parent into the other, removes the sequences there that hold pieces twice, and best-fits the
displaced pieces, largest first. Between epochs the best-filled sequences migrate around the ring of islands, as the lengths
they are made of: pieces of equal length can stand for each other, so a neighbour builds them from its own.

Null and empty texts are the end id alone. Ties between equally good choices go to the earlier one; seeds come from the
island's number, so a lost task repeats its result. Repeated rows each are packed.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumisift.llm.common import saved, table
from lumisift.llm.tokens import Encoder, default_vocabulary

CAPACITY = 1024
#: Follows each document's ids.
END = 2
#: Pieces on an island; individuals, generations an epoch, epochs, and migrants an island.
ISLAND, POPULATION, GENERATIONS, EPOCHS, MIGRANTS = 16_000, 4, 8, 2, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32), written once: row tells repeated documents apart."""
    vocabulary = vocabulary or default_vocabulary()

    def rows(batches):
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            res = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encoder.ids(text or "", special=True), END).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : start + (capacity if piece else first)]
                    for k, v in zip(res, (doc, piece, start, len(part), zlib.crc32(part.tobytes()))):
                        res[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(res[c], pa.int32() if c == "piece" else pa.int64()) for c in res], names=list(res))

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, PIECES)
    return saved(made.withColumn("row", F.monotonically_increasing_id()))


def best_fit(bins: list[list[int]], room: list[int], pieces, sizes) -> None:
    """Add each piece, largest first, where the least room is left over, else to a new sequence."""
    order = sorted((left, i) for i, left in enumerate(room) if left > 0)
    for p in sorted(pieces, key=lambda p: -sizes[p]):
        k = bisect.bisect_left(order, (sizes[p], -1))
        if k == len(order):
            bins.append([p])
            room.append(CAPACITY - sizes[p])
            i = len(bins) - 1
        else:
            _, i = order.pop(k)
            bins[i].append(p)
            room[i] -= sizes[p]
        if room[i] > 0:
            bisect.insort(order, (room[i], i))


def swap_in(bins: list[list[int]], room: list[int], pieces: list[int], sizes) -> list[int]:
    """Where a sequence has room, exchange one of its pieces for a larger loose one that fits; returns the loose pieces, now smaller."""
    loose = sorted((sizes[p], p) for p in pieces)
    for i, left in enumerate(room):
        if not left or not loose:
            continue
        for j, p in enumerate(bins[i]):
            k = bisect.bisect_right(loose, (sizes[p] + left, len(sizes))) - 1
            if k >= 0 and loose[k][0] > sizes[p]:
                size, q = loose.pop(k)
                bins[i][j] = q
                left -= size - sizes[p]
                bisect.insort(loose, (sizes[p], p))
                if not left:
                    break
        room[i] = left
    return [p for _, p in loose]


class Grouping:
    """An individual: sequences of pieces, and the room left in each."""

    def __init__(self, bins: list[list[int]], sizes):
        self.bins, self.sizes = bins, sizes
        self.room = [CAPACITY - sum(sizes[p] for p in b) for b in bins]

    @classmethod
    def fresh(cls, sizes, rng, noise: int) -> Grouping:
        """Best fit of the pieces in decreasing order of a disturbed length."""
        self = cls([], sizes)
        jitter = rng.integers(0, noise + 1, len(sizes)) if noise else np.zeros(len(sizes), int)
        shown = [int(s - j) for s, j in zip(sizes, jitter)]
        order = sorted(range(len(sizes)), key=lambda p: -shown[p])
        for lo in range(0, len(order), max(1, len(order) // 8)):  # best fit within coarse classes keeps some disorder
            best_fit(self.bins, self.room, order[lo : lo + max(1, len(order) // 8)], sizes)
        return self

    def cost(self) -> tuple[int, float]:
        """Fewest sequences first, then the most uneven filling: emptier ones are easier to dissolve."""
        return len(self.bins), -sum((CAPACITY - r) ** 2 for r in self.room)

    def injected(self, own: list[list[int]]) -> Grouping:
        """These whole sequences put in; those that shared a piece dissolve and their other pieces are best-fitted."""
        taken = {p for b in own for p in b}
        bins, loose = [list(b) for b in own], []
        for b in self.bins:
            if taken.isdisjoint(b):
                bins.append(list(b))
            else:
                loose.extend(p for p in b if p not in taken)
        out = Grouping(bins, self.sizes)
        best_fit(out.bins, out.room, swap_in(out.bins, out.room, loose, self.sizes), self.sizes)
        return out

    def shaken(self, rng, share: float = 0.05) -> Grouping:
        """The emptiest sequences and a few others dissolved and best-fitted anew."""
        order = np.argsort(-np.array(self.room), kind="stable")
        drop = set(order[: max(1, int(len(order) * share))].tolist()) | set(rng.integers(0, len(order), max(1, int(len(order) * share))).tolist())
        out = Grouping([list(b) for i, b in enumerate(self.bins) if i not in drop], self.sizes)
        loose = [p for i in sorted(drop) for p in self.bins[i]]
        best_fit(out.bins, out.room, swap_in(out.bins, out.room, loose, self.sizes), self.sizes)
        return out


def _full(g: Grouping, rng, most: int) -> list[list[int]]:
    """Some of the best-filled sequences."""
    order = np.argsort(np.array(g.room), kind="stable")[: max(1, len(g.room) // 2)]
    return [g.bins[i] for i in rng.permutation(order)[:most].tolist()]


def _from_lengths(patterns: list[list[int]], sizes) -> list[list[int]]:
    """Sequences of these lengths from own pieces, as far as there are pieces."""
    free = defaultdict(list)
    for p, s in enumerate(sizes):
        free[s].append(p)
    out = []
    for lengths in patterns:
        if all(len(free[s]) >= n for s, n in Counter(lengths).items()):
            out.append([free[s].pop() for s in lengths])
    return out


def evolve(sizes: list[int], start: list[list[int]] | None, migrants: list[list[int]], seed: int, generations: int = GENERATIONS) -> Grouping:
    """The best grouping of an island's pieces after some generations."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(sizes) // CAPACITY)
    people = [Grouping(start, sizes)] if start else [Grouping.fresh(sizes, rng, 0)]
    while len(people) < POPULATION and len(people[0].bins) > bound:
        people.append(Grouping.fresh(sizes, rng, 64 * len(people)))
    if migrants and (moved := _from_lengths(migrants, sizes)):
        people.append(people[0].injected(moved))
    for _ in range(generations):
        people.sort(key=Grouping.cost)
        people = people[:POPULATION]
        if len(people[0].bins) <= bound:
            break
        children = [people[0].shaken(rng)]
        for i, father in enumerate(people[1:]):
            mother = people[int(rng.integers(0, i + 1))]
            children += [mother.injected(_full(father, rng, len(father.bins) // 4 + 1)), father.injected(_full(mother, rng, len(mother.bins) // 4 + 1))]
        people += children
    return min(people, key=Grouping.cost)


def _island(epoch: int):
    def run(key: tuple, pdf: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        if not len(pdf):
            return pd.DataFrame({c: [] for c in ("row", "length", "island", "bin", "left")})
        sizes = pdf.length.tolist()
        start = [g.index.tolist() for _, g in pdf.groupby("bin")] if pdf.bin.notna().all() else None
        best = evolve(sizes, start, [list(x) for x in moved.sort_values("place").lengths], 1000 * epoch + int(key[0]))
        bins, left = np.empty(len(sizes), np.int32), np.empty(len(sizes), np.int32)
        for i, b in enumerate(best.bins):
            bins[b], left[b] = i, best.room[i]
        return pdf.assign(bin=bins, left=left)[["row", "length", "island", "bin", "left"]]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, epochs: int = EPOCHS) -> DataFrame:
    """pieces with sequence_id and offset."""
    if capacity != CAPACITY:
        raise ValueError(f"sequences hold {CAPACITY} tokens")
    whole = pieces.filter(F.col("length") == CAPACITY)
    loose = pieces.filter(F.col("length") < CAPACITY)
    islands = max(1, -(-loose.count() // ISLAND))
    state = loose.select("row", "length").withColumn("island", F.pmod(F.xxhash64("row"), F.lit(islands)).cast("int")).withColumn("bin", F.lit(None).cast("int"))
    migrants = None
    for epoch in range(epochs):
        if migrants is None:
            migrants = pieces.sparkSession.createDataFrame([], "island int, place int, lengths array<int>")
        # by a number of its own, which is not coalesced: an island is much work for few bytes
        out = state.select("row", "length", "island", "bin").repartition(4 * islands, "island").groupBy("island").cogroup(migrants.groupBy("island")).applyInPandas(_island(epoch), "row long, length long, island int, bin int, left int")
        state = saved(out)
        # the best-filled sequences go to the next island of the ring
        full = state.groupBy("island", "bin").agg(F.first("left").alias("left"), F.sort_array(F.collect_list(F.col("length").cast("int"))).alias("lengths"))
        ranked = full.withColumn("place", F.row_number().over(Window.partitionBy("island").orderBy("left", F.desc(F.size("lengths")), "bin"))).filter(F.col("place") <= MIGRANTS)
        migrants = ranked.select(F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "place", "lengths")
    in_bin = Window.partitionBy("island", "bin").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = state.withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0).cast("long"))).select("row", "offset", (F.col("island").cast("long") * (1 << 24) + F.col("bin")).alias("number"))
    # even ids for packed sequences, odd ones for full pieces
    packed = loose.join(placed, "row").withColumn("sequence_id", 2 * F.col("number")).drop("number")
    return packed.unionByName(whole.withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", 2 * F.col("row") + 1)).drop("row")


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(pieces_of(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
