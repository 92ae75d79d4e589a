"""Hidden Markov language model over documents, trained by Baum-Welch on the whole training corpus.

A hidden state chain emits classes of words. A word that the training texts hold FREQUENT times has a class of its own, so what the
states learn grows with the corpus; rarer words share a class by shape (how they end), and a word's share of its class comes from the
corpus's counts (add-0.1, with one more word per class for all unseen ones), so every text has a probability.

Texts are encoded once into stored blocks of whole documents, in buckets, which no later step deals anew. A block's documents lie by share, so
that a round over one share unpacks no other's tokens. Words are counted by ranges of
their hashes: each block sends a range as arrays and gets its counts back as such. The emissions of words are a table (word, one number a state): each
round it joins the blocks by word, and all of a block's documents go forward and backward together. The TOP most frequent words, which most
blocks hold, take no part in that: their emissions are broadcast, and a task sums what it expects of them over its blocks. Expected counts move
once, in rows of many words or shapes, and only their sums are written. Only long documents are cut into chunks, and products of a chunk's transition matrices give the exact
messages at its borders. What the driver holds - transitions, one number a state of each shape and of TOP words - has a fixed size.

The states start from the corpus as well: every document leans to states at random, and rounds by shapes alone (as few numbers as the
driver holds) go over whole documents, each round over another share of them in all partitions. Then rounds over all documents train words.

Null and empty texts are one end token. A null doc_id is a training row. Repeated rows each count and each have their result.
Words go by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import blocks_of, byte_rows, release, saved, shared_dir, table

STATES, ROUNDS = 8, 1
#: Occurrences from which a word has its own class; classes of rarer words; bytes of a word's end that choose one.
FREQUENT, SHAPES, ENDING = 64, 1 << 14, 3
#: Most frequent words whose emissions are broadcast.
TOP = 1 << 17
#: Words or shapes in a row of expected counts, at most or in the mean.
SLICE = 512
#: Weight of the corpus's shares in each state's emissions.
BACKGROUND = 0.02
#: Rounds by shapes alone, and shares of the documents that they take in turn: each document is read by one, and by the rounds after them.
START_ROUNDS, SHARES = 12, 12
CHUNK = 1024
BLOCK_BYTES = 8_000_000
#: Tokens of whole documents that go forward and backward at once; a document of more goes alone. Each takes some 500 bytes.
AT_ONCE = 200_000
#: The end of a text, counted as a token; no word is empty.
END = b""

#: Documents by share; dealt: how many each share has; tokens: those of each share.
BLOCKS = "block long, doc_ids array<long>, train array<boolean>, lengths array<int>, dealt array<int>, tokens array<binary>, words binary, counts binary, shapes binary"
#: A range of hashes from a block and back; a frequent word with its count; a shape with its tokens, and with those and the words that aren't frequent.
RANGES = "range int, block long, words binary, counts binary, shapes binary"
COUNTED = "range int, block long, totals binary, word long, c long, shape int, tokens long, rare_tokens long, rare_words long"
#: Expected counts by key: of top words by place, of other frequent words by hash, of shapes, and of the chain: starts (0), transitions from each state, log likelihood.
EXPECTED = "kind string, part int, keys binary, sums binary"
#: Entries (a word of a block) in a range, in the mean, if a block has so many words.
RANGE_ENTRIES, BLOCK_WORDS = 2_000_000, 120_000


def shape(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word[-ENDING:]) % SHAPES


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of all of them and compressed: small ones are common."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def short(numbers: np.ndarray) -> bytes:
    """Numbers of 0 or more as floats of 24 bits (16 of them significant), byte by byte of all of them and compressed: exponents are alike."""
    bits = np.ascontiguousarray(numbers, "<f4").ravel().view("<u4") + np.uint32(1 << 7)  # rounds
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(bits.view(np.uint8).reshape(-1, 4)[:, 1:].T).tobytes())


def unshort(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(3, -1)
    bits = np.zeros((planes.shape[1], 4), np.uint8)
    bits[:, 1:] = planes.T
    return bits.view("<f4").ravel()


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _encoded(batches):
    blocks = itertools.count(TaskContext.get().partitionId() << 32)
    for batch in blocks_of(batches, BLOCK_BYTES):
        block, words, lengths = next(blocks), [], []
        shares = np.random.default_rng([block, 1]).integers(0, SHARES, batch.num_rows)
        batch, dealt = batch.take(pa.array(np.argsort(shares, kind="stable"))), np.bincount(shares, minlength=SHARES)
        for text in byte_rows(batch.column("text")):
            own = tokens_of(text)
            words += own
            lengths.append(len(own))
        vocabulary = list(dict.fromkeys(words))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
        order = np.argsort(hashes)  # a word's number in its block is its place among the hashes
        shapes = np.fromiter(map(shape, vocabulary), np.int64, len(vocabulary))[order]
        ids = {vocabulary[i]: k for k, i in enumerate(order.tolist())}
        tokens = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
        train = np.asarray(batch.column("train").to_pylist(), bool)
        counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(ids))
        ends = np.cumsum([0, *lengths])[np.cumsum(dealt)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([train], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int32())),
                pa.array([dealt], pa.list_(pa.int32())),
                pa.array([[packed(x) for x in np.split(tokens, ends[:-1])]], pa.list_(pa.binary())),
                pa.array([hashes[order].tobytes()], pa.binary()),
                pa.array([packed(counts)], pa.binary()),
                pa.array([packed(shapes)], pa.binary()),
            ],
            names=["block", "doc_ids", "train", "lengths", "dealt", "tokens", "words", "counts", "shapes"],
        )


def _ranges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash, by its high half."""
    return (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _split(ranges: int):
    """A block's words in ranges of hashes, each as arrays."""

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words, counts, shapes = np.frombuffer(batch.column("words")[i].as_py(), np.uint64), _numbers(batch, i, "counts"), _numbers(batch, i, "shapes")
                ends = np.searchsorted(_ranges(words, ranges), np.arange(ranges + 1))
                used = np.flatnonzero(np.diff(ends))
                pieces = lambda x, make: pa.array([make(x[ends[r] : ends[r + 1]]) for r in used], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array(np.full(len(used), batch.column("block")[i].as_py())), pieces(words, lambda x: x.tobytes()), pieces(counts, packed), pieces(shapes, packed)],
                    names=["range", "block", "words", "counts", "shapes"],
                )

    return rows


def _count_range(frequent: int):
    """All blocks' words of one range: each block's corpus-wide counts, the frequent words, and sums by shape."""

    def count(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        ends = np.cumsum([0, *map(len, words)])
        every, first, back = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
        counts = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()])
        shapes = np.concatenate([unpacked(x) for x in table.column("shapes").to_pylist()])[first]
        totals = np.bincount(back, weights=counts, minlength=len(every)).astype("<i8")  # exact below 2 ** 53
        own, often = totals[back], totals >= frequent
        r, n, k, used = table.column("range")[0].as_py(), len(words), int(often.sum()), np.unique(shapes)
        sums = lambda weights: np.bincount(shapes, weights=weights, minlength=SHAPES)[used].astype(np.int64)
        known = (totals > 0) & ~often
        none = lambda kind: (lambda size: pa.nulls(size, kind))
        columns = {
            "range": (pa.array([r] * n, pa.int32()), pa.array([r] * k, pa.int32()), pa.array([r] * len(used), pa.int32())),
            "block": (table.column("block").combine_chunks().cast(pa.int64()), none(pa.int64())(k), none(pa.int64())(len(used))),
            "totals": (pa.array([packed(own[a:b].view("<i4")) for a, b in zip(ends, ends[1:])], pa.binary()), none(pa.binary())(k), none(pa.binary())(len(used))),
            "word": (none(pa.int64())(n), pa.array(every[often].view(np.int64)), none(pa.int64())(len(used))),
            "c": (none(pa.int64())(n), pa.array(totals[often].astype(np.int64)), none(pa.int64())(len(used))),
            "shape": (none(pa.int32())(n), pa.array(shapes[often].astype(np.int32)), pa.array(used.astype(np.int32))),
            "tokens": (none(pa.int64())(n + k), pa.array(sums(totals))),
            "rare_tokens": (none(pa.int64())(n + k), pa.array(sums(totals * known))),
            "rare_words": (none(pa.int64())(n + k), pa.array(sums(known))),
        }
        return pa.table({name: pa.concat_arrays(parts) for name, parts in columns.items()})

    return count


class Top:
    """The most frequent words: sorted hashes, and by their places shape, share of the training tokens and emissions by state."""

    def __init__(self, frequent: DataFrame, n: int):
        found = frequent.orderBy(F.desc("c"), "word").limit(TOP).collect()
        words = np.array([r["word"] for r in found], np.int64).view(np.uint64)
        order = np.argsort(words)
        self.words, self.shape = words[order], np.array([r["shape"] for r in found], np.int64)[order]
        self.share, self.emissions = np.array([r["c"] for r in found], np.float64)[order] / max(n, 1), None
        last = found[-1] if found else None
        #: The frequent words that aren't here.
        self.rest = frequent.filter((F.col("c") < last["c"]) | ((F.col("c") == last["c"]) & (F.col("word") > last["word"]))) if last else frequent


def _places(words: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a block's words are among the top ones, and where there."""
    if not len(top):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(top, words), len(top) - 1)
    here = np.flatnonzero(top[at] == words)
    return here, at[here]


def _expected_rows(kind: str, parts: np.ndarray, keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Rows of expected counts, one for each part; parts ascend. Those of words are many and go as short numbers."""
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    key = (lambda x: x.astype("<i8").tobytes()) if kind == "word" else packed
    number = short if kind in ("word", "top") else np.ndarray.tobytes
    pieces = lambda x, make: pa.array([make(y) for y in np.split(x, starts[1:])] if len(starts) else [], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(starts), pa.string()), pa.array(parts[starts].astype(np.int32)), pieces(keys, key), pieces(sums, number)], names=["kind", "part", "keys", "sums"])


def _summed(k: int):
    """One part's rows of expected counts as one row, of 64-bit keys and doubles."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros((0, k))
        for batch in batches:
            kind, part = batch.column("kind")[0].as_py(), batch.column("part")[0].as_py()
            key = (lambda x: np.frombuffer(x, "<i8")) if kind == "word" else unpacked
            number = unshort if kind in ("word", "top") else np.frombuffer
            keys, at = np.unique(np.concatenate([keys, *map(key, batch.column("keys").to_pylist())]), return_inverse=True)
            more = np.concatenate([sums, *(number(x).reshape(-1, k) for x in batch.column("sums").to_pylist())])
            sums = np.stack([np.bincount(at, weights=more[:, j], minlength=len(keys)) for j in range(k)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part], pa.int32()), pa.array([keys.astype("<i8").tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], names=["kind", "part", "keys", "sums"])

    return total


def _by_word(k: int):
    """(word, e) of summed rows of words."""

    def rows(batches):
        for batch in batches:
            for words, sums in zip(batch.column("keys").to_pylist(), batch.column("sums").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)), _lists(np.frombuffer(sums).reshape(-1, k))], names=["word", "e"])

    return rows


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel(), pa.float64()), values.shape[1]).cast(pa.list_(pa.float64()))


def _frequent_of(frequent: int, top: Broadcast):
    """(block, id, word) of the frequent words of blocks that aren't among the top ones, from the counts that came back for their ranges."""

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                many, words = _totals(batch, i) >= frequent, np.frombuffer(batch.column("words")[i].as_py(), np.int64)
                many[_places(words.view(np.uint64), top.value)[0]] = False
                often = np.flatnonzero(many)
                words = words[often]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(often), batch.column("block")[i].as_py())), pa.array(often.astype(np.int32)), pa.array(words)], names=["block", "id", "word"])

    return rows


def _totals(batch, i: int) -> np.ndarray:
    """Corpus-wide counts of a block's words, put together from its ranges."""
    return np.concatenate([unpacked(x).view("<i8") for x in batch.column("totals")[i].values.to_pylist()])


#: Steps after which messages are scaled anew: products of so many probabilities stay far above the least double.
SCALED = 16


class Chunks:
    """Stretches of at most CHUNK tokens of documents laid end to end, the longest first.

    emit: of each token by state; steps holds it by place in the chunk.
    """

    def __init__(self, lengths: np.ndarray, emit: np.ndarray):
        n = -(-lengths // CHUNK)
        doc = np.repeat(np.arange(len(lengths)), n)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = (np.cumsum(lengths) - lengths)[doc] + place * CHUNK
        size = np.minimum(CHUNK, lengths[doc] - place * CHUNK)
        order = np.argsort(-size, kind="stable")
        self.doc, self.place, self.start, self.size = doc[order], place[order], start[order], size[order]
        self.docs, self.several = len(lengths), n > 1
        self.lengths, self.emit = lengths, emit
        #: How many chunks have a token at each place.
        self.active = np.searchsorted(-self.size, -np.arange(CHUNK), side="left")
        self.steps = [emit[self.start[:k] + t] for t, k in enumerate(self.active) if k]

    def _products(self, move: np.ndarray):
        """Each chunk's product of transition and emission matrices, scaled."""
        k = len(move)
        m = np.tile(np.eye(k), (len(self.start), 1, 1))
        for t, emit in enumerate(self.steps):
            n = len(emit)
            step = (m[:n].reshape(-1, k) @ move).reshape(n, k, k)
            np.multiply(step, emit[:, None, :], out=m[:n])
            if t % SCALED == SCALED - 1 or t + 1 == len(self.steps):
                m /= m.sum(axis=(1, 2))[:, None, None]
        return m

    def borders(self, begin: np.ndarray, move: np.ndarray):
        """Messages before and after each chunk. Those of documents of one chunk are the start and even."""
        k = len(begin)
        before, after = np.tile(begin, (len(self.start), 1)), np.full((len(self.start), k), 1 / k)
        if self.several.any():
            own = np.flatnonzero(self.several)
            part = Chunks(self.lengths[own], self.emit[np.repeat(self.several, self.lengths)])
            m = part._products(move)
            # where each of the part's chunks lies here: both are found by document and place
            here = {(d, p): i for i, (d, p) in enumerate(zip(self.doc.tolist(), self.place.tolist()))}
            at = np.array([here[int(own[d]), p] for d, p in zip(part.doc.tolist(), part.place.tolist())])
            by_place = np.argsort(part.place, kind="stable")
            levels = np.split(by_place, np.cumsum(np.bincount(part.place))[:-1])
            state = np.tile(begin, (len(own), 1))
            for rows in levels:
                d = part.doc[rows]
                before[at[rows]] = state[d]
                new = np.einsum("nk,nkl->nl", state[d], m[rows])
                state[d] = new / new.sum(axis=1, keepdims=True)
            state = np.full((len(own), k), 1 / k)
            for rows in reversed(levels):
                d = part.doc[rows]
                after[at[rows]] = state[d]
                new = np.einsum("nkl,nl->nk", m[rows], state[d])
                state[d] = new / new.sum(axis=1, keepdims=True)
        return before, after

    def forward(self, before: np.ndarray, move: np.ndarray, keep: bool):
        """Each document's log probability, and with keep the messages before each step."""
        alphas, now, logs = [], before, np.zeros(len(self.start))
        for t, emit in enumerate(self.steps):
            n = len(emit)
            if keep:
                alphas.append(now[:n])
            now = (now[:n] @ move) * emit
            ending = n if t + 1 == len(self.steps) else len(self.steps[t + 1])
            if t % SCALED == SCALED - 1 or ending < n:
                scale = now.sum(axis=1, keepdims=True)
                now /= scale
                logs[:n] += np.log(scale[:, 0])
            if t + 1 == len(self.steps):
                logs[:n] += np.log(now.sum(axis=1))
        return np.bincount(self.doc, weights=logs, minlength=self.docs), alphas


def expected(lengths: np.ndarray, emit: np.ndarray, begin: np.ndarray, move: np.ndarray):
    """Baum-Welch expectations of a block: start counts, transition counts, each token's state shares, log likelihood."""
    k = len(begin)
    chunks = Chunks(lengths, emit)
    before, after = chunks.borders(begin, move)
    total, alphas = chunks.forward(before, move, keep=True)
    starts, moves, shares = np.zeros(k), np.zeros((k, k)), np.empty((len(emit), k))
    for t in range(len(chunks.steps) - 1, -1, -1):
        step = chunks.steps[t]
        n = len(step)
        a, ahead = alphas[t], step * after[:n]
        back = ahead @ move.T
        norm = np.einsum("nk,nk->n", a, back)[:, None]
        g = (a @ move) * ahead / norm
        shares[chunks.start[:n] + t] = g
        moves += (a / norm).T @ ahead
        if t == 0:
            first = chunks.place[:n] == 0
            starts += ((a * back) / norm)[first].sum(axis=0)
        if t % SCALED == 0:
            back /= back.sum(axis=1, keepdims=True)
        after[:n] = back
    return starts, moves * move, shares, total


def _portions(lengths: np.ndarray):
    """Places of a block's documents, and of their tokens, in portions of AT_ONCE tokens; those of like length go together."""
    order, ends = np.argsort(-lengths, kind="stable"), np.cumsum(lengths)
    sums, at = np.cumsum(lengths[order]), 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + AT_ONCE, side="right")))
        docs = np.sort(order[at:stop])
        size = lengths[docs]
        yield docs, np.repeat(ends[docs] - np.cumsum(size), size) + np.arange(size.sum())
        at = stop


def _normal(starts: np.ndarray, moves: np.ndarray):
    begin, move = starts + 1e-3, moves + 1e-3
    return begin / begin.sum(), move / move.sum(axis=1, keepdims=True)


def _numbers(batch, i: int, name: str) -> np.ndarray:
    """A row's list, or its packed numbers, as a numpy array."""
    value = batch.column(name)[i]
    return unpacked(value.as_py()) if pa.types.is_binary(value.type) else value.values.to_numpy(zero_copy_only=False)


def _tokens(batch, i: int) -> np.ndarray:
    """A block's tokens, of the shares that are here."""
    return np.concatenate([unpacked(x) for x in batch.column("tokens")[i].values.to_pylist()])


def _emissions(batch, i: int, by_shape: np.ndarray, shapes: np.ndarray, top: tuple[np.ndarray, np.ndarray]):
    """Of each word of a block, by state; which words have a class of their own; which of those are among the top ones, and where there."""
    emission, own = by_shape[shapes], np.zeros(0, np.int64)
    found = batch.column("frequent")[i].values
    if found is not None and len(found):
        own = found.field("id").to_numpy()
        emission[own] = found.field("e").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
    here, at = _places(np.frombuffer(batch.column("words")[i].as_py(), np.uint64), top[0])
    emission[here] = top[1][at]
    return emission, own, here, at


def _round(begin: np.ndarray, move: np.ndarray, by_shape: np.ndarray, top: Broadcast, parts: int):
    """Rows of expected counts; words that aren't top ones are in so many parts, by ranges of hashes."""
    k = len(begin)

    def rows(batches):
        sums, starts, moves, total = np.zeros((SHAPES, k)), np.zeros(k), np.zeros((k, k)), 0.0
        of_top = np.zeros((len(top.value[0]), k))
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, train, shapes = (_numbers(batch, i, c) for c in ("lengths", "train", "shapes"))
                emission, own, here, at = _emissions(batch, i, by_shape, shapes, top.value)
                lengths, train = lengths.astype(np.int64), train.astype(bool)
                tokens = _tokens(batch, i)[np.repeat(train, lengths)]
                if not len(tokens):
                    continue
                by_word, trained = np.zeros((len(shapes), k)), lengths[train]
                for docs, places in _portions(trained):
                    part = tokens[places]
                    s, m, shares, log = expected(trained[docs], emission[part], begin, move)
                    starts, moves, total = starts + s, moves + m, total + log.sum()
                    for j in range(k):
                        by_word[:, j] += np.bincount(part, weights=shares[:, j], minlength=len(shapes))
                if len(own):
                    own = np.sort(own)  # by hash as well
                    words = np.frombuffer(batch.column("words")[i].as_py(), np.uint64)[own]
                    yield _expected_rows("word", _ranges(words, parts), words.view(np.int64), by_word[own])
                    by_word[own] = 0
                of_top[at] += by_word[here]
                by_word[here] = 0
                for j in range(k):
                    sums[:, j] += np.bincount(shapes, weights=by_word[:, j], minlength=SHAPES)
        for kind, counts in (("shape", sums), ("top", of_top)):
            used = np.flatnonzero(counts.any(axis=1))
            yield _expected_rows(kind, used // SLICE, used, counts[used])
        yield _expected_rows("chain", np.zeros(k + 2, np.int64), np.arange(k + 2), np.concatenate([starts[None], moves, np.full((1, k), total)]))

    return rows


def _start_round(share: int | None, states: int, begin: np.ndarray, move: np.ndarray, by_shape: np.ndarray | None):
    """Rows (shape, shares) of expected counts of shapes, and below zero of starts (-1) and transitions from state i (-2 - i), from whole training documents of one share (None: all), by shapes alone; without emissions each document leans to states at random."""

    def rows(batches):
        sums, starts, moves = np.zeros((SHAPES, states)), np.zeros(states), np.zeros((states, states))
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, train, shapes, dealt = (_numbers(batch, i, c) for c in ("lengths", "train", "shapes", "dealt"))
                docs = slice(None) if share is None else slice(dealt[:share].sum(), dealt[: share + 1].sum())
                lengths, chosen = lengths[docs].astype(np.int64), train[docs].astype(bool)
                seen, lengths = shapes[_tokens(batch, i)[np.repeat(chosen, lengths)]], lengths[chosen]
                if not len(seen):
                    continue
                rng = np.random.default_rng([batch.column("block")[i].as_py(), 2])
                leans = rng.dirichlet(np.full(states, 0.3), len(lengths)) if by_shape is None else None
                for docs, places in _portions(lengths):
                    part = seen[places]
                    if by_shape is None:
                        found = np.repeat(leans[docs], lengths[docs], axis=0)
                    else:
                        s, m, found, _ = expected(lengths[docs], by_shape[part], begin, move)
                        starts, moves = starts + s, moves + m
                    for j in range(states):
                        sums[:, j] += np.bincount(part, weights=found[:, j], minlength=SHAPES)
        used = np.flatnonzero(sums.sum(axis=1))
        ids, values = np.concatenate([used, [-1], -2 - np.arange(states)]), np.concatenate([sums[used], starts[None], moves])
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), _lists(values)], names=["shape", "shares"])

    return rows


def start_states(ready: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = START_ROUNDS):
    """begin, move and each shape's leaning to the states (mean 1), from rounds over the corpus; share: of each shape among training tokens."""
    begin, move = np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    leaning, background, by_shape = np.ones((SHAPES, states)), share[:, None], None
    used, total = np.flatnonzero(share), 1
    for number in range(rounds + 1):
        of = None if number == 0 else (number - 1) % SHARES
        tokens = "tokens" if of is None else F.slice("tokens", of + 1, 1).alias("tokens")
        part = ready.select("block", "lengths", "train", "dealt", tokens, "shapes").mapInArrow(_start_round(of, states, begin, move, by_shape), "shape int, shares array<double>")
        found = part.groupBy("shape").agg(*[F.sum(F.get("shares", F.lit(i))) for i in range(states)]).collect()  # SHAPES + states + 1 rows at most
        sums = np.zeros((SHAPES, states))
        for r in found:
            if r[0] >= 0:
                sums[r[0]] = r[1:]
        if not sums.any():
            continue
        total = sums.sum()
        if number:
            fixed = {r[0]: np.array(r[1:]) for r in found if r[0] < 0}
            begin, move = _normal(fixed[-1], np.stack([fixed[-2 - i] for i in range(states)]))
        by_shape = (1 - BACKGROUND) * sums / (sums.sum(axis=0) + 1e-9) + BACKGROUND * background
    if by_shape is not None:
        # what few tokens say is held back
        seen = share[used] * total
        leaning[used] = 1 + (seen / (seen + 5))[:, None] * (by_shape[used] / background[used] - 1)
    return begin, move, leaning


def _with_emissions(blocks: DataFrame, own: DataFrame, emissions: DataFrame) -> DataFrame:
    """Blocks with the emissions of their frequent words (block, id, word). The blocks lie in buckets: only the emissions move."""
    by_block = own.join(emissions, "word").groupBy("block").agg(F.collect_list(F.struct("id", "e")).alias("frequent"))
    return blocks.join(by_block.hint("shuffle_hash"), "block", "left")


def _bucketed(blocks: DataFrame) -> DataFrame:
    """blocks as a table in buckets by block, which joins by block without being dealt again."""
    spark = blocks.sparkSession
    name, buckets = f"blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.option("compression", "zstd").option("path", shared_dir(spark)).bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def train(blocks: DataFrame, own: DataFrame, top: Top, shape_share: np.ndarray, n: int, first, rounds: int = ROUNDS):
    """begin, move, emissions by shape, those of frequent words as a table, and the log likelihood before each round; top gets its emissions.

    own: frequent words of blocks that aren't top ones; first: begin, move and leaning of shapes.
    """
    spark = blocks.sparkSession
    begin, move, leaning = first
    k = len(begin)
    frequent = saved(top.rest.select("word", "shape", (F.col("c") / n).alias("share")))
    parts = max(1, frequent.count() // SLICE)
    lean = spark.createDataFrame([(i, leaning[i].tolist()) for i in np.flatnonzero((leaning != 1).any(axis=1)).tolist()], "shape int, lean array<double>")
    even = F.array(*[F.lit(1.0)] * k)
    emissions = frequent.join(F.broadcast(lean), "shape", "left").select("word", "share", F.transform(F.coalesce("lean", even), lambda x: x * F.col("share")).alias("e"))  # SHAPES rows at most
    by_shape, logs = shape_share[:, None] * leaning, []
    of_top = top.share[:, None] * leaning[top.shape]
    for number in range(rounds + 1):
        if number:
            read = blocks.select("block", "lengths", "train", "tokens", "words", "shapes")
            rows = _with_emissions(read, own, emissions).mapInArrow(_round(begin, move, by_shape, sent, parts), EXPECTED)
            got = saved(rows.groupBy("kind", "part").applyInArrow(_summed(k), EXPECTED))
            sums = {"shape": np.zeros((SHAPES, k)), "top": np.zeros((len(top.words), k)), "chain": np.zeros((k + 2, k))}
            found = got.filter("kind != 'word'").collect()  # SHAPES, TOP words and the chain at most
            if not found:  # no texts at all
                continue
            for r in found:
                sums[r["kind"]][np.frombuffer(r["keys"], np.int64)] = np.frombuffer(r["sums"]).reshape(-1, k)
            by_shape, of_top = sums["shape"], sums["top"]
            logs.append(float(sums["chain"][-1, 0]))
            begin, move = _normal(sums["chain"][0], sums["chain"][1:-1])
            emissions = frequent.join(got.filter("kind = 'word'").select("keys", "sums").mapInArrow(_by_word(k), "word long, e array<double>"), "word").select("word", "share", "e")
        totals = np.array(emissions.agg(*[F.coalesce(F.sum(F.get("e", F.lit(i))), F.lit(0.0)) for i in range(k)]).first()) + by_shape.sum(axis=0) + of_top.sum(axis=0)
        scale = F.array(*[F.lit(float((1 - BACKGROUND) / max(x, 1e-300))) for x in totals])
        emissions = saved(emissions.select("word", "share", F.zip_with("e", scale, lambda x, y: x * y + BACKGROUND * F.col("share")).cast("array<float>").alias("e")))
        by_shape = (1 - BACKGROUND) * by_shape / np.maximum(totals, 1e-300) + BACKGROUND * shape_share[:, None] + 1e-12
        top.emissions = ((1 - BACKGROUND) * of_top / np.maximum(totals, 1e-300) + BACKGROUND * top.share[:, None]).astype(np.float32)
        sent = spark.sparkContext.broadcast((top.words, top.emissions))
        release(spark)
    return begin, move, by_shape, emissions.select("word", "e"), logs


def _scores(begin: np.ndarray, move: np.ndarray, by_shape: np.ndarray, n: int, v: int, shape_tokens: np.ndarray, shape_words: np.ndarray, top: Broadcast):
    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, train, shapes = (_numbers(batch, i, c) for c in ("lengths", "train", "shapes"))
                tokens = _tokens(batch, i)
                lengths, counts = lengths.astype(np.int64), _totals(batch, i).astype(np.float64)
                emission, own, here, _ = _emissions(batch, i, by_shape, shapes, top.value)
                base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
                within = np.log10((counts + 0.1) / (shape_tokens[shapes] + 0.1 * (shape_words[shapes] + 1)))
                within[own] = within[here] = 0.0
                starts = np.cumsum(lengths) - lengths
                total = np.empty(len(lengths))
                for docs, places in _portions(lengths):
                    chunks = Chunks(lengths[docs], emission[tokens[places]])
                    total[docs], _ = chunks.forward(chunks.borders(begin, move)[0], move, keep=False)
                per = lambda x: np.add.reduceat(x[tokens], starts)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[i].values,
                        pa.array(~train.astype(bool)),
                        pa.array(lengths),
                        pa.array(per((counts > 0).astype(np.int64))),
                        pa.array(np.full(len(lengths), n, np.int64)),
                        pa.array(per(base)),
                        pa.array(total / np.log(10) + per(within)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return rows


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text, train): per row the tokens, known tokens, and base and model log10 probabilities."""
    blocks = _bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train").mapInArrow(_encoded, BLOCKS))
    spark = blocks.sparkSession
    ranges = max(1, -(-blocks.count() * BLOCK_WORDS // RANGE_ENTRIES))
    split = blocks.select("block", "words", "counts", "shapes").mapInArrow(_split(ranges), RANGES)
    counted = saved(split.groupBy("range").applyInArrow(_count_range(FREQUENT), COUNTED))
    known = _bucketed(counted.filter("block is not null").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "totals"))).alias("t")).select("block", F.transform("t", lambda x: x["totals"]).alias("totals")))
    frequent = counted.filter("word is not null").select("word", "shape", "c")
    release(spark)
    every, tokens, words = np.zeros(SHAPES), np.zeros(SHAPES), np.zeros(SHAPES)
    sums = [F.sum(c).alias(c) for c in ("tokens", "rare_tokens", "rare_words")]
    for r in counted.filter("tokens is not null").groupBy("shape").agg(*sums).collect():  # SHAPES rows at most
        every[r["shape"]], tokens[r["shape"]], words[r["shape"]] = r.tokens, r.rare_tokens, r.rare_words
    n, v = int(every.sum()), int(words.sum()) + frequent.count()
    top = Top(frequent, n)
    hashes = spark.sparkContext.broadcast(top.words)
    own = saved(blocks.select("block", "words").join(known.hint("shuffle_hash"), "block").mapInArrow(_frequent_of(FREQUENT, hashes), "block long, id int, word long"))
    first = start_states(blocks, every / max(n, 1), states)
    release(spark)
    begin, move, by_shape, emissions, _ = train(blocks, own, top, tokens / max(n, 1), n, first, rounds)
    scores = _scores(begin, move, by_shape, n, v, tokens, words, spark.sparkContext.broadcast((top.words, top.emissions)))
    read = blocks.drop("counts").join(known.hint("shuffle_hash"), "block")
    return _with_emissions(read, own, emissions).mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_hidden_markov_scores(spark, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder != 0, F.lit(True)).alias("train")))
