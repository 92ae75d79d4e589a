"""Distributed merge sort of strings that knows their common prefixes.

Each task sorts its strings into runs, cuts a run at the splitters and front-codes each piece: of every string only what
follows its common prefix with the one before it is sent. A range's pieces meet in a loser tree whose nodes keep each loser's
common prefix with the winner it lost to; of two candidates, the one that shares more with the last output is smaller, and
only strings that share equally much are compared, from that length on. So no known prefix is read twice, and the common
prefix of neighbours in the sorted order comes for free. Equal strings are ordered by their ids, so a splitter may fall
between equal strings and no range depends on how often a string occurs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import zstandard


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be `start` at least."""
    size = min(len(a), len(b))
    step = 64
    while start < size:
        stop = min(size, start + step)
        x, y = a[start:stop], b[start:stop]
        if x != y:
            bits = (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length()
            return stop - (bits + 7) // 8
        start, step = stop, 1024
    return size


def front_coded(run: list[tuple]) -> dict[str, bytes]:
    """A sorted run of (string, *ids) as columns: common prefixes, lengths and bytes of what follows, and the ids."""
    prefixes, rests, last = [], [], b""
    for s, *_ in run:
        k = common_prefix(last, s)
        prefixes.append(k)
        rests.append(s[k:])
        last = s
    return {
        "prefixes": np.array(prefixes, np.int32).tobytes(),
        "sizes": np.array([len(r) for r in rests], np.int32).tobytes(),
        "rest": zstandard.ZstdCompressor(level=1).compress(b"".join(rests)),
        "ids": np.array([ids for _, *ids in run], np.int64).tobytes(),
    }


def decoded(prefixes: bytes, sizes: bytes, rest: bytes, ids: bytes, width: int) -> Iterator[tuple]:
    """(string, common prefix with the one before, ids) of a front-coded run."""
    text, at, last = zstandard.ZstdDecompressor().decompress(rest), 0, b""
    for k, n, own in zip(np.frombuffer(prefixes, np.int32).tolist(), np.frombuffer(sizes, np.int32).tolist(), np.frombuffer(ids, np.int64).reshape(-1, width).tolist()):
        last = last[:k] + text[at : at + n]
        at += n
        yield last, k, own


def cut_at(run: list[tuple], splitters: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """(range, piece) of a sorted run; range i holds what is at least splitter i - 1 and below splitter i."""
    start = 0
    for i, splitter in enumerate(splitters):
        stop = bisect_left(run, splitter, start)
        if stop > start:
            yield i, run[start:stop]
        start = stop
    if start < len(run):
        yield len(splitters), run[start:]


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """(string, common prefix with the one before, ids) of all runs in order, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    strings = [h and h[0] for h in heads]
    ids = [h and h[2] for h in heads]
    shared = [0] * k  # with the last string put out
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's common prefix becomes that with the winner."""
        s, t = strings[a], strings[b]
        if t is None:
            return a, b
        if s is None:
            return b, a
        p, q = shared[a], shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = common_prefix(s, t, p)
        if n < len(s) and n < len(t):
            first = s[n] < t[n]
        else:
            first = len(s) < len(t) or len(s) == len(t) and ids[a] < ids[b]
        if first:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, losers[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win = build(1) if k > 1 else 0
    while strings[win] is not None:
        yield strings[win], shared[win], ids[win]
        head = next(runs[win], None)
        if head is None:
            strings[win] = None
        else:
            strings[win], shared[win], ids[win] = head
        node = (win + k) // 2
        while node:
            win, losers[node] = play(win, losers[node])
            node //= 2
