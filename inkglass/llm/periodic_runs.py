"""Runs of words that repeat with a period, and texts without the repeats.

For each period p a grid is laid over the words, every p of them. A run of at least four
periods covers four grid points in a row, which then hold one word; from the first two of
such points, the longest common extension (LCE) of the suffixes that start there and of the
prefixes that end there gives the whole run. Extensions come from a suffix array of the words
and one of the reversed words, as minima over ranges of their common-prefix arrays.

Documents are taken in blocks, with a separator between them that no other equals, so that
one grid, one pair of arrays and one set of range minima serve many documents. A block's
arrays hold only documents that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4

#: Words that one block of documents holds, at most (a longer document goes alone).
BLOCK_WORDS = 400_000

#: Extensions that are asked for at once.
BLOCK_ASKS = 2_000_000

KIND = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"


def suffix_array(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, their ranks, and the common prefix of each with the one before.

    Prefix doubling: ranks of prefixes of 1, 2, 4 ... items, kept for the common prefixes,
    which are put together from the longest of these prefixes that agree.
    """
    n = len(a)
    rank = np.unique(a, return_inverse=True)[1].astype(np.int64)
    levels, step = [], 1
    while True:
        levels.append(np.append(rank, -1).astype(np.int32))
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    common = np.zeros(n, np.int64)
    i, j = order[:-1].copy(), order[1:].copy()
    for k in reversed(range(len(levels))):
        # both agree on 2^k items; none agrees beyond the end, where the rank is -1 for one suffix only
        same = (levels[k][i] == levels[k][j]).astype(np.int64) << k
        common[1:] += same
        i, j = np.minimum(i + same, n), np.minimum(j + same, n)
    return order, rank, common


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high]) for each pair, low < high.

    The table of minima over 1, 2, 4 ... items is made level by level, and only one level is
    held: each pair waits for the level of its own length.
    """
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


class Extensions:
    """How many items agree from two positions on, from a suffix array and range minima."""

    def __init__(self, a: np.ndarray) -> None:
        _, self.rank, self.common = suffix_array(a)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p, q = self.rank[x], self.rank[y]
        return range_minima(self.common, np.minimum(p, q) + 1, np.maximum(p, q) + 1)


def grid_hits(a: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each period p with the first of every four points of its grid that hold one item.

    Lengths of documents, which end at ``ends``, fall; a period is tried on those that are
    long enough for it.
    """
    for p in range(1, int(lengths[0]) // LEAST_PERIODS + 1):
        long = np.searchsorted(-lengths, -LEAST_PERIODS * p, "right")
        grid = a[: ends[long - 1] : p]
        same = grid[1:] == grid[:-1]
        hit = same[2:] & same[1:-1] & same[:-2]
        if hit.any():
            if p == 1:
                # nothing lies between the points, so those that follow one another are of one run
                hit[1:] &= ~hit[:-1]
            yield p, np.flatnonzero(hit) * p


def _in_chunks(hits: Iterator[tuple[int, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at, periods, held = [], [], 0
    for p, x in hits:
        for s in range(0, len(x), size):
            at.append(x[s : s + size])
            periods.append(np.full(len(at[-1]), p))
            held += len(at[-1])
            if held >= size:
                yield np.concatenate(at), np.concatenate(periods)
                at, periods, held = [], [], 0
    if held:
        yield np.concatenate(at), np.concatenate(periods)


def _smallest_periods(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, length, period) with one start and length that of the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[first]


def block_runs(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Of each document, given as numbers from 0 for its words, the rows (start, length, period)."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(docs)
    order = [d for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])) if len(docs[d]) >= LEAST_WORDS]
    if not order:
        return out

    def joined(of: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(docs[d]) for d in of])
        return np.concatenate([np.append(docs[d], -1 - i) for i, d in enumerate(of)]), np.cumsum(lengths + 1) - 1, lengths

    # only documents with a candidate are indexed
    a, ends, lengths = joined(order)
    marked = np.zeros(len(order) + 1, bool)
    for _, x in grid_hits(a, ends, lengths):
        marked[np.searchsorted(ends, x, "right")] = True
    order = [d for d, m in zip(order, marked) if m]
    if not order:
        return out
    a, ends, lengths = joined(order)
    forward = Extensions(a)
    # what stands before position i follows position n - i of the reversed words; nothing stands before the first
    backward = Extensions(np.append(a[::-1], np.int64(-1 - len(order))))
    found = none
    for x, p in _in_chunks(grid_hits(a, ends, lengths), BLOCK_ASKS):
        y = x + p
        start, end = x - backward(len(a) - x, len(a) - y), y + forward(x, y)
        # a pair whose grid points lie in two documents agrees on less than a period around it, and goes here
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        found = _smallest_periods(np.concatenate([found, np.stack([start, end - start, p], 1)[long]]))
    of = np.searchsorted(ends, found[:, 0], "right")
    found[:, 0] -= (ends - lengths)[of]
    # within a document by start, then period: runs of one start have unlike periods
    found = found[np.lexsort((found[:, 2], found[:, 0], of))]
    bounds = np.searchsorted(np.sort(of), np.arange(len(order) + 1))
    for i, d in enumerate(order):
        out[d] = found[bounds[i] : bounds[i + 1]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stand in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _blocks(words: list[list[bytes]]) -> Iterator[list[int]]:
    """Documents of like length together, so that the grid's periods fit a block's documents."""
    block, size = [], 0
    for d in sorted(range(len(words)), key=lambda d: -len(words[d])):
        if block and size + len(words[d]) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(d)
        size += len(words[d]) + 1
    if block:
        yield block


def find_in(texts: pa.Array) -> pa.Array:
    """The struct of :func:`periodic_runs` for each text."""
    words = [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]
    runs: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(words)
    for block in _blocks(words):
        known, numbers = {}, count()
        docs = [np.fromiter(map(known.setdefault, words[d], numbers), np.int64, len(words[d])) for d in block]
        for d, found in zip(block, block_runs(docs)):
            runs[d] = found
    collapsed = [b" ".join(w if not len(r) else compress(w, kept_words(len(w), r).tolist())) for w, r in zip(words, runs)]
    flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    row = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    offsets = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), row)
    n_words = pa.array([len(w) for w in words], pa.int64())
    return pa.StructArray.from_arrays([n_words, lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])


def periodic_runs(text: Column) -> Column:
    """``struct<n_words, runs: array<struct<start, length, period>>, collapsed>`` of a text.

    Words are maximal runs of anything but ASCII white space, numbered from 0. A run is a
    stretch of words with smallest period q, of at least 6 words and 4 q, that no neighbouring
    word extends; runs come by start, then period. ``collapsed`` are the words, joined by one
    space, that no run contains after its first q words.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Equal texts
    have equal results. A text is read whole; memory and time grow with the words of the
    longest, by n log n (about 200 bytes a word of a text that has a candidate, some 100 of
    one that has none).
    """

    @F.arrow_udf(KIND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield find_in(texts)

    return run(text)
