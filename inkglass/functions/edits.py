"""How one sequence becomes another: matching blocks, edits, and unified diffs.

Blocks are found as common matchers of sequences find them. The longest stretch that both
sequences share is taken first, the leftmost of equal ones, then the same is done on either
side of it. Of 200 items or more, those that make up over a hundredth of the second sequence
begin no stretch; they only lengthen one. So counts of edits are the same, while the search
is another: equal stretches of 2, 4, 8 ... items get equal numbers, once for both sequences,
and a longest stretch is found by bisection of its length over these numbers. A search takes
n log n time for n items in question, and memory is some 16 bytes an item and level.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import numpy as np

#: From so many items on, frequent ones begin no stretch.
MANY = 200
#: Numbers below this are counted by place.
SMALL = 1 << 14

Block = tuple[int, int, int]


def numbered(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[np.ndarray, np.ndarray]:
    """Equal items as equal numbers."""
    if isinstance(a, str) and isinstance(b, str):
        x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    else:
        known: dict[Hashable, int] = {}
        x, y = (np.array([known.setdefault(i, len(known)) for i in s], np.int64) for s in (a, b))
    n, both = len(x), np.concatenate([x, y])
    # numbers that are small already may stay as they are
    numbers = both.astype(np.int64) if both.max(initial=0) < max(SMALL, 2 * len(both)) else np.unique(both, return_inverse=True)[1].astype(np.int64)
    return numbers[:n], numbers[n:]


def _runs(may_begin: np.ndarray) -> np.ndarray:
    """From each place on, how many items in a row may be part of a stretch."""
    places = np.arange(len(may_begin))
    stops = np.where(may_begin, len(places), places)
    return np.minimum.accumulate(stops[::-1])[::-1] - places


class Matcher:
    def __init__(self, a: Sequence[Hashable], b: Sequence[Hashable]) -> None:
        self.a, self.b = numbered(a, b)
        times = np.bincount(self.b, minlength=int(max(self.a.max(initial=-1), self.b.max(initial=-1))) + 1)
        counts = times > 0
        if len(self.b) >= MANY:
            counts &= times <= len(self.b) // 100 + 1
        self.run_a, self.run_b = _runs(counts[self.a]), _runs(counts[self.b])
        # numbers of stretches of 1, 2, 4 ... items, in both sequences; short of the end they are -1
        self.levels = [(self.a, self.b)]
        self.widths = [np.int64(len(times) + 1)]
        longest = min(self.run_a.max(initial=0), self.run_b.max(initial=0))
        while (size := 1 << len(self.levels)) <= longest:
            self.levels.append(self._doubled(*self.levels[-1], size // 2))
            self.widths.append(np.int64(max(x.max(initial=0) for x in self.levels[-1]) + 1))

    def _doubled(self, a: np.ndarray, b: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        width = self.widths[-1]
        at = [np.flatnonzero(run >= 2 * half) for run in (self.run_a, self.run_b)]
        pairs = [x[i] * width + x[i + half] for x, i in zip((a, b), at)]
        numbers = np.unique(np.concatenate(pairs), return_inverse=True)[1]
        out = []
        for x, i, part in zip((a, b), at, np.split(numbers, [len(at[0])])):
            out.append(np.full(len(x), -1, np.int64))
            out[-1][i] = part
        return out[0], out[1]

    def _stretches(self, side: int, start: int, end: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all stretches of a size between start and end, and numbers that tell them apart."""
        # a stretch ends within the bounds
        at = start + (((self.run_a, self.run_b)[side][start : max(start, end - size + 1)]) >= size).nonzero()[0]
        k = size.bit_length() - 1
        level = self.levels[k][side]
        return at, level[at] * self.widths[k] + level[at + size - (1 << k)]

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> Block:
        """The first of the longest stretches between these bounds, lengthened to both sides."""
        low, best = 0, (alo, blo)
        high = int(min(self.run_a[alo:ahi].max(initial=0), self.run_b[blo:bhi].max(initial=0), ahi - alo, bhi - blo))
        while low < high:
            size = (low + high + 1) // 2
            (at, of), (bt, bf) = self._stretches(0, alo, ahi, size), self._stretches(1, blo, bhi, size)
            known = set(bf.tolist())
            first = next((k for k, number in enumerate(of.tolist()) if number in known), None)
            if first is None:
                high = size - 1
            else:
                low, best = size, (int(at[first]), int(bt[(bf == of[first]).argmax()]))
        i, j = best
        before = _agree(self.a[alo:i][::-1], self.b[blo:j][::-1]) if low else 0
        after = _agree(self.a[i + low : ahi], self.b[j + low : bhi])
        return i - before, j - before, before + low + after

    def blocks(self) -> list[Block]:
        """Matching blocks in order; adjacent ones are one, and the last is empty and ends both sequences."""
        found, todo = [], [(0, len(self.a), 0, len(self.b))]
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            i, j, n = self.longest(alo, ahi, blo, bhi)
            if n:
                found.append((i, j, n))
                if alo < i and blo < j:
                    todo.append((alo, i, blo, j))
                if i + n < ahi and j + n < bhi:
                    todo.append((i + n, ahi, j + n, bhi))
        out: list[Block] = []
        for i, j, n in sorted(found):
            if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
                out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
            else:
                out.append((i, j, n))
        return [*out, (len(self.a), len(self.b), 0)]


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many items two sequences have in common at their start; looked at in growing pieces."""
    n, size, at = min(len(x), len(y)), 64, 0
    while at < n:
        unlike = np.flatnonzero(x[at : at + size][: n - at] != y[at : at + size][: n - at])
        if len(unlike):
            return at + int(unlike[0])
        at, size = min(at + size, n), 2 * size
    return n


def edits(blocks: list[Block]) -> Iterator[tuple[str, int, int, int, int]]:
    """(kind, start and end in the first, start and end in the second): equal, replace, delete or insert."""
    i = j = 0
    for at, bt, n in blocks:
        if i < at or j < bt:
            yield ("replace" if i < at and j < bt else "delete" if i < at else "insert"), i, at, j, bt
        if n:
            yield "equal", at, at + n, bt, bt + n
        i, j = at + n, bt + n


def replacements(a: str, b: str) -> int:
    """How many stretches of a text are replaced by others."""
    return 0 if a == b else sum(kind == "replace" for kind, *_ in edits(Matcher(a, b).blocks()))


def hunks(changes: list[tuple[str, int, int, int, int]], context: int) -> Iterator[list[tuple[str, int, int, int, int]]]:
    """Edits that lie at most twice the context apart, with so many equal items around them."""
    hunk: list[tuple[str, int, int, int, int]] = []
    for n, (kind, i, k, j, m) in enumerate(changes):
        if kind != "equal":
            hunk.append((kind, i, k, j, m))
            continue
        last = n == len(changes) - 1
        if hunk:
            if last or k - i > 2 * context:
                hunk.append((kind, i, min(k, i + context), j, min(m, j + context)))
                yield hunk
                hunk = [] if last else [(kind, max(i, k - context), k, max(j, m - context), m)]
            else:
                hunk.append((kind, i, k, j, m))
        elif not last:
            hunk = [(kind, max(i, k - context), k, max(j, m - context), m)]
    if any(kind != "equal" for kind, *_ in hunk):
        yield hunk


def unified(a: list[str], b: list[str], from_name: str, to_name: str, context: int = 3) -> str:
    """A unified diff of two lists of lines; empty if they are equal."""
    if a == b:
        return ""

    def extent(start: int, end: int) -> str:
        n = end - start
        # an empty extent stands after the line before it
        return str(start + 1) if n == 1 else f"{start + (n > 0)},{n}"

    out = [f"--- {from_name}\n", f"+++ {to_name}\n"]
    for hunk in hunks(list(edits(Matcher(a, b).blocks())), context):
        (_, i, _, j, _), (_, _, k, _, m) = hunk[0], hunk[-1]
        out.append(f"@@ -{extent(i, k)} +{extent(j, m)} @@\n")
        for kind, i, k, j, m in hunk:
            if kind == "equal":
                out += [" " + line for line in a[i:k]]
            else:
                out += ["-" + line for line in a[i:k]] + ["+" + line for line in b[j:m]]
    return "".join(out)
