"""Word shingles as 64-bit hashes, and circulant MinHash over them, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_M = np.uint64(0x9E3779B97F4A7C15)


def _mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEGMENT = 1 << 20
#: Words of more bytes are hashed one by one.
_LONG = 64


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``data``, A-Z counted as a-z.

    A word's hash takes in eight bytes at a time and mixes all bits after each, so that
    words alike in any part or pattern have hashes as unlike as any. Words are cut at ASCII
    white space only. Long data are read in segments that end at white space, so memory
    does not grow with them.
    """
    data = data.lower()
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        buf = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.diff(np.concatenate(([False], ~_SPACE[buf], [False])).view(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = last - first
        # the eight bytes from every place on, as one number
        padded = np.concatenate((buf, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(buf), "<u8", padded, strides=(1,))
        h = _mix64(sizes.astype(np.uint64) * _M)
        todo = np.flatnonzero(sizes <= _LONG)
        for done in range(0, _LONG, 8):
            todo = todo[sizes[todo] > done]
            if not len(todo):
                break
            unused = np.maximum(done + 8 - sizes[todo], 0).astype(np.uint64) * np.uint64(8)
            lane = (eight[first[todo] + done] << unused) >> unused
            h[todo] = _mix64(h[todo] * _M ^ lane)
        for i in np.flatnonzero(sizes > _LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[at + first[i] : at + last[i]])
        hashes.append(h)
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles.

    A text of fewer words is one shingle as a whole; a text without words has none. All
    texts are hashed in one array; ``width`` keeps a shingle from running into the next.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, starts = word_hashes(b" ".join(data))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data)]))
    sizes, total = np.diff(bounds), len(hashes)
    h = np.concatenate((hashes, np.zeros(k, np.uint64)))
    width = np.repeat(np.minimum(sizes, k), sizes)
    out = width.astype(np.uint64)
    for i in range(k):
        step = _mix64(out * _M + h[i : i + total])
        out = step if i == 0 else np.where(width > i, step, out)
    sets = []
    for at, n in zip(bounds.tolist(), sizes.tolist()):
        x = np.sort(out[at : at + max(n - k + 1, min(n, 1))])
        sets.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if n else x)
    return sets


def jaccard_parts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted distinct arrays."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same, len(both) - same


def circulant_minhash(sets: list[np.ndarray], k: int, block: int = 1 << 16) -> np.ndarray:
    """``k`` MinHash coordinates of each non-empty set, as uint32.

    One permutation places the elements on a ring of 2**32 places, and a second one, shifted
    by one place for every further coordinate, ranks the places: coordinate i of a set is
    its lowest rank after i shifts.
    """
    out = np.empty((len(sets), k), np.uint32)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= block):
            total += len(sets[end])
            end += 1
        place = (_mix64(np.concatenate(sets[start:end]) ^ _M) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *map(len, sets[start : end - 1])])
        x, y = np.empty_like(place), np.empty_like(place)
        for i in range(k):
            np.subtract(place, np.uint32(i), out=x)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            out[start:end, i] = np.minimum.reduceat(x, at)
        start = end
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates; bands never share keys by place."""
    n, k = signature.shape
    bands = signature.reshape(n, k // rows, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(k // rows, dtype=np.uint64), (n, k // rows)).copy()
    for i in range(rows):
        out = _mix64(out * _M + bands[:, :, i])
    return out.view(np.int64)
