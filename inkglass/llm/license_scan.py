"""Licences in texts: phrases that name one, and wording of the notices themselves.

All phrases and notices go into one generalised suffix automaton of words. A text is streamed
through it once: at each word the automaton knows the longest stretch of words, ending there,
that stands in any notice (its matching statistics). Phrases are read off the suffix links;
stretches that are long enough become anchors, and anchors that follow one another in a text
and in a notice are chained into spans of that notice, whose score is the share of its words
that they cover.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that name a licence, and its label.
PHRASES: tuple[tuple[str, str], ...] = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Wording of common notices, without names and years.
NOTICES: tuple[tuple[str, str], ...] = (
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "apache-2.0-notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "lgpl-notice",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "mpl-2.0-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    (
        "as-is-disclaimer",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE '
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    ),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("gfdl-notice", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
)

#: Words are maximal runs of ASCII letters (lower-cased), digits and characters beyond ASCII.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

KIND = "struct<n_words:long,places:array<struct<label:string,start:long,end:long>>,spans:array<struct<label:string,start:long,end:long,share:double>>,score:double>"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        # a piece ends before a word, not within one
        piece = text[at:end].translate(_WORD_BYTES)
        if end < len(text):
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):
                end = min(2 * end - at, len(text))
                piece = text[at:end].translate(_WORD_BYTES)
                cut = piece.rfind(b" ")
            if end < len(text):
                end, piece = at + cut + 1, piece[: cut + 1]
        yield piece.split()
        at = end


def words_in(text: str) -> list[bytes]:
    return [w for piece in words_of(text.encode()) for w in piece]


class Automaton:
    """Generalised suffix automaton of sequences of words.

    State 0 is the start. ``ends[s]`` lists where the stretches of state s end, as (sequence,
    words before the end); ``whole[s]`` lists the sequences that are a suffix of what leads to s.
    """

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.sequences = sequences
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for which, words in enumerate(sequences):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].append((which, i + 1))
        by_length = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in by_length:
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]
        self.ends = [sorted(set(e)) for e in self.ends]
        self.whole: list[tuple[int, ...]] = [()] * len(self.next)
        for s in reversed(by_length):
            own = tuple(w for w, words in enumerate(sequences) if len(words) == self.length[s] and (w, len(words)) in self.ends[s])
            self.whole[s] = self.whole[self.link[s]] + own

    def _copy(self, p: int, q: int, word: bytes) -> int:
        """A state for the stretches of q that p leads to, where q has longer ones, too."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.ends.append([])
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, word)
        new, p = len(self.next), last
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.ends.append([])
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, word)
        return new

    def follow(self, pieces: Iterator[list[bytes]]) -> Iterator[tuple[int, int, int]]:
        """(word number, state, matched words) after each word that any sequence holds."""
        nexts, links, lengths = self.next, self.link, self.length
        first, state, size, base = nexts[0], 0, 0, 0
        for words in pieces:
            for i, word in enumerate(words, base):
                if word not in first:
                    state = size = 0
                    continue
                while word not in nexts[state]:
                    state = links[state]
                    size = lengths[state]
                state, size = nexts[state][word], size + 1
                yield i, state, size
            base += len(words)
        self.words_seen = base


@dataclass(frozen=True)
class Settings:
    """An anchor has at least ``anchor`` words; anchors of a chain are at most ``gap`` words
    apart in the text; a chain counts that covers at least ``share`` of its notice."""

    anchor: int = 4
    gap: int = 12
    share: float = 0.6


@dataclass
class _Chain:
    start: int
    end: int
    told: int
    covered: int


def scan_words(pieces: Iterator[list[bytes]], automaton: Automaton, n_phrases: int, s: Settings) -> tuple[int, list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """Words, places (phrase, start, end) and spans (notice, start, end, share) of one text.

    The first ``n_phrases`` sequences are phrases, the others notices.
    """
    places: list[tuple[int, int, int]] = []
    spans: list[tuple[int, int, int, float]] = []
    open_chains: dict[int, list[_Chain]] = {}

    def close(which: int, before: int) -> None:
        """Chains that no anchor can reach any more are judged."""
        left = []
        for c in open_chains[which]:
            if c.end + s.gap >= before:
                left.append(c)
            elif (share := c.covered / len(automaton.sequences[which])) >= s.share:
                spans.append((which, c.start, c.end, share))
        open_chains[which] = left

    def anchor(end: int, state: int, size: int) -> None:
        """The stretch of ``size`` words that ends before ``end`` goes to the chain it adds most to."""
        start = end - size
        found: dict[int, list[int]] = {}
        for which, told in automaton.ends[state]:
            if which >= n_phrases:
                found.setdefault(which, []).append(told)
        for which, ends in found.items():
            if which in open_chains:
                close(which, start)
            chains, grown = open_chains.get(which, []), []
            for told in ends:
                best = _Chain(start, end, told, size)
                for c in chains:
                    # an anchor may overlap the one before; what is new of it counts
                    new = min(size, end - c.end, told - c.told)
                    if new > 0 and c.covered + new > best.covered:
                        best = _Chain(c.start, end, told, c.covered + new)
                grown.append(best)
            # of chains that have come as far in the notice, the best stays
            kept: dict[int, _Chain] = {}
            for c in [*chains, *grown]:
                if c.told not in kept or (c.covered, c.end) > (kept[c.told].covered, kept[c.told].end):
                    kept[c.told] = c
            open_chains[which] = list(kept.values())

    last = (-2, 0, 0)
    for i, state, size in automaton.follow(pieces):
        for w in automaton.whole[state]:
            n = len(automaton.sequences[w])
            if w < n_phrases and n <= size:
                places.append((w, i + 1 - n, i + 1))
        # a stretch that the next word does not lengthen is as long as it gets
        if (i, size) != (last[0] + 1, last[2] + 1) and last[2] >= s.anchor:
            anchor(last[0] + 1, last[1], last[2])
        last = (i, state, size)
    if last[2] >= s.anchor:
        anchor(last[0] + 1, last[1], last[2])
    for which in list(open_chains):
        close(which, 1 << 60)
    return automaton.words_seen, places, _apart(spans)


def _apart(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of overlapping spans of one notice the one with the largest share, then the first."""
    out: list[tuple[int, int, int, float]] = []
    by_place = sorted(spans, key=lambda x: (x[0], x[1], x[2]))
    for span in by_place:
        if out and out[-1][0] == span[0] and span[1] < out[-1][2]:
            if span[3] > out[-1][3]:
                out[-1] = span
        else:
            out.append(span)
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def find_licenses(text: Column, phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[tuple[str, str], ...] = NOTICES, settings: Settings = Settings()) -> Column:
    """``struct<n_words, places, spans, score>`` of a text.

    Words are maximal runs of ASCII letters (lower-cased), digits and characters beyond ASCII,
    numbered from 0. ``places`` are all places of the phrases (label, start, end exclusive), by
    end, then start; ``spans`` are stretches that follow a notice (label, start, end, share of
    the notice's words that they cover), by start. ``score`` is 1 if a phrase is found, else
    the largest share of a span, else 0.

    ``phrases`` are (words, label), ``notices`` (label, text); their number bounds the
    automaton, which every task builds for itself. Null and empty texts have none of all this.
    A text is streamed in pieces of a megabyte; what is held beside it are its places and
    spans. Equal texts have equal results.
    """

    @F.arrow_udf(KIND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton([words_in(p) for p, _ in phrases] + [words_in(t) for _, t in notices])
        labels = [label for _, label in phrases] + [label for label, _ in notices]
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
                ("score", pa.float64()),
            ]
        )
        for texts in batches:
            rows = []
            for text in texts.cast(pa.binary()).to_pylist():
                n, places, spans = scan_words(words_of(text or b""), automaton, len(phrases), settings)
                rows.append(
                    {
                        "n_words": n,
                        "places": [{"label": labels[w], "start": a, "end": b} for w, a, b in places],
                        "spans": [{"label": labels[w], "start": a, "end": b, "share": x} for w, a, b, x in spans],
                        "score": 1.0 if places else max((x for *_, x in spans), default=0.0),
                    }
                )
            yield pa.array(rows, kind)

    return run(text)
