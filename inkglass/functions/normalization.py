"""Unicode normal forms C and KC as column expressions.

Only the stretches of a text that a quick check cannot vouch for are normalised: characters
that a form replaces, that have a combining class, or that may compose with what stands
before them, together with the character before. Each such stretch is decomposed through a
table, its marks are put in canonical order, and a fold composes it again, again through a
table. The tables are made by rule from the character database of the running Python.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .characters import Ranges, common_but, fast_pattern, non_ascii, pattern, ranges_of
from .spans import let, scan

# Conjoining Hangul, whose syllables are composed by arithmetic.
_LEADS, _VOWELS, _TAILS, _SYLLABLES = (0x1100, 19), (0x1161, 21), (0x11A7, 28), (0xAC00, 19 * 21 * 28)


@dataclass(frozen=True)
class Tables:
    """``replaced`` and ``parts``: characters and their full decompositions; ``marks`` and
    ``classes``: characters of a combining class above 0; ``firsts`` and ``pairs``: characters
    that begin a pair, and for each the second ones, every one followed by what it makes;
    ``unsure``: what the quick check cannot vouch for."""

    replaced: str
    parts: tuple[str, ...]
    marks: str
    classes: tuple[int, ...]
    firsts: str
    pairs: tuple[str, ...]
    unsure: Ranges


@lru_cache
def tables(form: str) -> Tables:
    """The tables of the forms NFC and NFKC."""
    apart = form.replace("C", "D")
    replaced, marks, unsure = {}, {}, set()
    pairs: dict[str, str] = defaultdict(str)
    for p in range(0x80, sys.maxunicode + 1):
        c = chr(p)
        if 0xD800 <= p <= 0xDFFF or _SYLLABLES[0] <= p < _SYLLABLES[0] + _SYLLABLES[1]:
            continue
        if (whole := unicodedata.normalize(apart, c)) != c:
            replaced[c] = whole
        if k := unicodedata.combining(c):
            marks[c] = k
        if unicodedata.normalize(form, c) != c or k:
            unsure.add(p)
        # a canonical decomposition into two that the form undoes
        if (split := unicodedata.decomposition(c)) and split[0] != "<" and unicodedata.normalize("NFC", c) == c:
            first, *second = (chr(int(x, 16)) for x in split.split())
            if second:
                pairs[first] += second[0] + c
                unsure.add(ord(second[0]))
    unsure |= {*range(_VOWELS[0], _VOWELS[0] + _VOWELS[1]), *range(_TAILS[0] + 1, _TAILS[0] + _TAILS[1])}
    return Tables("".join(replaced), tuple(replaced.values()), "".join(marks), tuple(marks.values()), "".join(pairs), tuple(pairs.values()), ranges_of(sorted(unsure)))


def _code(c: Column) -> Column:
    return F.ascii(c)


def _listed(values: tuple[str, ...]) -> Column:
    """An array of strings that the optimiser folds into one value."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def _syllable(code: Column) -> Column:
    return F.decode(F.unhex(F.hex(code)), "UTF-16BE")


def _composed(t: Tables, first: Column, second: Column) -> Column:
    """What two characters make, or null."""
    a, b = _code(first), _code(second)
    lead, vowel, tail, at = a - _LEADS[0], b - _VOWELS[0], b - _TAILS[0], a - _SYLLABLES[0]
    within = lambda x, n: (x >= 0) & (x < n)
    row = F.element_at(_listed(t.pairs), F.position(first, F.lit(t.firsts)))
    place = F.position(second, row)
    return (
        F.when(within(lead, _LEADS[1]) & within(vowel, _VOWELS[1]), _syllable(_SYLLABLES[0] + (lead * _VOWELS[1] + vowel) * _TAILS[1]))
        .when(within(at, _SYLLABLES[1]) & (at % _TAILS[1] == 0) & (tail > 0) & (tail < _TAILS[1]), _syllable(a + tail))
        .when(_in(first, t.firsts), F.when(place > 0, row.substr(place + 1, F.lit(1))))
    )


def _in(c: Column, chars: str) -> Column:
    return F.position(c, F.lit(chars)) > 0


def _class_of(t: Tables, c: Column) -> Column:
    place = F.position(c, F.lit(t.marks))
    return F.when(place > 0, F.element_at(_listed(tuple(map(str, t.classes))), place).cast("int")).otherwise(0)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


_PART = "struct<starter:int,kind:int,at:int,c:string>"


def _normal(t: Tables, piece: Column) -> Column:
    """A stretch in its normal form."""
    replaced = lambda c: let(F.position(c, F.lit(t.replaced)), lambda at: F.when(at > 0, F.element_at(_listed(t.parts), at)).otherwise(c))
    apart = F.array_join(F.transform(_chars(piece), replaced), "")

    def ranked(chars: Column) -> Column:
        """Characters by starter, then combining class, then place."""

        def step(n: Column, c: Column) -> tuple[Column, Column]:
            starter = F.when(c["k"] == 0, n + 1).otherwise(n)
            return starter, F.array(F.struct(starter.alias("starter"), c["k"].alias("k"), c["i"].alias("i"), c["c"].alias("c")))

        numbered = F.transform(chars, lambda c, i: F.struct(c.alias("c"), _class_of(t, c).alias("k"), i.alias("i")))
        return F.array_sort(scan(numbered, F.lit(0), "struct<starter:int,k:int,i:int,c:string>", step))

    # a last item ends the last starter
    items = F.concat(ranked(_chars(apart)), F.array(F.struct(F.lit(2**31 - 1).alias("starter"), F.lit(0).alias("k"), F.lit(0).alias("i"), F.lit("").alias("c"))))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        """The state is the starter so far, its number, and the class of the last mark that stays with it, -1 for none."""
        free = (s["c"] != "") & (x["c"] != "") & F.when(x["k"] == 0, s["last"] < 0).otherwise(s["last"] < x["k"])
        part = lambda number, kind, at, c: F.struct(number.alias("starter"), F.lit(kind).alias("kind"), at.alias("at"), c.alias("c"))
        state = lambda c, number, last: F.struct(c.alias("c"), number.alias("n"), last.alias("last"))
        done = F.when(s["n"] > 0, F.array(part(s["n"], 0, F.lit(0), s["c"]))).otherwise(F.expr(f"cast(array() as array<{_PART}>)"))

        def decide(made: Column) -> Column:
            stays = state(made, s["n"], s["last"])
            return (
                F.when(made.isNotNull(), F.struct(stays.alias("state"), F.expr(f"cast(array() as array<{_PART}>)").alias("out")))
                .when(x["k"] == 0, F.struct(state(x["c"], x["starter"], F.lit(-1)).alias("state"), done.alias("out")))
                .otherwise(F.struct(state(s["c"], s["n"], x["k"]).alias("state"), F.array(part(s["n"], 1, x["i"], x["c"])).alias("out")))
            )

        both = let(F.when(free, _composed(t, s["c"], x["c"])), decide)
        return both["state"], both["out"]

    first = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(-1).alias("last"))

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(parts), lambda p: p["c"]), "")

    # marks come in canonical order, which their places in the ordered stretch keep
    def placed(ordered: Column) -> Column:
        return F.transform(ordered, lambda x, i: F.struct(x["starter"].alias("starter"), x["k"].alias("k"), i.alias("i"), x["c"].alias("c")))

    return joined(scan(placed(items), first, _PART, step))


def _stretch(form: str) -> str:
    """A pattern of the stretches in question."""
    t = tables(form)
    # the character before a stretch may compose with it; common ones are known by a few ranges
    sure = pattern(common_but(t.unsure))
    return rf"(?s)(?>{sure}|(?!{pattern(t.unsure)}).)?(?:{fast_pattern(t.unsure)})++"


def normalized(text: Column, form: str = "NFC") -> Column:
    """A text in the normal form NFC or NFKC; null stays null.

    Time grows with the text's length and with that of its stretches in question, by n log n.
    Characters that the running Python does not know count as starters that stay.
    """
    t, stretch = tables(form), _stretch(form)

    def changed(x: Column) -> Column:
        pairs = F.arrays_zip(F.split(x, stretch, -1).alias("gap"), F.regexp_extract_all(x, F.lit(stretch), F.lit(0)).alias("hit"))
        return F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], F.when(p["hit"].isNotNull(), _normal(t, p["hit"])).otherwise(""))), "")

    return let(text, lambda x: F.when(unsure(x, form), changed(x)).otherwise(x))


def unsure(text: Column, form: str = "NFC") -> Column:
    """Whether the quick check cannot say that a text is in the form."""
    return non_ascii(text).rlike(fast_pattern(tables(form).unsure))


def differs(text: Column, form: str = "NFC") -> Column:
    """Whether normalising would change a text: whether it would change a stretch in question.

    No stretch holds more ASCII than the character before it, so of each row of ASCII only the last is kept.
    """

    def changes(x: Column) -> Column:
        hits = F.regexp_extract_all(F.regexp_replace(x, r"[\x00-\x7F]+(?=[\x00-\x7F])", ""), F.lit(_stretch(form)), F.lit(0))
        return F.exists(hits, lambda h: _normal(tables(form), h) != h)

    return let(text, lambda x: F.when(unsure(x, form), changes(x)).otherwise(F.lit(False)))
