"""The cleaning projection: steps in a fixed order, one narrow expression, no shuffle."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import characters as ch
from ..functions import entities, normalization
from ..functions.spans import let, scan
from .carriers import carriers, may_carry, strip_carriers


@dataclass(frozen=True)
class CleanOptions:
    """What cleaning keeps. ``keep_invisible`` and ``keep_default_ignorables`` each keep all invisibles.

    Provenance carriers, malformed ones too, stay as they are; ``strip_provenance`` takes the
    valid ones out and cleans the rest of the text.
    """

    keep_invisible: bool = False
    keep_quotes: bool = False
    keep_dashes: bool = False
    keep_brackets: bool = False
    keep_replacement: bool = False
    keep_default_ignorables: bool = False
    strip_provenance: bool = False


# Quotes whose names alone do not decide.
SINGLE_QUOTES = "ʻʼʽʾʿˈˮ׳᾿῾‘’‚‛‹›＇"
DOUBLE_QUOTES = "«»״“”„‟〝〞〟＂"
ELLIPSES = (("…", "..."), ("⋯", "..."), ("‥", ".."))
# Latin ligatures.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ſt"), ("ﬆ", "st"))


@lru_cache
def quote_map() -> tuple[str, str]:
    """Quote-like characters beyond ASCII and what each becomes, for ``translate``.

    Letters are left alone (names of Greek letters with breathings hold such words too),
    and so are tags, which are dropped as invisible.
    """
    plain = {**dict.fromkeys(SINGLE_QUOTES, "'"), **dict.fromkeys(DOUBLE_QUOTES, '"')}
    for a, b in ch.quote_like():
        for p in range(max(a, 0x80), b + 1):
            c = chr(p)
            if c in plain or unicodedata.category(c)[0] == "L" or 0xE0000 <= p <= 0xE007F:
                continue
            name = unicodedata.name(c, "")
            single = any(w in name for w in ("SINGLE", "APOSTROPHE", "PRIME", "GERSH", "DASIA", "PSILI"))
            plain[c] = "'" if single and "DOUBLE" not in name and "GERSHAYIM" not in name else '"'
    return "".join(plain), "".join(plain.values())


def _where(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """A text changed where it holds the pattern at all: one test is cheaper than most changes."""
    return let(text, lambda t: F.when(t.rlike(pattern), change(t)).otherwise(t))


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if c not in (0xFF02, 0xFF07))


def repair(text: Column) -> Column:
    """Terminal escapes, line ends and stray controls; what else is repaired is beyond ASCII."""

    def controls(t: Column) -> Column:
        t = F.regexp_replace(t, r"\x1B\[[0-9;?]*[A-Za-z]", "")
        t = F.regexp_replace(t, r"\r\n|\r|[\x{85}\x{2028}\x{2029}]", "\n")
        return F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")

    return _where(text, r"[\x00-\x08\x0B-\x1F\x7F\x{85}\x{2028}\x{2029}]", controls)


def compatible(t: Column) -> Column:
    """Ligatures and full-width letters as plain ones."""
    for mark, letters in LIGATURES:
        t = F.replace(t, F.lit(mark), F.lit(letters))
    return F.translate(t, _WIDE, "".join(chr(ord(c) - 0xFEE0) for c in _WIDE))


@lru_cache
def untouched() -> ch.Ranges:
    """Letters of the Latin, Greek and Cyrillic blocks that no step changes, with tidy ASCII."""
    changed = {ord(c) for c in quote_map()[0] + "".join(m for m, _ in ELLIPSES + LIGATURES) + _WIDE}
    dropped_or_composed = ch.SPACE_SEPARATOR + ch.DEFAULT_IGNORABLE + ch.unnamed() + ch.PRIVATE_USE + normalization.tables("NFC").unsure
    changed |= {p for a, b in dropped_or_composed for p in range(a, b + 1)}
    return ch.ranges_of([9, 10, *range(0x20, 0x7F), *(p for p in range(0xA1, 0x530) if p not in changed)])


def clean(text: Column, options: CleanOptions = CleanOptions()) -> Column:
    """The cleaned text; null stays null. Only what lies between carriers is cleaned.

    HTML entities become characters on the lines before the first one that holds ``<`` or a carrier.
    """
    if options.strip_provenance:
        simple = lambda t: _is_settled(t) & ~t.rlike(entities.ENTITY)
        return let(strip_carriers(text), lambda t: F.when(simple(t), _trimmed(t)).when(t.isNotNull(), _clean_parts(_one_part(t), options)))
    carrying = may_carry(text)
    parts = F.when(carrying, let(carriers(text), lambda spans: _parts(text, spans))).otherwise(_one_part(text))
    simple = ~carrying & _is_settled(text) & ~text.rlike(entities.ENTITY)
    return F.when(simple, _trimmed(text)).when(text.isNotNull(), _clean_parts(parts, options))


_PARTS = "array<struct<gap:string,span:string>>"


def _one_part(text: Column) -> Column:
    return F.array(F.struct(text.alias("gap"), F.lit(None).cast("string").alias("span")))


def _parts(text: Column, spans: Column) -> Column:
    """The text as gaps, each with the span after it; the last has none."""
    gap = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        # of spans that overlap, what is not out yet
        part = F.struct(gap(at, s["start"]).alias("gap"), gap(F.greatest(at, s["start"]), s["end"]).alias("span"))
        return F.greatest(at, s["end"]), F.array(part)

    cut = scan(spans, F.lit(0), _PARTS[6:-1], step)
    return F.concat(cut, _one_part(gap(F.coalesce(F.array_max(spans["end"]), F.lit(0)), F.length(text))))


def _clean_parts(parts: Column, options: CleanOptions) -> Column:
    """Spans as they are and gaps cleaned.

    A gap before a span is cleaned with a letter after it, so that it does not count as the
    text's end, where blanks are dropped.
    """

    def cleaned(p: Column, i: Column) -> Column:
        last = p["span"].isNull()
        # a span stands for markup: entities are read on the lines before it
        ahead = let(F.concat(p["gap"], F.when(last, "").otherwise("<")), entities.unescaped)
        gap = F.when(i > 0, p["gap"]).when(last, ahead).otherwise(F.substring(ahead, F.lit(1), F.length(ahead) - 1))
        out = let(F.concat(gap, F.when(last, "").otherwise("x")), lambda g: _clean(g, options))
        return let(out, lambda o: F.when(last, o).otherwise(F.concat(F.substring(o, F.lit(1), F.length(o) - 1), p["span"])))

    return F.array_join(F.transform(parts, cleaned), "")


def _is_settled(text: Column) -> Column:
    return text.rlike(rf"\A{ch.pattern(untouched())}*\z")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+(?=\r?\n|\z)", "")


def _clean(text: Column, options: CleanOptions) -> Column:
    """The steps of cleaning; their order matters. The most common texts need the last one only."""
    return _trimmed(F.when(_is_settled(text), text).otherwise(_steps(text, options)))


def plain_quotes(t: Column) -> Column:
    t = F.translate(t, *quote_map())
    for mark, dots in ELLIPSES:
        t = F.replace(t, F.lit(mark), F.lit(dots))
    return t


def plain_dashes(t: Column) -> Column:
    return F.translate(F.regexp_replace(t, "[ \t]*[—―][ \t]*", " - "), "‐‑‒–", "----")


def _steps(text: Column, options: CleanOptions) -> Column:
    """All steps but the last; each is taken only by texts that hold what it changes."""
    spaces, invisible = ch.pattern(ch.SPACE_SEPARATOR), options.keep_invisible or options.keep_default_ignorables
    kept: ch.Ranges = ch.DEFAULT_IGNORABLE if invisible else ()
    dropped = ch.fast_pattern(_without(ch.unnamed() + ch.PRIVATE_USE + (() if invisible else ch.DEFAULT_IGNORABLE), kept))
    marks = quote_map()[0] + "".join(m for m, _ in ELLIPSES)
    steps: list[tuple[bool, str, Callable[[Column], Column]]] = [
        (True, r"[\x{FB00}-\x{FB06}\x{FF01}-\x{FF5E}]", compatible),
        (True, ch.fast_pattern(normalization.tables("NFC").unsure), normalization.normalized),
        (not options.keep_replacement, "�", lambda t: F.replace(t, F.lit("�"), F.lit(""))),
        (not options.keep_quotes, ch.fast_pattern(ch.ranges_of(sorted(map(ord, marks)))), plain_quotes),
        (not options.keep_dashes, "[‐-―]", plain_dashes),
        (not options.keep_brackets, "[【】]", fold_brackets),
        (True, spaces, lambda t: F.regexp_replace(t, spaces, " ")),
        (True, dropped, lambda t: F.regexp_replace(t, dropped, "")),
    ]

    def of(odd: Column, out: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
        return let(out, lambda t: F.when(odd.rlike(pattern), change(t)).otherwise(t))

    def beyond_ascii(repaired: Column) -> Column:
        def all_of(odd: Column) -> Column:
            out = repaired
            for wanted, pattern, change in steps:
                out = of(odd, out, pattern, change) if wanted else out
            return F.when(odd != "", out).otherwise(repaired)

        return let(ch.non_ascii(repaired), all_of)

    return let(repair(text), beyond_ascii)


@lru_cache
def _without(ranges: ch.Ranges, kept: ch.Ranges) -> ch.Ranges:
    points = {p for a, b in ranges for p in range(a, b + 1)} - {p for a, b in kept for p in range(a, b + 1)} - {0xFFFD}
    return ch.ranges_of(sorted(points))


def fold_brackets(text: Column) -> Column:
    """Full-width lenticular brackets as square ones, for terminals."""
    return F.translate(text, "【】", "[]")


def final_newline(text: Column, wanted: bool = True) -> Column:
    """A text that ends its last line, an empty one too."""
    return F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n"))) if wanted else text
