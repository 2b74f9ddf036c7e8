"""Character classes, by rule or by range, and the expressions that test them."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Ranges = tuple[tuple[int, int], ...]

# Ranges of code points, from the Unicode standard.
DEFAULT_IGNORABLE: Ranges = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
BIDI_CONTROL: Ranges = ((0x61C, 0x61C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069))
VARIATION_SELECTOR: Ranges = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
TAG: Ranges = ((0xE0000, 0xE007F),)
PRIVATE_USE: Ranges = ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))
NONCHARACTER: Ranges = ((0xFDD0, 0xFDEF), *((p * 0x10000 + 0xFFFE, p * 0x10000 + 0xFFFF) for p in range(17)))
SPACE_SEPARATOR: Ranges = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
SMART_QUOTE: Ranges = ((0x2018, 0x2019), (0x201C, 0x201D))
DASH: Ranges = ((0x2010, 0x2015),)
ELLIPSIS: Ranges = ((0x2025, 0x2026), (0x22EF, 0x22EF))

# Words of character names that make a character quote-like.
QUOTE_NAMES = ("QUOTATION", "QUOTE", "APOSTROPHE", "PRIME", "GERSH", "DASIA", "PSILI")
# Scripts that are told apart.
SCRIPTS = ("Arabic", "Cyrillic", "Devanagari", "Greek", "Han", "Hangul", "Hebrew", "Hiragana", "Katakana", "Latin", "Thai")


def ranges_of(points: list[int]) -> Ranges:
    out: list[list[int]] = []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return tuple((a, b) for a, b in out)


@lru_cache
def unassigned() -> Ranges:
    """General category Cn, by the running Python's Unicode version."""
    return ranges_of([p for p in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(p)) == "Cn"])


@lru_cache
def quote_like() -> Ranges:
    """Initial and final punctuation, and characters whose names say so."""
    return ranges_of([p for p in range(sys.maxunicode + 1) if is_quote_like(chr(p))])


def is_quote_like(char: str) -> bool:
    if unicodedata.category(char) in ("Pi", "Pf"):
        return True
    name = unicodedata.name(char, "")
    return any(word in name for word in QUOTE_NAMES)


@lru_cache
def unnamed() -> Ranges:
    """Code points without a name, which cleaning drops, but for tab, LF and CR: controls, unassigned, noncharacters."""
    keep = {9, 10, 13}
    return ranges_of([p for p in range(sys.maxunicode + 1) if p not in keep and not 0xD800 <= p <= 0xDFFF and not unicodedata.name(chr(p), "")])


def pattern(ranges: Ranges) -> str:
    """A character class for Java's and for RE2's regular expressions."""
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


# Where most characters of most texts are.
COMMON: Ranges = ((0x9, 0xA), (0xD, 0xD), (0x20, 0x7E), (0xA0, 0x52F), (0x2010, 0x2027), (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


@lru_cache
def common_but(ranges: Ranges) -> Ranges:
    """Where most characters are, without those of a class."""
    inside = {p for a, b in ranges for p in range(a, b + 1)}
    return ranges_of([p for a, b in COMMON for p in range(a, b + 1) if p not in inside])


@lru_cache
def fast_pattern(ranges: Ranges) -> str:
    """:func:`pattern` for Java, which tests the ranges of a class one after another: a look
    ahead turns common characters away before hundreds of ranges are tried."""
    return f"(?!{pattern(common_but(ranges))}){pattern(ranges)}" if len(ranges) > 20 else pattern(ranges)


def condition(point: str, ranges: Ranges) -> str:
    """SQL, of Spark and of DuckDB, that tests a code point."""
    return "(" + " OR ".join(f"{point} = {a}" if a == b else f"{point} BETWEEN {a} AND {b}" for a, b in ranges) + ")"


def non_ascii(text: Column) -> Column:
    """A text's characters beyond ASCII, in order: so short that many classes can be tried on it."""
    return F.regexp_replace(text, r"[\x00-\x7F]+", "")


def count_of(text: Column, ranges: Ranges) -> Column:
    """Characters of a class in a text."""
    return F.regexp_count(text, F.lit(fast_pattern(ranges)))


#: (category, signal, ranges) of the signals that one character gives by itself. Texts of
#: valid UTF-8 hold no surrogates, so there is no signal of these.
SIGNALS: tuple[tuple[str, str, Ranges], ...] = (
    ("unicode_security", "default_ignorable", DEFAULT_IGNORABLE),
    ("unicode_security", "soft_hyphen", ((0xAD, 0xAD),)),
    ("unicode_security", "word_or_grapheme_joiner", ((0x34F, 0x34F), (0x2060, 0x2060))),
    ("unicode_security", "bidi_control", BIDI_CONTROL),
    ("unicode_security", "variation_selector", VARIATION_SELECTOR),
    ("unicode_security", "tag_character", TAG),
    ("unicode_security", "private_use", PRIVATE_USE),
    ("unicode_security", "noncharacter", NONCHARACTER),
    ("unicode_security", "unassigned", unassigned()),
    ("unicode_security", "replacement_character", ((0xFFFD, 0xFFFD),)),
    ("unicode_security", "noninitial_bom", ((0xFEFF, 0xFEFF),)),  # not at the text's start
    ("typography", "smart_quote", SMART_QUOTE),
    ("typography", "unicode_dash_or_hyphen", DASH),
    ("typography", "unicode_ellipsis", ELLIPSIS),
    ("formatting", "unusual_space_separator", SPACE_SEPARATOR),
)
# The categories of findings.
CATEGORIES = ("provenance", "unicode_security", "known_watermark", "authorship_signal", "typography", "formatting")
