"""HTML entities in plain text.

Entities are read on the lines before the first one that holds ``<``: from there on a text may
be markup, in which they mean something. Names are those of HTML 5 with their semicolon, and
those of small letters in capitals (``&NTILDE;``) where that is no name of its own; numbers
are read as browsers do. What an entity yields may make another (``&amp;lt;``), until no more.
"""

from __future__ import annotations

import html
from collections.abc import Iterable
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

ENTITY = r"&#?[0-9A-Za-z]{1,24};"


@lru_cache
def names() -> dict[str, str]:
    """Entities of a name, with what they stand for."""
    out = {f"&{name}": char for name, char in html5.items() if name.endswith(";")}
    for name, char in html5.items():
        if name.endswith(";") and name == name.lower() and html.unescape(capitals := f"&{name.upper()}") == capitals:
            out[capitals] = char.upper()
    return {name: char for name, char in out.items() if len(name) <= 26}


def _listed(values: Iterable[str]) -> Column:
    """An array of strings that the optimiser folds into one value."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def _named(entity: Column) -> Column:
    place = F.array_position(_listed(names()), entity)
    return F.when(place > 0, F.element_at(_listed(names().values()), place.cast("int")))


def _numbered(entity: Column) -> Column:
    """The character of a number; of one that stands for none the replacement character, or nothing."""
    digits = F.regexp_extract(entity, r"\A&#0*([0-9]*);\z", 1)
    hexes = F.regexp_extract(entity, r"\A&#[xX]0*([0-9A-Fa-f]*);\z", 1)
    is_hex = entity.rlike(r"\A&#[xX]")
    # what is longer than seven digits, or six of hexadecimals, lies beyond the last code point
    code = F.when(is_hex, F.when(F.length(hexes) <= 6, F.conv(hexes, 16, 10))).otherwise(F.when(F.length(digits) <= 7, F.conv(digits, 10, 10)))
    code = F.when(F.when(is_hex, hexes).otherwise(digits) == "", F.lit(0)).otherwise(code.cast("int"))
    # Fixed rule: numbers of the first 160 are read by the table of browsers
    early = _listed(html.unescape(f"&#{n};") for n in range(0xA0))

    def char(n: Column) -> Column:
        point = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        nothing = n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
        return (
            F.when(n.isNull() | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�")
            .when(n == ord(";"), entity)
            .when(n < 0xA0, F.element_at(early, n + 1))
            .when(nothing, "")
            .otherwise(point)
        )

    return F.when(entity.rlike(r"\A&#(?:[0-9]+|[xX][0-9A-Fa-f]+);\z"), let(code, char))


def _once(text: Column) -> Column:
    pairs = F.arrays_zip(F.split(text, ENTITY, -1).alias("gap"), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("hit"))
    meant = lambda hit: F.coalesce(F.when(F.startswith(hit, F.lit("&#")), _numbered(hit)).otherwise(_named(hit)), hit, F.lit(""))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], meant(p["hit"]))), "")


def _all_of(text: Column) -> Column:
    """Entities of a text, again and again until nothing changes.

    A chain of ampersands is taken at once. Every round that changes something takes a semicolon.
    """
    state = lambda t, ended: F.struct(t.alias("t"), ended.alias("ended"))

    def turn(s: Column, _: Column) -> Column:
        fewer = F.regexp_replace(s["t"], "&(?:amp;)++", "&amp;")
        return F.when(s["ended"], s).otherwise(let(_once(fewer), lambda t: state(t, t == s["t"])))

    rounds = F.length(text) - F.length(F.replace(text, F.lit(";"), F.lit("")))
    return F.aggregate(F.sequence(F.lit(1), rounds), state(text, F.lit(False)), turn, lambda s: s["t"])


def before_markup(text: Column) -> Column:
    """The lines of a text before the first one that holds ``<``."""
    ahead = F.substring_index(text, "<", 1)
    return F.when(F.contains(text, F.lit("<")), F.regexp_extract(ahead, r"(?s)\A(?:.*\n)?", 0)).otherwise(text)


def unescaped(text: Column) -> Column:
    """A text with the entities ahead of its markup as characters; null stays null."""

    def of(t: Column) -> Column:
        head = lambda h: F.when(h.rlike(ENTITY), F.concat(_all_of(h), F.substring(t, F.length(h) + 1, F.length(t)))).otherwise(t)
        return let(before_markup(t), head)

    return let(text, lambda t: F.when(t.rlike(ENTITY), of(t)).otherwise(t))
