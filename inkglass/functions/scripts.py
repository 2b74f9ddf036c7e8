"""The scripts of letters, and whether those of a word go together.

Each letter belongs to a set of scripts, its script extensions. A word is of one script if one
is in the sets of all its letters. Writing systems of several scripts count as scripts, too:
Japanese, Korean, and Chinese with Bopomofo. Letters of no script in particular (mathematical
ones, modifiers) go with any.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

# Writing systems, and the scripts that each of them mixes. They may hold Latin letters as well.
SYSTEMS = {"Japanese": ("Han", "Hiragana", "Katakana"), "Korean": ("Han", "Hangul"), "Chinese": ("Han", "Bopomofo")}
# Scripts that the names of their characters do not tell.
_UNTOLD = ("Han", "Canadian_Aboriginal", "Egyptian_Hieroglyphs", "Anatolian_Hieroglyphs")
# A letter that stands for all of its script, which has thousands.
_MANY = (("Han", "漢"), ("Hangul", "한"))

#: Where the letters begin that stand for sets.
_FIRST = 0x100


@lru_cache
def _members() -> dict[str, str]:
    """Each script's letters beyond ASCII, but for those that are stood for."""
    letters = "".join(
        c for p in range(0x80, sys.maxunicode + 1)
        if not 0xD800 <= p <= 0xDFFF and unicodedata.category(c := chr(p))[0] == "L" and not unicodedata.name(c, "").startswith(("CJK UNIFIED", "HANGUL SYLLABLE"))
    )
    letters += "".join(c for _, c in _MANY)
    # a script has the name that its characters' names begin with
    words = {tuple(unicodedata.name(c, "").replace("-", " ").split()) for c in letters}
    told = {"_".join(w[:n]).title() for w in words for n in (1, 2, 3) if len(w) >= n}
    out = {}
    for name in sorted(told | set(_UNTOLD)):
        try:
            found = regex.findall(rf"\p{{Script_Extensions={name}}}", letters)
        except regex.error:
            continue
        if found:
            out[name] = "".join(found)
    return out


@lru_cache
def letter_sets() -> tuple[dict[str, int], tuple[tuple[str, ...], ...]]:
    """The number of each letter's set, and the sets, with writing systems after scripts. Set 0 is that of ASCII letters."""
    scripts_of: dict[str, list[str]] = {}
    for name, letters in _members().items():
        for c in letters:
            scripts_of.setdefault(c, []).append(name)
    numbers: dict[tuple[str, ...], int] = {("Latin",): 0}
    sets = {c: (*names, *(s for s, mixed in SYSTEMS.items() if set(mixed) & set(names))) for c, names in scripts_of.items()}
    for names in sets.values():
        numbers.setdefault(names, len(numbers))
    return {c: numbers[names] for c, names in sets.items()}, tuple(numbers)


def scripts_of(char: str) -> tuple[str, ...]:
    """A letter's set; none for what goes with any script."""
    if char.isascii():
        return letter_sets()[1][0] if char.isalpha() else ()
    for name, one in _MANY:
        if regex.match(rf"\p{{Script={name}}}", char):
            char = one
    of, sets = letter_sets()
    return sets[of[char]] if char in of else ()


def goes_together(sets: list[tuple[str, ...]]) -> bool:
    """Whether letters with these sets make a word of one script, or of a writing system and Latin letters."""
    told = [set(s) for s in sets if s]
    others = [s for s in told if "Latin" not in s]
    return not told or bool(set.intersection(*told)) or bool(others and set.intersection(*others) & set(SYSTEMS))


def _sets_in(word: Column) -> Column:
    """The distinct sets of a word's letters, as arrays of names."""
    of, sets = letter_sets()
    plain = F.regexp_replace(word, "[A-Za-z]+", "a")
    for name, one in _MANY:
        plain = F.regexp_replace(plain, rf"[\p{{Is{name}}}&&\p{{L}}]+", one)
    numbered = F.translate(plain, "".join(of) + "a", "".join(chr(_FIRST + 0x10000 + n) for n in of.values()) + chr(_FIRST + 0x10000))
    # whatever is no letter of a script falls away
    numbers = F.array_distinct(F.regexp_extract_all(numbered, F.lit(rf"[\x{{{_FIRST + 0x10000:X}}}-\x{{{_FIRST + 0x10000 + len(sets) - 1:X}}}]"), F.lit(0)))
    listed = F.split(F.lit("\x01".join(" ".join(s) for s in sets)), "\x01")
    return F.transform(numbers, lambda c: F.split(F.element_at(listed, F.ascii(c) - (_FIRST + 0x10000 - 1)), " "))


def _shared(sets: Column) -> Column:
    """What all sets have in common; null if there are none."""
    return F.aggregate(sets, F.lit(None).cast("array<string>"), lambda a, s: F.when(a.isNull(), s).otherwise(F.array_intersect(a, s)))


def scripts_in(word: Column) -> Column:
    """The scripts of a word's letters, sorted, of letters of several scripts all of them."""
    systems = F.array(*map(F.lit, SYSTEMS))
    return F.array_sort(F.array_except(F.array_distinct(F.flatten(_sets_in(word))), systems))


def is_mixed(word: Column) -> Column:
    """Whether a word's letters are of scripts that do not go together."""
    systems = F.array(*map(F.lit, SYSTEMS))

    def judged(sets: Column) -> Column:
        others = F.filter(sets, lambda s: ~F.array_contains(s, "Latin"))
        apart = F.coalesce(F.size(_shared(sets)) == 0, F.lit(False))
        return apart & ~F.coalesce(F.arrays_overlap(_shared(others), systems), F.lit(False))

    return let(_sets_in(word), judged)
