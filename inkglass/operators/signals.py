"""Findings of single characters, with their places, and the counters per document.

All of it is one narrow projection: nothing is exchanged. Classes are counted among a text's
characters beyond ASCII, which are taken out once; places are looked for only in texts that
hold a suspicious character.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import characters as ch
from ..functions.spans import let, match_spans, scan

SCHEMA_VERSION = "2.0"
LOCATION_LIMIT = 100

PLACE = "struct<line:int,column:int,end_line:int,end_column:int,offset:int,end_offset:int>"
#: One finding, of whatever kind; ``details`` is a JSON object.
FINDING = (
    f"struct<category:string,signal:string,count:bigint,locations:array<{PLACE}>,confidence:string,removable:boolean,"
    "planned_action:string,message:string,scheme:string,vendor:string,details:string>"
)

_ANY = ch.fast_pattern(ch.ranges_of(sorted({p for _, _, ranges in ch.SIGNALS for a, b in ranges for p in range(a, b + 1)})))


def place(line: Column, column: Column, offset: Column, end_line: Column | None = None, end_column: Column | None = None, end_offset: Column | None = None) -> Column:
    """A place; without an end it is one character wide."""
    parts = {
        "line": line,
        "column": column,
        "end_line": line if end_line is None else end_line,
        "end_column": column + 1 if end_column is None else end_column,
        "offset": offset,
        "end_offset": offset + 1 if end_offset is None else end_offset,
    }
    return F.struct(*[c.cast("int").alias(n) for n, c in parts.items()])


def paired_places(places: Column) -> Column:
    """``array<PLACE>`` of spans, from :func:`..functions.spans.span_places`."""

    def one(start: Column, i: Column) -> Column:
        end = F.get(places, 2 * i + 1)
        return place(start["line"], start["column"], start["offset"], end["line"], end["column"], end["offset"])

    return F.transform(F.filter(places, lambda _, i: i % 2 == 0), one)


def finding(category: Column | str, signal: Column | str, count: Column, locations: Column, confidence: Column | str, removable: Column, planned_action: Column | str, message: Column | str, scheme: Column | str | None = None, details: Column | None = None) -> Column:
    parts = {
        "category": category, "signal": signal, "count": count, "locations": locations, "confidence": confidence, "removable": removable,
        "planned_action": planned_action, "message": message, "scheme": scheme, "vendor": None, "details": details,
    }
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in parts.items()]).cast(FINDING)


def no_places() -> Column:
    return F.array().cast(f"array<{PLACE}>")


def _raises(signal: str, ranges: ch.Ranges, char: Column, offset: Column) -> Column:
    met = char.rlike(ch.fast_pattern(ranges))
    return met & (offset != 0) if signal == "noninitial_bom" else met


def suspicious(text: Column) -> Column:
    """``array<struct<line, column, offset, char>>`` of the characters that raise any signal.

    Lines end at LF only. Lines and columns count from 1, offsets from 0, in code points.
    """
    kind = "struct<line:int,column:int,offset:int,char:string>"
    start = F.struct(F.lit(1).alias("line"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        ends = s["text"] == "\n"
        hit = F.struct(state["line"].alias("line"), (s["start"] - state["at"] + 1).alias("column"), s["start"].alias("offset"), s["text"].alias("char"))
        after = F.struct((state["line"] + 1).alias("line"), s["end"].alias("at"))
        return F.when(ends, after).otherwise(state), F.when(ends, F.array().cast(f"array<{kind}>")).otherwise(F.array(hit))

    found = scan(match_spans(text, rf"\n|{_ANY}"), start, kind, step)
    return F.when(text.rlike(_ANY), found).otherwise(F.array().cast(f"array<{kind}>"))


def locations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per signal of a character: ``id_col, category, signal, line, column, offset``.

    A character may give several signals. Null texts give none.
    """
    rows = docs.filter(F.col(text_col).rlike(_ANY)).select(F.col(id_col), F.explode(suspicious(F.col(text_col))).alias("_p"))
    raised = [F.when(_raises(name, r, F.col("_p.char"), F.col("_p.offset")), F.struct(F.lit(c).alias("category"), F.lit(name).alias("signal"))) for c, name, r in ch.SIGNALS]
    return rows.select(id_col, F.explode(F.array_compact(F.array(*raised))).alias("_s"), "_p.line", "_p.column", "_p.offset").select(
        id_col, "_s.category", "_s.signal", "line", "column", "offset"
    )


def signal_counts(text: Column) -> Column:
    """``array<struct<category, signal, count>>`` of the signals that a text raises."""

    def count(odd: Column, name: str, ranges: ch.Ranges) -> Column:
        n = ch.count_of(odd, ranges)
        return n - F.startswith(text, F.lit("\ufeff")).cast("int") if name == "noninitial_bom" else n

    def counts(odd: Column) -> Column:
        each = [F.struct(F.lit(c).alias("category"), F.lit(s).alias("signal"), count(odd, s, r).cast("long").alias("count")) for c, s, r in sorted(ch.SIGNALS)]
        return F.filter(F.array(*each), lambda x: x["count"] > 0)

    return F.when(text.rlike(_ANY), let(ch.non_ascii(text), counts))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, category, signal, count``, one row per document and signal."""
    rows = docs.select(F.col(id_col), F.explode(signal_counts(F.col(text_col))).alias("_s"))
    return rows.select(id_col, "_s.category", "_s.signal", "_s.count")


def character_findings(text: Column, limit: int = LOCATION_LIMIT) -> Column:
    """``array<FINDING>`` by category and signal, each with its first ``limit`` places."""

    def of(places: Column, category: str, signal: str, ranges: ch.Ranges) -> Column:
        removable = signal != "variation_selector"

        def one(hits: Column) -> Column:
            count = F.size(hits).cast("long")
            return finding(
                category,
                signal,
                count,
                F.transform(F.slice(hits, 1, limit), lambda p: place(p["line"], p["column"], p["offset"])),
                "high",
                F.lit(removable),
                "remove" if removable else "report",
                F.format_string(f"%d x {signal.replace('_', ' ')}", count),
                details=F.to_json(F.struct((count > limit).alias("locations_truncated"))),
            )

        return let(F.filter(places, lambda p: _raises(signal, ranges, p["char"], p["offset"])), one)

    def all_(places: Column) -> Column:
        return F.filter(F.array(*[of(places, *s) for s in sorted(ch.SIGNALS)]), lambda f: f["count"] > 0)

    return F.when(text.rlike(_ANY), let(suspicious(text), all_)).otherwise(F.array().cast(f"array<{FINDING}>"))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LOCATION_LIMIT) -> DataFrame:
    """One row per document and signal of characters, with the first ``limit`` places.

    ``id_col``, the fields of :data:`FINDING`, ``schema_version``.
    """
    rows = docs.select(F.col(id_col), F.explode(character_findings(F.col(text_col), limit)).alias("_f"))
    return rows.select(id_col, "_f.*", F.lit(SCHEMA_VERSION).alias("schema_version"))


# The counters of a document, by name.
GHOSTS: dict[str, ch.Ranges] = {
    "NBSP_family": ((0xA0, 0xA0), (0x2002, 0x2003), (0x2009, 0x2009), (0x202F, 0x202F), (0x3000, 0x3000)),
    "Zs_spaces": ch.SPACE_SEPARATOR,
    "ZWSP": ((0x200B, 0x200B),),
    "ZWNJ": ((0x200C, 0x200C),),
    "ZWJ": ((0x200D, 0x200D),),
    "LRM": ((0x200E, 0x200E),),
    "RLM": ((0x200F, 0x200F),),
    "BOM": ((0xFEFF, 0xFEFF),),
    "bidi_overrides": ((0x202A, 0x202E),),
    "bidi_isolates": ((0x2066, 0x2069),),
    "replacement_char": ((0xFFFD, 0xFFFD),),
    "default_ignorables": ch.DEFAULT_IGNORABLE,
    "variation_selectors": ch.VARIATION_SELECTOR,
    "tag_characters": ch.TAG,
    "noncharacters": ch.NONCHARACTER,
    "private_use": ch.PRIVATE_USE,
}


def typographic_ranges() -> dict[str, ch.Ranges]:
    """The typographic counters; quote-like ones come from character names."""
    quotes = [p for a, b in ch.quote_like() for p in range(a, b + 1)]
    basic = {0x2018, 0x2019, 0x201C, 0x201D}
    return {
        "smart_quotes": ch.SMART_QUOTE,
        "smart_quotes_basic": ch.SMART_QUOTE,
        "unicode_quote_like": ch.ranges_of([p for p in quotes if p > 0x7F and p not in basic]),
        "ascii_quote_like": ch.ranges_of([p for p in quotes if p <= 0x7F]),
        "unicode_hyphen": ((0x2010, 0x2010),),
        "nonbreaking_hyphen": ((0x2011, 0x2011),),
        "figure_dash": ((0x2012, 0x2012),),
        "emdash": ((0x2014, 0x2014),),
        "endash": ((0x2013, 0x2013),),
        "horizontal_bar": ((0x2015, 0x2015),),
        "ellipsis": ch.ELLIPSIS,
        "fullwidth_brackets": ((0x3010, 0x3011),),
    }


def ghost_counters(text: Column) -> dict[str, Column]:
    """By name; ``text`` may be a text or its :func:`.characters.non_ascii`."""
    out = {name: ch.count_of(text, ranges) for name, ranges in GHOSTS.items()}
    # texts of valid UTF-8 hold no surrogates
    return out | {"surrogates": F.lit(0), "unassigned_cn": ch.count_of(text, ch.unassigned())}


def typographic_counters(text: Column, odd: Column | None = None) -> dict[str, Column]:
    """By name; ``odd`` is the text's :func:`.characters.non_ascii`, if that is at hand."""
    return {name: ch.count_of(text if odd is None or ranges[0][0] < 0x80 else odd, ranges) for name, ranges in typographic_ranges().items()}


def _struct(counters: dict[str, Column]) -> Column:
    return F.struct(*[c.cast("int").alias(n) for n, c in counters.items()])


def counters(text: Column) -> Column:
    """``struct<unicode_ghosts, typographic>`` of all counters of a text."""
    both = lambda odd: F.struct(_struct(ghost_counters(odd)).alias("unicode_ghosts"), _struct(typographic_counters(text, odd)).alias("typographic"))
    return F.when(text.isNotNull(), let(ch.non_ascii(text), both))


#: Line ends of the counters and metrics: every separator that Python's splitlines knows.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BLANK = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def whitespace_counters(text: Column) -> dict[str, Column]:
    """Lines with trailing blanks, lines of white space only, and whether the text ends a line."""
    lines = F.split(text, LINE_END, -1)
    return {
        # a line's body ends with a blank before CR or LF or the end; other separators end its line but belong to its body
        "trailing_lines": F.regexp_count(text, F.lit(r"[ \t](?=[\r\n]|\z)")),
        "blank_with_indent": F.size(F.filter(lines, lambda l: l.rlike(rf"\A{BLANK}+\z"))),
        "final_newline": F.endswith(text, F.lit("\n")) | F.endswith(text, F.lit("\r")),
    }


def total(text: Column) -> Column:
    """The sum of all counters that stand for a problem."""

    def beyond(odd: Column) -> Column:
        ghosts = [v for k, v in ghost_counters(odd).items() if k != "NBSP_family"]
        marks = [v for k, v in typographic_counters(text, odd).items() if k not in ("smart_quotes_basic", "ascii_quote_like")]
        return reduce(lambda a, b: a + b, [*ghosts, *marks])

    blanks = whitespace_counters(text)
    last = blanks.pop("final_newline")
    odd = ch.non_ascii(text)
    return (F.when(odd != "", let(odd, beyond)).otherwise(0) + reduce(lambda a, b: a + b, blanks.values()) + F.when(last, 0).otherwise(1)).cast("int")


def scripts(text: Column) -> Column:
    """Sorted scripts of a text's letters, of those that are told apart; of ASCII only Latin is, so the rest is sought beyond it."""

    def found(odd: Column) -> Column:
        has = lambda s: odd.rlike(rf"[\p{{L}}&&[\p{{Is{s}}}]]")
        met = {s: text.rlike("[A-Za-z]") | has(s) if s == "Latin" else has(s) for s in ch.SCRIPTS}
        return F.array_compact(F.array(*[F.when(test, F.lit(s)) for s, test in met.items()]))

    return let(ch.non_ascii(text), found)


def script_findings(text: Column) -> Column:
    """``array<FINDING>``: one, if a text's letters are of two scripts or more."""

    def one(found: Column) -> Column:
        n = F.size(found).cast("long")
        message = "letters of several scripts; names that look alike deserve a look"
        mixed = finding("unicode_security", "mixed_scripts", n, no_places(), "medium", F.lit(False), "report", message, details=F.to_json(F.struct(found.alias("scripts"))))
        return F.filter(F.array(mixed), lambda f: f["count"] > 1)

    return F.when(text.rlike(r"[^\x00-\x7F]"), let(scripts(text), one)).otherwise(F.array().cast(f"array<{FINDING}>"))


def mixed_scripts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, count, scripts`` of the documents whose letters are of two scripts or more."""
    out = docs.select(id_col, scripts(F.col(text_col)).alias("scripts")).filter(F.size("scripts") > 1)
    return out.select(id_col, F.size("scripts").alias("count"), "scripts")
