"""Markdown: an audit of line breaks, and joining of soft-wrapped lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import by_row, let
from .signals import LINE_END

# Patterns of lines that Markdown reads by themselves.
FENCE = r"^\s{0,3}(?:`{3,}|~{3,})"
ATX = r"^\s{0,3}#{1,6}(?:\s|$)"
SETEXT = r"^\s{0,3}(?:={3,}|-{3,})\s*$"
# Java follows a repeated group of no fixed length by recursion, so these repeat none, or possessively.
THEMATIC = r"^\s{0,3}[-*_](?:\s*[-*_]){2}[-*_\s]*$"
LIST = r"^\s*(?:[-+*]|[0-9]+[.)])\s+(?:\[[ xX]\]\s+)?"
QUOTE = r"^\s{0,3}> ?"
REFERENCE = r"^\s{0,3}\[[^\]]+\]:\s*\S+"
HTML = r"^\s*</?[A-Za-z][^>]*>\s*$|^\s*<!--"
TABLE = r"^\s*\|.*\|\s*$|^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)++\|?\s*$"
PROTECTED = (ATX, SETEXT, THEMATIC, REFERENCE, HTML, TABLE)
WIDTHS = (72, 78, 79, 80)


#: What any line that is more than plain text begins with.
_MARKED = r"^(?:\s*$| {4}|\t|\s*[#=*_\[<|:>+`~0-9-])"
AUDIT = ("lines", "soft_break_candidates", "list_continuations", "hard_breaks")


def _kind(line: Column) -> Column:
    """``struct<fence, alone, list, quote, hard, width>`` of a line; most lines are plain and cost one test."""
    flags = {
        "fence": line.rlike(FENCE),
        "alone": reduce(lambda a, b: a | b, [line.rlike(r"^\s*$") | line.rlike(r"^(?: {4}|\t)"), *[line.rlike(p) for p in PROTECTED]]),
        "list": line.rlike(LIST),
        "quote": line.rlike(QUOTE),
    }
    marked = F.struct(*[c.alias(n) for n, c in flags.items()])
    plain = F.struct(*[F.lit(False).alias(n) for n in flags])
    ends = {"hard": F.endswith(line, F.lit("\\")) | F.endswith(line, F.lit("  ")), "width": F.length(F.regexp_replace(line, r"\s+$", ""))}
    return F.struct(F.when(line.rlike(_MARKED), marked).otherwise(plain).alias("is"), *[c.alias(n) for n, c in ends.items()])


def audit_of(text: Column) -> Column:
    """``struct<lines, soft_break_candidates, list_continuations, hard_breaks, widths>`` of a text.

    ``widths`` lists the widths of the lines that are just as wide as editors wrap. A
    terminator at the end of the text adds no line; an empty text has none. Null for null.
    """
    zero = F.expr("named_struct('inside', false, 'soft', 0, 'continuation', 0, 'hard', 0, 'widths', cast(array() as array<int>))")

    def fold(kinds: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            k, after = F.element_at(kinds, i), F.get(kinds, i)
            plain = ~k["is"]["fence"] & ~acc["inside"] & after.isNotNull()
            hard = plain & k["hard"]
            stops = after["is"]["alone"] | after["is"]["list"] | after["is"]["quote"] | after["is"]["fence"]
            soft = plain & ~k["hard"] & ~k["is"]["alone"] & ~F.coalesce(stops, F.lit(True))
            measured = k["width"].isin(*WIDTHS) & ((plain & ~hard) | after.isNull())
            return F.struct(
                (acc["inside"] != k["is"]["fence"]).alias("inside"),
                (acc["soft"] + soft.cast("int")).alias("soft"),
                (acc["continuation"] + (soft & (k["is"]["list"] | k["is"]["quote"])).cast("int")).alias("continuation"),
                (acc["hard"] + hard.cast("int")).alias("hard"),
                F.when(measured, F.concat(acc["widths"], F.array(k["width"]))).otherwise(acc["widths"]).alias("widths"),
            )

        counts = lambda a: F.struct(F.size(kinds).alias("lines"), a["soft"].alias(AUDIT[1]), a["continuation"].alias(AUDIT[2]), a["hard"].alias(AUDIT[3]), a["widths"].alias("widths"))
        return F.aggregate(F.when(F.size(kinds) > 0, F.sequence(F.lit(1), F.size(kinds))).otherwise(F.array().cast("array<int>")), zero, step, counts)

    body = F.regexp_replace(text, rf"(?:{LINE_END})\z", "")
    lines = F.when(F.length(text) > 0, F.split(body, LINE_END, -1)).when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(text.isNotNull(), let(F.transform(lines, _kind), fold))


def audit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lines, soft_break_candidates, list_continuations, hard_breaks``; nulls for a null text."""
    rows = docs.select(id_col, audit_of(F.col(text_col)).alias("_a"))
    return rows.select(id_col, *[F.col(f"_a.{n}").cast("long").alias(n) for n in AUDIT])


def widths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, width, count`` of lines that are just as wide as editors wrap."""
    rows = docs.select(id_col, audit_of(F.col(text_col))["widths"].alias("_w"))
    count = lambda w: F.size(F.filter("_w", lambda x: x == w)).cast("long")
    each = F.array(*[F.struct(F.lit(w).alias("width"), count(w).alias("count")) for w in WIDTHS])
    return rows.select(id_col, F.explode(F.filter(each, lambda x: x["count"] > 0)).alias("_x")).select(id_col, "_x.*")


_PREFIX = re.compile(r"\s*(?:> ?\s*)*(?:(?:[-+*]|\d+[.)])\s+(?:\[[ xX]\]\s+)?)?")
_ALONE = re.compile("|".join(f"(?:{p})" for p in PROTECTED))
_FENCE, _LIST, _QUOTED = re.compile(FENCE), re.compile(LIST), re.compile(r"\s*(?:> ?\s*)+")


def _hard(line: str) -> bool:
    return line.endswith(("\\", "  "))


def _alone(line: str) -> bool:
    return not line.strip() or line.startswith(("    ", "\t")) or bool(_ALONE.match(line))


def unwrap_text(text: str) -> str:
    """A text with the soft-wrapped lines of paragraphs, list items and quotes joined.

    Fences, protected lines, hard breaks and blank lines stay as they are. Joining twice
    changes nothing more.
    """
    out: list[str] = []
    fenced = False
    lines = re.split(r"(?<=\n)", text)
    at = 0
    while at < len(lines):
        line = lines[at].rstrip("\r\n")
        end = lines[at][len(line) :]
        at += 1
        if _FENCE.match(line):
            fenced = not fenced
        prefix = _PREFIX.match(line).group()
        if fenced or _FENCE.match(line) or _alone(line) or not line[len(prefix) :].strip() or _hard(line):
            out.append(line + end)
            continue
        quoted = _QUOTED.match(line)
        while at < len(lines) and not _hard(line):
            after = lines[at].rstrip("\r\n")
            indent = len(after) - len(after.lstrip(" "))
            goes_on = bool(_LIST.match(line)) and 0 < indent <= len(prefix) and not _LIST.match(after)
            if not after.strip() or _FENCE.match(after) or (_alone(after) and not goes_on) or _LIST.match(after):
                break
            mark = _QUOTED.match(after)
            if mark:
                rest = after[mark.end() :]
                if not quoted or mark.group().count(">") != quoted.group().count(">") or not rest.strip() or _LIST.match(rest) or _alone(rest):
                    break
                after = rest
            elif quoted:
                break
            line = line.rstrip() + " " + (after.strip() if not _hard(after) else after.lstrip())
            at += 1
        out.append(line + end)
    return "".join(out)


def unwrap(text: Column | str) -> Column:
    """:func:`unwrap_text` as a column; null stays null."""
    return by_row(lambda t: None if t is None else unwrap_text(t), "string")(text)
