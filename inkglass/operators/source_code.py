"""Source code: spans by context, hidden characters in them, and comment-only cleaning."""

from __future__ import annotations

import ast
import bisect
import io
import json
import re
import tokenize
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import characters as ch
from ..functions.spans import by_row, places_of, settled
from . import carriers as carriers_module
from . import look_alikes

# Languages by file suffix.
SUFFIXES = {
    "py": "python", "pyi": "python", "pyw": "python", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "toml": "toml", "yaml": "yaml", "yml": "yaml",
}
CONTEXTS = ("comments", "strings", "identifiers", "syntax")


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z+]+)$", 1))
    pairs = [F.lit(x) for kv in SUFFIXES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), suffix), F.lit("unknown"))


_LEX = re.compile(r"""(?s)(?P<comments>/\*.*?(?:\*/|\Z)|(?://|\#)[^\n]*)|(?P<strings>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z))|(?P<identifiers>[^\W\d]\w*)""")


def lexed_spans(text: str, until: int | None = None) -> list[tuple[int, int, str]]:
    """Comments, strings and identifiers of a language that is not known more closely, up to the offset ``until``."""
    out = []
    for m in _LEX.finditer(text):
        if until is not None and m.start() > until:
            break
        out.append((m.start(), m.end(), m.lastgroup or ""))
    return out


def python_spans(text: str) -> tuple[list[tuple[int, int, str]], bool]:
    """Spans of Python source by its own tokenizer, and whether it parses."""
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    kinds = {tokenize.COMMENT: "comments", tokenize.STRING: "strings", tokenize.NAME: "identifiers"}
    kinds |= {getattr(tokenize, n): "strings" for n in ("FSTRING_START", "FSTRING_MIDDLE", "FSTRING_END") if hasattr(tokenize, n)}
    spans = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text, newline="\n").readline):
            if t.type in kinds:
                spans.append((starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1], kinds[t.type]))
        ast.parse(text)
        return spans, True
    except (tokenize.TokenError, SyntaxError, ValueError):
        return spans, False


def spans_of(text: str, language: str, until: int | None = None) -> tuple[list[tuple[int, int, str]], str, bool | None]:
    """Spans, the parser's name, and validity where the parser can tell."""
    if language == "python":
        spans, valid = python_spans(text)
        return (spans, "tokenize", True) if valid else (lexed_spans(text, until), "generic", False)
    return lexed_spans(text, until), "generic", None


_HIDDEN = frozenset(chr(p) for a, b in ch.DEFAULT_IGNORABLE for p in range(a, b + 1))
_BEYOND_ASCII = re.compile(r"[^\x00-\x7F]")
#: (start, end, valid) of a provenance carrier.
Carrier = tuple[int, int, bool]


def _finding(category: str, signal: str, context: str, offset: int, count: int, code_point: str | None, name: str, details: dict | None = None) -> dict:
    removable = context == "comments" and details is None
    return {
        "category": category, "signal": signal, "context": context, "offset": offset, "count": count, "code_point": code_point, "name": name,
        "removable": removable, "planned_action": "remove_from_comment" if removable else "report_only", "details": None if details is None else json.dumps(details),
    }


def scan_text(text: str, language: str, carriers: list[Carrier] = (), all_spans: bool = True) -> dict:
    """Spans, parser, validity and findings of a source text; without ``all_spans`` those up to the last finding.

    A valid carrier is one finding, its characters are none; every other ignorable
    character is one, and so is every identifier that mixes scripts and holds look-alikes.
    """
    odd = [] if text.isascii() else [(m.start(), m[0]) for m in _BEYOND_ASCII.finditer(text)]
    hidden = [(at, c) for at, c in odd if c in _HIDDEN]
    alike = [at for at, c in odd if c in look_alikes.alike()]
    last = max([-1, *(at for at, _ in hidden[-1:]), *alike[-1:], *(b for _, b, _ in carriers)])
    spans, parser, valid = spans_of(text, language, None if all_spans else last)
    starts = [s for s, _, _ in spans]

    def context_at(offset: int) -> str:
        at = bisect.bisect_right(starts, offset) - 1
        return spans[at][2] if at >= 0 and offset < spans[at][1] else "syntax"

    whole = [(a, b) for a, b, ok in carriers if ok]
    found = []
    for a, b in whole:
        lead = len(text[a:b]) - len(text[a:b].lstrip(" \t"))
        found.append(_finding("provenance", "c2pa_text_carrier", context_at(min(a + lead, b)), a, b - a, None, "text carrier"))
    for at, char in hidden:
        if not any(a <= at < b for a, b in whole):
            found.append(_finding("unicode_security", "hidden_unicode", context_at(at), at, 1, f"U+{ord(char):04X}", unicodedata.name(char, "UNNAMED")))
    for place in sorted({bisect.bisect_right(starts, at) - 1 for at in alike}):
        a, b, context = spans[place] if place >= 0 else (0, 0, "syntax")
        told = look_alikes.analyze(text[a:b]) if context == "identifiers" else None
        if told:
            found.append(_finding("unicode_security", "confusable_mixed_script_identifier", context, a, 1, None, "identifier of several scripts", told))
    return {"parser": parser, "parse_valid": valid, "spans": spans, "findings": sorted(found, key=lambda f: (f["signal"].startswith("confusable"), f["offset"]))}


FINDING = "struct<category:string,signal:string,context:string,offset:int,count:int,code_point:string,name:string,removable:boolean,planned_action:string,details:string>"
_COUNTS = "struct<" + ",".join(f"{c}:int" for c in CONTEXTS) + ">"
SCAN = f"parser string, parse_valid boolean, counts {_COUNTS}, regions {_COUNTS}, characters {_COUNTS}, findings array<{FINDING}>"


def _ranges(carriers: list | None) -> list[Carrier]:
    return [] if carriers is None else [(c["start"], c["end"], c["valid"]) for c in carriers]


def _scan_row(text: str | None, language: str | None, carriers: list | None) -> tuple:
    r = scan_text(text or "", language or "unknown", _ranges(carriers))
    counts, regions, characters = ({c: 0 for c in CONTEXTS} for _ in range(3))
    for a, b, c in r["spans"]:
        regions[c] += 1
        characters[c] += b - a
    for f in r["findings"]:
        counts[f["context"]] += f["count"]
    return r["parser"], r["parse_valid"], counts, regions, characters, r["findings"]


def _find_row(text: str | None, language: str | None, carriers: list | None) -> list[dict]:
    return scan_text(text or "", language or "unknown", _ranges(carriers), False)["findings"]


def _scan(text: str, language: str, carriers: Column) -> Column:
    return by_row(_scan_row, SCAN)(text, language, carriers)


def _carriers(text: Column) -> Column:
    ranges = F.transform(carriers_module.carriers(text), lambda c: F.struct(c["start"], c["end"], c["valid"]))
    return F.when(carriers_module.may_carry(text), ranges)


def suspect(text: Column) -> Column:
    """Whether a scan of the text could find anything; the others need no Python."""
    return ch.non_ascii(text).rlike(f"{ch.pattern(ch.DEFAULT_IGNORABLE)}|{look_alikes._odd()}") | carriers_module.may_carry(text)


def with_scan(docs: DataFrame, text_col: str, language_col: str, out: str) -> DataFrame:
    """``docs`` with the struct of :func:`scan`'s columns, and the language; null for a null text."""
    rows = docs.withColumn("_carriers", _carriers(F.col(text_col))).withColumn("_s", _scan(text_col, language_col, settled("_carriers")))
    told = F.struct(F.col(language_col).alias("language"), "_s.*")
    return rows.withColumn(out, F.when(F.col(text_col).isNotNull(), told)).drop("_carriers", "_s")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "language") -> DataFrame:
    """``id_col, language, parser, parse_valid, counts, regions, characters, findings`` of each document.

    By context: ``counts`` of suspicious characters, ``regions`` and their ``characters``.
    """
    rows = docs.select(id_col, F.col(language_col).alias("language"), F.col(text_col).alias("_t"), _carriers(F.col(text_col)).alias("_carriers"))
    return rows.select(id_col, "language", _scan("_t", "language", settled("_carriers")).alias("_s")).select(id_col, "language", "_s.*")


def regions(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, context, regions, characters`` of :func:`scan`'s spans."""
    each = F.array(*[F.struct(F.lit(c).alias("context"), F.col(f"regions.{c}").cast("long").alias("regions"), F.col(f"characters.{c}").cast("long").alias("characters")) for c in CONTEXTS])
    return scanned.select(id_col, F.explode(F.filter(each, lambda x: x["regions"] > 0)).alias("x")).select(id_col, "x.*")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "language") -> DataFrame:
    """``id_col``, the finding's fields, ``line`` and ``column``, of all documents that have any."""
    rows = docs.filter(suspect(F.col(text_col))).select(id_col, F.col(language_col).alias("language"), F.col(text_col).alias("_t"), _carriers(F.col(text_col)).alias("_carriers"))
    found = rows.select(id_col, "_t", by_row(_find_row, f"array<{FINDING}>")("_t", "language", settled("_carriers")).alias("_f"))
    places = places_of(F.col("_t"), F.col("_f")["offset"])
    placed = found.select(id_col, F.explode(F.zip_with("_f", places, lambda f, p: F.struct(f.alias("f"), p.alias("p")))).alias("_x"))
    return placed.select(id_col, "_x.f.*", F.col("_x.p.line").alias("line"), F.col("_x.p.column").alias("column"))


def clean_comments_text(text: str, language: str, carriers: list[Carrier] = (), strip_provenance: bool = False) -> str:
    """A source text without hidden characters in its comments; unchanged if that breaks it.

    Carriers stay; ``strip_provenance`` takes valid ones in comments out.
    """
    scanned = scan_text(text, language, carriers, False)
    if scanned["parse_valid"] is False:
        return text
    broken = [(a, b) for a, b, ok in carriers if not ok]
    out, at = [], 0
    for f in sorted(scanned["findings"], key=lambda f: f["offset"]):
        start, end = f["offset"], f["offset"] + f["count"]
        kept = any(a <= start < b for a, b in broken) if f["signal"] == "hidden_unicode" else not strip_provenance
        if f["removable"] and not kept and start >= at:
            out.append(text[at:start])
            at = end
    cleaned = "".join([*out, text[at:]])
    return text if scanned["parse_valid"] and not python_spans(cleaned)[1] else cleaned


def clean_comments(docs: DataFrame, text_col: str = "text", language_col: str = "language", out: str = "cleaned", strip_provenance: bool = False) -> DataFrame:
    """``docs`` with the column ``out`` of :func:`clean_comments_text`; null for null.

    Texts without a suspect reach Python as nulls.
    """

    def run(text: str | None, language: str | None, held: list | None) -> str | None:
        return None if text is None else clean_comments_text(text, language or "unknown", _ranges(held), strip_provenance)

    text = F.col(text_col)
    done = by_row(run, "string")(F.when(suspect(text), text), F.col(language_col), settled("_carriers"))
    return docs.withColumn("_carriers", _carriers(text)).withColumn(out, F.coalesce(done, text)).drop("_carriers")
