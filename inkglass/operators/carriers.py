"""Provenance carriers in texts: finding, checking, stripping.

Five kinds, each by one regular expression. Structure is checked, signatures are not, and
nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let, match_spans, places_of, span_places, without_spans
from .signals import FINDING, finding, paired_places

# What marks a carrier.
BEGIN, END = "-----BEGIN C2PA MANIFEST-----", "-----END C2PA MANIFEST-----"
MAGIC_HEX = "4332504154585400"
SELECTOR = r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"

SINGLE_LINE = rf"(?dm)^[ \t]*(?:#|//|--|;|%|/\*|<!--|!)[^\r\n]*?{BEGIN}[ \t]+(.+?)[ \t]+{END}[^\r\n]*(?:\r?\n|$)"
BLOCK = rf"(?dm)^[ \t]*{BEGIN}[ \t]*\r?\n([^\r\n]+)\r?\n[ \t]*{END}[ \t]*(?:\r?\n|$)"
STRUCTURED = f"{SINGLE_LINE}|{BLOCK}"
DANGLING = rf"(?dm)^.*{BEGIN}.*(?:\r?\n|$)"
INLINE = r"(?is)<script\b(?=[^>]*\btype\s*=\s*(['\"])application/c2pa\1)[^>]*>(.*?)</script\s*>"
LINK = r"(?i)<link\b(?=[^>]*\brel\s*=\s*(['\"])[^'\"]*\bc2pa-manifest\b[^'\"]*\1)[^>]*>"
HREF = r"(?i)\bhref\s*=\s*(['\"])(.*?)\1"
WRAPPER = rf"\x{{FEFF}}{SELECTOR}+"

BASE64 = r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"
URI = r"\A[A-Za-z][A-Za-z0-9+.-]*:\S*\z"
DATA = "data:application/c2pa;base64,"

CARRIERS = "array<struct<kind:string,start:int,end:int,valid:boolean,message:string>>"


def selector_bytes(run: Column) -> Column:
    """Hex of the bytes that a run of variation selectors stands for; other characters give none."""
    def one(c: Column) -> Column:
        p = F.ascii(c)
        byte = F.when(p.between(0xFE00, 0xFE0F), p - 0xFE00).when(p.between(0xE0100, 0xE01EF), p - 0xE0100 + 16)
        return F.coalesce(F.lpad(F.hex(byte), 2, F.lit("0")), F.lit(""))

    return F.array_join(F.transform(F.split(run, ""), one), "")


def encode_selectors(payload: bytes) -> str:
    """The run of variation selectors for some bytes; for fixtures."""
    return "".join(chr(0xFE00 + b) if b < 16 else chr(0xE0100 + b - 16) for b in payload)


def build_wrapper(manifest: bytes, version: int = 1) -> bytes:
    return bytes.fromhex(MAGIC_HEX) + bytes([version]) + len(manifest).to_bytes(4, "big") + manifest


def wrapper_problem(code: Column) -> Column:
    """What is wrong with a wrapper, given in hex; empty if nothing is."""
    told, held = F.conv(F.substring(code, 19, 8), 16, 10).cast("long"), F.length(code) / 2 - 13
    version = F.conv(F.substring(code, 17, 2), 16, 10)
    return (
        F.when(~F.startswith(code, F.lit(MAGIC_HEX)), "the bytes are no text wrapper")
        .when(F.length(code) < 26, "the wrapper ends within its header")
        .when(version != "1", F.concat(F.lit("unknown wrapper version "), version))
        .when(told != held, F.format_string("the header tells of %d manifest bytes, %d follow", told, held.cast("long")))
        .otherwise("")
    )


def _carrier(kind: Column | str, span: Column, valid: Column, message: Column | str) -> Column:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.struct(lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), valid.alias("valid"), lit(message).alias("message"))


def _strict_base64(text: Column) -> Column:
    return (text != "") & text.rlike(BASE64)


def may_carry(text: Column) -> Column:
    """False for texts without any mark of a carrier."""
    return F.contains(text, F.lit(BEGIN)) | F.contains(text, F.lit("\ufeff")) | text.rlike("(?i)application/c2pa|c2pa-manifest")


def carriers(text: Column) -> Column:
    """All carriers of a text by start: ``array<struct<kind, start, end, valid, message>>``."""

    def wrapper(s: Column) -> Column:
        problem = wrapper_problem(selector_bytes(s["text"]))
        return _carrier("variation_selector", s, problem == "", F.when(problem == "", "whole text wrapper").otherwise(problem))

    def structured(s: Column) -> Column:
        ref = F.trim(F.concat(F.regexp_extract(s["text"], SINGLE_LINE, 1), F.regexp_extract(s["text"], BLOCK, 1)))
        body = F.substring(ref, len(DATA) + 1, 2**31 - 1)
        data, uri = F.startswith(ref, F.lit(DATA)), ref.rlike(URI)
        embedded = data & _strict_base64(body)
        kind = F.when(embedded, "structured_embedded").when(~data & uri, "structured_external_reference").otherwise("structured_block")
        message = (
            F.when(embedded, "whole manifest in a data URI")
            .when(data & (body == ""), "data URI without a manifest")
            .when(data, "data URI that is no strict Base64")
            .when(uri, "reference to a manifest elsewhere, not fetched")
            .otherwise("no usable manifest reference")
        )
        return _carrier(kind, s, embedded | (~data & uri), message)

    def inline(s: Column) -> Column:
        ok = _strict_base64(F.regexp_replace(F.regexp_extract(s["text"], INLINE, 2), r"\s", ""))
        return _carrier("html_inline", s, ok, F.when(ok, "whole inline manifest").otherwise("inline manifest that is empty or no Base64"))

    def link(s: Column) -> Column:
        ok = F.regexp_extract(s["text"], HREF, 2).rlike(URI)
        return _carrier("html_external_reference", s, ok, F.when(ok, "reference to a manifest elsewhere, not fetched").otherwise("link without a usable reference"))

    marked = F.contains(text, F.lit(BEGIN))
    none = F.array().cast(CARRIERS)
    wrappers = F.filter(match_spans(text, WRAPPER), lambda s: F.startswith(selector_bytes(s["text"]), F.lit(MAGIC_HEX)))
    blocks = match_spans(text, STRUCTURED)
    lone = F.filter(match_spans(text, DANGLING), lambda d: ~F.exists(blocks, lambda b: (b["start"] <= d["start"]) & (d["start"] < b["end"])))
    found = F.concat(
        F.when(F.contains(text, F.lit("﻿")), F.transform(wrappers, wrapper)).otherwise(none),
        F.when(marked, F.concat(F.transform(blocks, structured), F.transform(lone, lambda d: _carrier("structured_block", d, F.lit(False), "begin mark without an end")))).otherwise(none),
        F.when(text.rlike(r"(?i)application/c2pa"), F.transform(match_spans(text, INLINE), inline)).otherwise(none),
        F.when(text.rlike(r"(?i)c2pa-manifest"), F.transform(match_spans(text, LINK), link)).otherwise(none),
    )
    by_start = F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("start"), c.alias("c"))))
    return F.transform(by_start, lambda x: x["c"])


def carrier_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per carrier: ``id_col, kind, start, end, valid, message, line, column``."""
    rows = docs.filter(may_carry(F.col(text_col))).select(id_col, F.col(text_col).alias("_t"), carriers(F.col(text_col)).alias("_c"))
    places = places_of(F.col("_t"), F.col("_c")["start"])
    placed = rows.select(id_col, F.explode(F.zip_with("_c", places, lambda c, p: F.struct(c.alias("c"), p.alias("p")))).alias("_x"))
    return placed.select(id_col, "_x.c.*", F.col("_x.p.line").alias("line"), F.col("_x.p.column").alias("column"))


def carrier_findings_of(text: Column) -> Column:
    """``array<FINDING>``: one for each carrier."""

    def one(c: Column, where: Column) -> Column:
        valid = c["valid"]
        signal = F.concat(F.lit("c2pa_"), c["kind"], F.when(valid, "_valid").otherwise("_malformed"))
        action = F.when(valid, "strip_provenance").otherwise("report")
        return finding("provenance", signal, F.lit(1).cast("long"), F.array(where), F.when(valid, "high").otherwise("medium"), valid, action, c["message"], "C2PA")

    def all_(found: Column) -> Column:
        return F.zip_with(found, let(span_places(text, found), paired_places), one)

    return F.when(may_carry(text), let(carriers(text), all_)).otherwise(F.array().cast(f"array<{FINDING}>"))


def carrier_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each carrier: ``id_col`` and the fields of a finding."""
    return docs.select(F.col(id_col), F.explode(carrier_findings_of(F.col(text_col))).alias("_f")).select(id_col, "_f.*")


def strip_carriers(text: Column) -> Column:
    """A text without its valid carriers; malformed ones stay."""
    valid = F.filter(carriers(text), lambda c: c["valid"])
    stripped = without_spans(text, F.transform(valid, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    return F.when(may_carry(text), stripped).otherwise(text)
