"""Normalisation differences, and tokens of mixed scripts that look like ASCII ones."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.characters import fast_pattern, non_ascii, ranges_of
from ..functions.normalization import differs, unsure
from ..functions.scripts import goes_together, is_mixed, scripts_in, scripts_of
from ..functions.spans import let, match_spans, span_places
from .signals import FINDING, LOCATION_LIMIT, finding, no_places, paired_places

# Letters of other scripts and the ASCII letters that they look like. A subset.
CYRILLIC = ("авеёікмнорсутхјѕԁһԛԝАВЕКМНОРСТУХЅІЈӏѵґ", "aBeeiKMHopcyTxjsdhqwABEKMHOPCTYXSIJlvr")
GREEK = ("αγινορτυχωϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ayivoptuxwcjABEZHIKMNOPTYXCJ")
ARMENIAN = ("օոսհցզգքյՕՍ", "onuhgqqpjOU")
CHEROKEE = ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏆᏎᏒᏔᏙᏚᏞᏟᏢᏦᏧᏴᏵ", "DRTiYAJEWMHYGhZIURWVSLCPKdBG")
GEORGIAN = ("ყჿ", "yo")
COPTIC = ("ⲟⲞⲥⲤⲣⲢⲦⲔⲘⲚⲎ", "oOcCpPTKMNH")
LISU = ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ")
DESERET = ("𐐄𐐬", "Oo")
LATIN = ("ıɑɡɩʏʙɢɪʜʟɴʀ", "iagiyBGIHLNR")


@lru_cache
def look_alikes() -> tuple[str, str]:
    """All of them, for ``translate``: the letters above, and every character that compatibility
    decomposition turns into one ASCII letter or digit (mathematical, full-width, circled ones)."""
    alike = {}
    for odd, plain in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, GEORGIAN, COPTIC, LISU, DESERET, LATIN):
        alike |= dict(zip(odd, plain, strict=True))
    for p in range(0x80, sys.maxunicode + 1):
        folded = "" if 0xD800 <= p <= 0xDFFF else unicodedata.normalize("NFKC", chr(p))
        if len(folded) == 1 and folded.isascii() and folded.isalnum():
            alike.setdefault(chr(p), folded)
    return "".join(alike), "".join(alike.values())


@lru_cache
def _odd() -> str:
    return fast_pattern(ranges_of(sorted(map(ord, look_alikes()[0]))))


@lru_cache
def alike() -> dict[str, str]:
    return dict(zip(*look_alikes()))


TOKEN = r"[\p{L}_][\p{L}\p{N}_]*"


def skeleton(token: Column) -> Column:
    """A token with its look-alikes as ASCII letters."""
    return F.translate(token, *look_alikes())


def analysis(token: Column) -> Column:
    """``struct<token, skeleton, characters, unicode_version>`` of a token.

    ``characters`` are the look-alikes in order, each with its code point and script.
    """
    odd = F.regexp_extract_all(token, F.lit(_odd()), F.lit(0))
    script = lambda c: F.coalesce(F.get(scripts_in(c), F.lit(0)), F.lit("Common"))
    code = lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), F.greatest(F.lit(4), F.length(F.hex(F.ascii(c)))), F.lit("0")))
    characters = F.transform(odd, lambda c: F.struct(c.alias("character"), code(c).alias("code_point"), script(c).alias("script")))
    return F.struct(token.alias("token"), skeleton(token).alias("skeleton"), characters.alias("characters"), F.lit(unicodedata.unidata_version).alias("unicode_version"))


def analyze(token: str) -> dict | None:
    """The same in Python, for kernels over tokens; None if the token is of one script or holds no look-alike."""
    known = alike()
    script = lambda c: next(iter(scripts_of(c)), "Common")
    odd = [c for c in token if c in known] if not token.isascii() else []
    if not odd or goes_together([scripts_of(c) for c in token]):
        return None
    return {
        "token": token,
        "skeleton": "".join(known.get(c, c) for c in token),
        "characters": [{"character": c, "code_point": f"U+{ord(c):04X}", "script": script(c)} for c in odd],
        "unicode_version": unicodedata.unidata_version,
    }


def _deceptive(token: Column) -> Column:
    return token.rlike(_odd()) & is_mixed(token)


def confusable_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, token, skeleton, scripts, count`` of tokens that hold a look-alike and mix scripts that do not go together."""
    odd = docs.filter(non_ascii(F.col(text_col)).rlike(_odd()))
    tokens = odd.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(TOKEN), F.lit(0))).alias("token")).filter(F.col("token").rlike(_odd()))
    known = tokens.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("count")).filter(is_mixed(F.col("token"))).withColumn("scripts", scripts_in(F.col("token")))
    return known.select(id_col, "token", skeleton(F.col("token")).alias("skeleton"), "scripts", "count")


def token_findings(text: Column, limit: int = LOCATION_LIMIT) -> Column:
    """``array<FINDING>``: one, if any token is of several scripts and holds a look-alike."""

    def one(hits: Column) -> Column:
        n, first = F.size(hits).cast("long"), F.slice(hits, 1, limit)
        places = let(span_places(text, first), paired_places)
        details = F.to_json(F.struct(F.transform(first, lambda s: analysis(s["text"])).alias("tokens"), (n > limit).alias("locations_truncated")))
        message = "tokens of several scripts hold look-alikes; their skeletons serve detection only"
        found = finding("unicode_security", "confusable_mixed_script_token", n, places, "medium", F.lit(False), "report", message, details=details)
        return F.filter(F.array(found), lambda f: f["count"] > 0)

    hits = F.filter(match_spans(text, TOKEN), lambda s: _deceptive(s["text"]))
    return F.when(non_ascii(text).rlike(_odd()), let(hits, one)).otherwise(F.array().cast(f"array<{FINDING}>"))


def normalization_findings(changes: Column) -> Column:
    """``array<FINDING>`` from :func:`normalization_changes`."""
    found = finding(
        "unicode_security", "normalization_difference", F.lit(1).cast("long"), no_places(), "informational", F.lit(False), "report",
        "normalisation would change the text", details=F.to_json(F.struct(changes["nfc"].alias("nfc_changes"), changes["nfkc"].alias("nfkc_changes"))),
    )
    return F.when(changes["nfc"] | changes["nfkc"], F.array(found)).otherwise(F.array().cast(f"array<{FINDING}>"))


def normalization_changes(text: Column) -> Column:
    """``struct<nfc, nfkc>``: whether either form would change a text."""
    return F.struct(differs(text, "NFC").alias("nfc"), differs(text, "NFKC").alias("nfkc"))


def normalization(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, nfc_changes, nfkc_changes`` of documents that either form would change."""
    text = F.col(text_col)
    rows = docs.filter(unsure(text, "NFC") | unsure(text, "NFKC"))
    return rows.select(id_col, differs(text, "NFC").alias("nfc_changes"), differs(text, "NFKC").alias("nfkc_changes")).filter("nfc_changes or nfkc_changes")
