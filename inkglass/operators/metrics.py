"""Document metrics and the inventory of code points."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.characters import SCRIPTS, non_ascii
from ..functions.spans import let, scan
from .signals import LINE_END


def newline_style(text: Column) -> Column:
    """none, lf, crlf, cr or mixed."""
    rest = F.replace(text, F.lit("\r\n"), F.lit(""))
    crlf, lf, cr = F.contains(text, F.lit("\r\n")), F.contains(rest, F.lit("\n")), F.contains(rest, F.lit("\r"))
    kinds = crlf.cast("int") + lf.cast("int") + cr.cast("int")
    return F.when(kinds == 0, "none").when(kinds > 1, "mixed").when(crlf, "crlf").when(lf, "lf").otherwise("cr")


def _count_words(text: Column) -> Column:
    """Words, each written as one letter and counted by what is lost without it: matches that are listed cost far more."""
    short = F.regexp_replace(text, r"[^\p{L}\p{N}_]*+[\p{L}\p{N}_]++", "x")
    return let(short, lambda s: F.length(s) - F.length(F.replace(s, F.lit("x"), F.lit(""))))


def _count_ends(text: Column) -> Column:
    """Line ends, sought in a text whose lines are one letter each."""
    return F.regexp_count(F.regexp_replace(text, r"[^\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]++", "x"), F.lit(LINE_END))


def metrics(text: Column) -> dict[str, Column]:
    odd = F.length(non_ascii(text))
    open_line = F.when((F.length(text) > 0) & ~F.right(text, F.lit(1)).rlike(LINE_END), 1).otherwise(0)
    return {
        "bytes_utf8": F.octet_length(text),
        "characters": F.length(text),
        "lines": _count_ends(text) + open_line,
        "words": _count_words(text),
        "ascii_characters": F.length(text) - odd,
        "non_ascii_characters": odd,
        "newline_style": newline_style(text),
    }


def code_points(text: Column) -> Column:
    """``map<string, int>``: how often each character beyond ASCII occurs, by U+XXXX; the keys come sorted as strings."""

    code = lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), F.greatest(F.lit(4), F.length(F.hex(F.ascii(c)))), F.lit("0")))
    run = "struct<c:string,n:int>"

    def step(state: Column, c: Column) -> tuple[Column, Column]:
        """Equal characters stand together; a run is told when the next one begins."""
        same = c == state["c"]
        next_ = F.struct(c.alias("c"), F.when(same, state["n"] + 1).otherwise(1).alias("n"))
        return next_, F.when(same | (state["n"] == 0), F.expr(f"cast(array() as array<{run}>)")).otherwise(F.array(state))

    def counts(odd: Column) -> Column:
        # an item that no text holds ends the last run
        chars = F.concat(F.array_sort(F.filter(F.split(odd, ""), lambda c: c != "")), F.array(F.lit("")))
        runs = scan(chars, F.struct(F.lit("").alias("c"), F.lit(0).alias("n")), run, step)
        return F.map_from_entries(F.array_sort(F.transform(runs, lambda r: F.struct(code(r["c"]).alias("key"), r["n"].alias("value")))))

    odd = non_ascii(text)
    return F.when(odd != "", let(odd, counts)).otherwise(F.when(text.isNotNull(), F.create_map().cast("map<string,int>")))


def metrics_of(text: Column) -> Column:
    """``struct`` of :func:`metrics` and :func:`code_points`."""
    return F.struct(*[c.alias(n) for n, c in metrics(text).items()], code_points(text).alias("non_ascii_codepoints"))


HELP = """\
bytes, characters, lines, words     how large the document is
newline_style                       lf, crlf, cr, mixed or none
ascii, non_ascii characters         how many of either
non_ascii_codepoints                how often each character beyond ASCII occurs
markdown                            soft breaks, list continuations, hard breaks, editors' widths
source                              suspicious characters by context
planned                             what cleaning would change
All of these are facts of the text, and none tells who wrote it."""


def document_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, *[c.alias(n) for n, c in metrics(F.col(text_col)).items()])


def inventory(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, code_point, count`` of all characters beyond ASCII, as U+XXXX."""
    chars = docs.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(r"[^\x00-\x7F]"), F.lit(0))).alias("_c"))
    counts = chars.groupBy(id_col, "_c").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(id_col, F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("_c")), F.greatest(F.lit(4), F.length(F.hex(F.ascii("_c")))), F.lit("0"))).alias("code_point"), "count")


def described(counts: DataFrame) -> DataFrame:
    """An inventory with ``name, category, script`` of each code point; scripts as in ``SCRIPTS``, else Common or Other.

    The description reads the runtime's Unicode data, one batch of rows at a time.
    """

    @F.pandas_udf("name string, category string, script string")
    def describe(points: pd.Series) -> pd.DataFrame:
        def one(u: str) -> tuple[str, str, str]:
            c = chr(int(u[2:], 16))
            name, category = unicodedata.name(c, ""), unicodedata.category(c)
            script = next((s for s in SCRIPTS if name.startswith("CJK" if s == "Han" else s.upper())), None)
            return name, category, script or ("Common" if category[0] in "PZSN" else "Other")

        return pd.DataFrame([one(u) for u in points], columns=["name", "category", "script"], dtype=object)

    return counts.withColumn("_d", describe("code_point")).select(*counts.columns, "_d.*")
