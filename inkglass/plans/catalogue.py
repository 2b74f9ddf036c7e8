"""Named queries of the audit engine, each over a folder of Parquet tables, with their SQL.

All but the last few run over :func:`.salted.salted`, whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import characters as ch
from ..functions.spans import settled
from ..operators import carriers, cleaning, look_alikes, markdown, metrics, profiles, reports, signals, source_code
from ..sources import text_files
from .salted import BAD_WRAPPER, CARRIED, SALTED_SQL, WRAPPER, salted

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def long_(name: str):
    return F.col(name).cast("long").alias(name)


# ---- SQL that several queries share ---------------------------------------------------

_CHARS = """chars AS (
    SELECT doc_id, i - 1 AS off, c, unicode(c) AS cp FROM (
        SELECT doc_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (
            SELECT doc_id, string_split(text, '') AS cs FROM salted)))"""
# The characters of each signal, told to SQL anew; only what no version of Unicode has assigned is
# asked of the running Python.
_IGNORED = (
    r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}"
    r"\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
)
_TOLD_SIGNALS = {
    "unicode_security": {
        "default_ignorable": f"regexp_matches(c, '{_IGNORED}')",
        "soft_hyphen": "c = chr(173)",
        "word_or_grapheme_joiner": "c IN (chr(847), chr(8288))",
        "bidi_control": r"regexp_matches(c, '[\x{61C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]')",
        "variation_selector": r"regexp_matches(c, '[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]')",
        "tag_character": r"regexp_matches(c, '[\x{E0000}-\x{E007F}]')",
        "private_use": r"regexp_matches(c, '\p{Co}')",
        "noncharacter": "cp BETWEEN 64976 AND 65007 OR cp % 65536 >= 65534",
        "unassigned": ch.condition("cp", ch.unassigned()),
        "replacement_character": "c = chr(65533)",
        "noninitial_bom": "c = chr(65279) AND off <> 0",
    },
    "typography": {
        "smart_quote": "c IN ('‘', '’', '“', '”')",
        "unicode_dash_or_hyphen": "c IN ('‐', '‑', '‒', '–', '—', '―')",
        "unicode_ellipsis": "c IN ('‥', '…', '⋯')",
    },
    "formatting": {"unusual_space_separator": r"regexp_matches(c, '\p{Zs}')"},
}
_HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{category}' AS category, '{signal}' AS signal, off FROM chars WHERE cp > 127 AND ({test})"
    for category, signals_ in _TOLD_SIGNALS.items()
    for signal, test in signals_.items()
) + ")"
_PLACES = """places AS (
    SELECT doc_id, off,
           1 + coalesce(sum(CAST(c = chr(10) AS INTEGER)) OVER w, 0) AS line,
           off - coalesce(max(CASE WHEN c = chr(10) THEN off END) OVER w, -1) AS col
    FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join([SALTED_SQL, *parts]) + "\n"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _count_sql(pattern: str) -> str:
    return f"CAST(length(text) - length(regexp_replace(text, {_quoted(pattern)}, '', 'g')) AS BIGINT)"


def _counter_sql(patterns: dict[str, str]) -> str:
    return ", ".join(f'{_count_sql(p)} AS "{n}"' for n, p in patterns.items())


# ---- findings -------------------------------------------------------------------------


@query(_with(_CHARS, _HITS) + "SELECT doc_id, category, signal, count(*) AS n FROM hits GROUP BY ALL")
def scan_signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.counted(salted(spark, sf_dir)).withColumnRenamed("count", "n")


_LOCATIONS = _with(_CHARS, _HITS, _PLACES) + """SELECT doc_id, category, signal, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS "column", CAST(off AS BIGINT) AS "offset"
FROM hits JOIN places USING (doc_id, off)"""


@query(_LOCATIONS)
def scan_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.locations(salted(spark, sf_dir)).select("doc_id", "category", "signal", long_("line"), long_("column"), long_("offset"))


@query(
    _with(_CHARS, _HITS)
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category, signal ORDER BY off) AS r, count(*) OVER (PARTITION BY doc_id, category, signal) AS n FROM hits)
SELECT doc_id, category, signal, any_value(n) AS n, count(*) AS kept, CAST(max(off) AS BIGINT) AS last_offset,
       CASE WHEN signal = 'variation_selector' THEN 'report' ELSE 'remove' END AS planned_action
FROM ranked WHERE r <= 100 GROUP BY doc_id, category, signal"""
)
def scan_locations_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.findings(salted(spark, sf_dir))
    return found.select(
        "doc_id",
        "category",
        "signal",
        F.col("count").alias("n"),
        F.size("locations").cast("long").alias("kept"),
        F.array_max(F.transform("locations", lambda x: x["offset"])).cast("long").alias("last_offset"),
        "planned_action",
    )


# The characters of each counter, told to SQL anew, too.
_TOLD_GHOSTS = {
    "NBSP_family": r"[\x{A0}\x{2002}\x{2003}\x{2009}\x{202F}\x{3000}]",
    "Zs_spaces": r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]",
    "ZWSP": r"\x{200B}",
    "ZWNJ": r"\x{200C}",
    "ZWJ": r"\x{200D}",
    "LRM": r"\x{200E}",
    "RLM": r"\x{200F}",
    "BOM": r"\x{FEFF}",
    "bidi_overrides": r"[\x{202A}-\x{202E}]",
    "bidi_isolates": r"[\x{2066}-\x{2069}]",
    "replacement_char": r"\x{FFFD}",
    "default_ignorables": _IGNORED,
    "variation_selectors": r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]",
    "tag_characters": r"[\x{E0000}-\x{E007F}]",
    "noncharacters": r"[\x{FDD0}-\x{FDEF}" + "".join(rf"\x{{{p:X}FFFE}}\x{{{p:X}FFFF}}" for p in range(1, 17)) + r"\x{FFFE}\x{FFFF}]",
    "private_use": r"\p{Co}",
}
_TOLD_MARKS = {
    "smart_quotes": "[‘’“”]",
    "smart_quotes_basic": "[‘’“”]",
    "unicode_quote_like": ch.pattern(signals.typographic_ranges()["unicode_quote_like"]),
    "ascii_quote_like": "[\"']",  # a grave accent is none, by its name
    "unicode_hyphen": "‐",
    "nonbreaking_hyphen": "‑",
    "figure_dash": "‒",
    "emdash": "—",
    "endash": "–",
    "horizontal_bar": "―",
    "ellipsis": "[‥…⋯]",
    "fullwidth_brackets": "[【】]",
}


@query(_with() + f"SELECT doc_id, {_counter_sql(_TOLD_GHOSTS)}, CAST(CASE WHEN text IS NOT NULL THEN 0 END AS BIGINT) AS surrogates, {_count_sql(ch.pattern(ch.unassigned()))} AS unassigned_cn FROM salted")
def ghost_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = salted(spark, sf_dir).select("doc_id", signals.counters(F.col("text"))["unicode_ghosts"].alias("c"))
    return rows.select("doc_id", *[F.col(f"c.{n}").cast("long").alias(n) for n in [*signals.GHOSTS, "surrogates", "unassigned_cn"]])


@query(_with() + f"SELECT doc_id, {_counter_sql(_TOLD_MARKS)} FROM salted")
def typographic_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = salted(spark, sf_dir).select("doc_id", signals.counters(F.col("text"))["typographic"].alias("c"))
    return rows.select("doc_id", *[F.col(f"c.{n}").cast("long").alias(n) for n in signals.typographic_ranges()])


_TRAILING = r"len(list_filter(regexp_split_to_array(text, '\r\n|\n|\r'), lambda l: l LIKE '% ' OR l LIKE '%' || chr(9)))"
_INDENTED = f"len(list_filter(regexp_split_to_array(text, {_quoted(signals.LINE_END)}), lambda l: regexp_full_match(l, {_quoted(signals.BLANK + '+')})))"


@query(
    _with()
    + f"""SELECT doc_id, CAST({_TRAILING} AS BIGINT) AS trailing_lines, CAST({_INDENTED} AS BIGINT) AS blank_with_indent,
       right(text, 1) IN (chr(10), chr(13)) AS final_newline FROM salted"""
)
def whitespace_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = signals.whitespace_counters(F.col("text"))
    return salted(spark, sf_dir).select(
        "doc_id", c["trailing_lines"].cast("long").alias("trailing_lines"), c["blank_with_indent"].cast("long").alias("blank_with_indent"), c["final_newline"].alias("final_newline")
    )


_TOTAL = " + ".join(
    [_count_sql(p) for n, p in _TOLD_GHOSTS.items() if n != "NBSP_family"]
    + [_count_sql(ch.pattern(ch.unassigned()))]
    + [_count_sql(p) for n, p in _TOLD_MARKS.items() if n not in ("smart_quotes_basic", "ascii_quote_like")]
    + [_TRAILING, _INDENTED, "CASE WHEN right(text, 1) IN (chr(10), chr(13)) THEN 0 ELSE 1 END"]
)


@query(_with() + f"SELECT doc_id, CAST({_TOTAL} AS BIGINT) AS total FROM salted")
def scan_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salted(spark, sf_dir).select("doc_id", signals.total(F.col("text")).cast("long").alias("total"))


_FOUND = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(letters, '\\p{{{s}}}') THEN '{s}' END" for s in ch.SCRIPTS) + "], lambda s: s IS NOT NULL)"


@query(
    _with()
    + f""", l AS (SELECT doc_id, regexp_replace(text, '[^\\pL]+', '', 'g') AS letters FROM salted),
s AS (SELECT doc_id, {_FOUND} AS found FROM l)
SELECT doc_id, len(found) AS n, array_to_string(found, ',') AS scripts FROM s WHERE len(found) > 1"""
)
def mixed_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.mixed_scripts(salted(spark, sf_dir)).select("doc_id", F.col("count").cast("long").alias("n"), F.array_join("scripts", ",").alias("scripts"))


@query(_with() + "SELECT doc_id FROM salted WHERE nfc_normalize(text) <> text")
def normalization_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alikes.normalization(salted(spark, sf_dir)).filter("nfc_changes").select("doc_id")


@query()
def normalization_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alikes.normalization(salted(spark, sf_dir))


# Look-alikes and scripts are told to SQL anew: the letters of the salted corpus, and scripts by their names.
_ALIKE = {"а": "a", "е": "e", "о": "o", "ο": "o", "р": "p", "х": "x", "с": "c", "α": "a", "օ": "o", "Ꭺ": "A", "ყ": "y", "ꓳ": "O", "Ａ": "A", "Ｂ": "B"}
_NAMED = ("Armenian", "Cherokee", "Cyrillic", "Georgian", "Greek", "Han", "Hiragana", "Katakana", "Latin", "Lisu")
_MIXED = "len(found) > 1 AND NOT list_has_all(['Han', 'Hiragana', 'Katakana', 'Latin'], found)"
_TOLD = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(token, '\\p{{{s}}}') THEN '{s}' END" for s in _NAMED) + "], lambda s: s IS NOT NULL)"


@query(
    _with()
    + f""", t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\pL_][\\pL\\pN_]*')) AS token FROM salted),
c AS (SELECT doc_id, token, count(*) AS n FROM t WHERE regexp_matches(token, '[{''.join(_ALIKE)}]') GROUP BY ALL),
s AS (SELECT *, {_TOLD} AS found FROM c)
SELECT doc_id, token, translate(token, '{''.join(_ALIKE)}', '{''.join(_ALIKE.values())}') AS skeleton, array_to_string(found, ',') AS scripts, n
FROM s WHERE {_MIXED}"""
)
def confusable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = look_alikes.confusable_tokens(salted(spark, sf_dir))
    return out.select("doc_id", "token", "skeleton", F.array_join("scripts", ",").alias("scripts"), F.col("count").alias("n"))


# ---- metrics --------------------------------------------------------------------------

_ENDS = f"len(regexp_extract_all(text, {_quoted(signals.LINE_END)}))"


@query(
    _with()
    + f"""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes_utf8, CAST(length(text) AS BIGINT) AS characters,
       CAST({_ENDS} + CASE WHEN text <> '' AND NOT regexp_matches(text, {_quoted("(?:" + signals.LINE_END + ")" + chr(92) + "z")}) THEN 1 ELSE 0 END AS BIGINT) AS lines,
       CAST(len(regexp_extract_all(text, '[\\pL\\pN_]+')) AS BIGINT) AS words,
       CAST(length(regexp_replace(text, '[^\\x00-\\x7F]+', '', 'g')) AS BIGINT) AS ascii_characters,
       CAST(length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]+', '', 'g')) AS BIGINT) AS non_ascii_characters
FROM salted"""
)
def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.document_metrics(salted(spark, sf_dir)).drop("newline_style")
    return out.select("doc_id", *[long_(c) for c in out.columns[1:]])


@query(
    _with()
    + """, k AS (SELECT doc_id, contains(text, chr(13) || chr(10)) AS crlf, contains(replace(text, chr(13) || chr(10), ''), chr(10)) AS lf,
       contains(replace(text, chr(13) || chr(10), ''), chr(13)) AS cr FROM salted)
SELECT doc_id, CASE CAST(crlf AS INT) + CAST(lf AS INT) + CAST(cr AS INT) WHEN 0 THEN 'none'
       WHEN 1 THEN CASE WHEN crlf THEN 'crlf' WHEN lf THEN 'lf' ELSE 'cr' END ELSE 'mixed' END AS newline_style FROM k"""
)
def newline_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salted(spark, sf_dir).select("doc_id", metrics.newline_style(F.col("text")).alias("newline_style"))


@query(_with(_CHARS) + "SELECT doc_id, 'U+' || CASE WHEN cp < 4096 THEN lpad(hex(cp), 4, '0') ELSE hex(cp) END AS code_point, count(*) AS n FROM chars WHERE cp > 127 GROUP BY ALL")
def codepoint_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.inventory(salted(spark, sf_dir)).withColumnRenamed("count", "n")


@query()
def codepoint_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.inventory(salted(spark, sf_dir)).groupBy("code_point").agg(F.sum("count").alias("n"))
    return metrics.described(counts)


# ---- cleaning -------------------------------------------------------------------------


# Entities are told to SQL one by one: the classic names of HTML 4, and those of the salted corpus that have none.
_ENTITIES = {"&amp;": "&", **{f"&{n};": chr(p) for n, p in name2codepoint.items() if n != "amp"}, "&NTILDE;": "Ñ", "&#8217;": "’", "&#x41;": "A"}


def _entities_sql(x: str) -> str:
    """Entities on the lines before the first one with a ``<`` or a carrier, whose begin is one of these."""
    seen = x
    for mark in ("QZONEQZ", "QZTWOQZ", "-----BEGIN C2PA"):
        seen = f"replace({seen}, '{mark}', '<')"
    head = "split_part(m, '<', 1)"
    # ampersands of ampersands first
    read = "replace(replace(h, '&amp;amp;', '&amp;'), '&amp;amp;', '&amp;')"
    for entity, char in _ENTITIES.items():
        read = f"replace({read}, {_quoted(entity)}, {_quoted(char)})"
    length = f"CASE WHEN contains(m, '<') THEN length({head}) - length(regexp_extract({head}, '[^\\n]*\\z')) ELSE length(t) END"
    return f"(SELECT {read} || substr(t, length(h) + 1) FROM (SELECT t, substr(t, 1, {length}) AS h FROM (SELECT {x} AS t, {seen} AS m)))"


def _clean_sql(o: cleaning.CleanOptions) -> str:
    return _held_sql("text", lambda x: _steps_sql(o, _entities_sql(x)), o.strip_provenance)


def _steps_sql(o: cleaning.CleanOptions, x: str) -> str:
    r = lambda x, p, to: f"regexp_replace({x}, {_quoted(p)}, {_quoted(to)}, 'g')"
    t = lambda x, a, b: f"translate({x}, {_quoted(a)}, {_quoted(b)})"
    x = r(x, r"\x1B\[[0-9;?]*[A-Za-z]", "")
    for mark, letters in cleaning.LIGATURES:
        x = f"replace({x}, '{mark}', '{letters}')"
    x = r(x, r"\r\n|\r|[\x{85}\x{2028}\x{2029}]", "\n")
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if c not in (0xFF02, 0xFF07))
    x = t(x, wide, "".join(chr(ord(c) - 0xFEE0) for c in wide))
    x = f"nfc_normalize({r(x, r"[\x00-\x08\x0B\x0E-\x1F\x7F]", "")})"
    if not o.keep_replacement:
        x = f"replace({x}, '�', '')"
    if not o.keep_quotes:
        x = t(x, *cleaning.quote_map())
        for mark, dots in cleaning.ELLIPSES:
            x = f"replace({x}, '{mark}', '{dots}')"
    if not o.keep_dashes:
        x = t(r(x, "[ \t]*[—―][ \t]*", " - "), "‐‑‒–", "----")
    if not o.keep_brackets:
        x = t(x, "【】", "[]")
    x = r(x, ch.pattern(ch.SPACE_SEPARATOR), " ")
    kept: ch.Ranges = ch.DEFAULT_IGNORABLE if o.keep_invisible or o.keep_default_ignorables else ()
    if not kept:
        x = r(x, ch.pattern(ch.DEFAULT_IGNORABLE), "")
    x = r(x, ch.pattern(cleaning._without(ch.unnamed() + ch.PRIVATE_USE, kept)), "")
    return r(r(x, "[ \t]+(\r?\n)", r"\1"), r"[ \t]+\z", "")


def _held_sql(text: str, sql: Callable[[str], str], stripped: bool) -> str:
    """Cleaning around wrappers: letters stand for them, or nothing does; other carriers hold nothing to clean."""
    if stripped:
        for literal, _, valid in CARRIED:
            if valid:
                text = f"replace({text}, {_quoted(literal)}, '')"
        return sql(text)
    letters = ((WRAPPER, "QZONEQZ"), (BAD_WRAPPER, "QZTWOQZ"))
    for wrapper, word in letters:
        text = f"replace({text}, {_quoted(wrapper)}, '{word}')"
    out = sql(text)
    for wrapper, word in letters:
        out = f"replace({out}, '{word}', {_quoted(wrapper)})"
    return out


def _add_clean(name: str, options: cleaning.CleanOptions) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return salted(spark, sf_dir).select("doc_id", cleaning.clean(F.col("text"), options).alias("cleaned"))

    run.__name__ = name
    query(_with() + f"SELECT doc_id, {_clean_sql(options)} AS cleaned FROM salted")(run)


for _name, _options in {
    "clean_default": cleaning.CleanOptions(),
    "clean_keep_quotes": cleaning.CleanOptions(keep_quotes=True),
    "clean_keep_dashes": cleaning.CleanOptions(keep_dashes=True),
    "clean_keep_invisible": cleaning.CleanOptions(keep_invisible=True),
    "clean_keep_brackets": cleaning.CleanOptions(keep_brackets=True),
    "clean_keep_replacement": cleaning.CleanOptions(keep_replacement=True),
    "clean_strip_provenance": cleaning.CleanOptions(strip_provenance=True),
}.items():
    _add_clean(_name, _options)


@query(_with() + "SELECT doc_id, CASE WHEN right(text, 1) = chr(10) THEN text ELSE text || chr(10) END AS ended FROM salted")
def handle_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salted(spark, sf_dir).select("doc_id", cleaning.final_newline(F.col("text")).alias("ended"))


@query(_with() + "SELECT doc_id, translate(text, '【】', '[]') AS folded FROM salted")
def terminal_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salted(spark, sf_dir).select("doc_id", cleaning.fold_brackets(F.col("text")).alias("folded"))


@query(_with() + "SELECT doc_id, CASE WHEN contains(text, chr(13) || chr(10)) THEN 'crlf' WHEN contains(text, chr(13)) THEN 'cr' ELSE 'lf' END AS eol FROM salted")
def detect_eol(spark: SparkSession, sf_dir: str) -> DataFrame:
    eol = text_files.eol_of(F.col("text"))
    return salted(spark, sf_dir).select("doc_id", F.when(eol == "\r\n", "crlf").when(eol == "\r", "cr").otherwise("lf").alias("eol"))


# ---- provenance -----------------------------------------------------------------------

# The carriers of the salted corpus are told to SQL one by one, so that it shares no pattern with the engine.
_LITERALS = "carried AS (SELECT * FROM (VALUES " + ", ".join(f"({_quoted(t)}, '{k}', {str(v).lower()})" for t, k, v in CARRIED) + ") t(literal, kind, valid))"
_FOUND_CARRIERS = """held AS (
    SELECT doc_id, kind, valid, start, start + length(literal) AS "end", 1 + length(ahead) - length(replace(ahead, chr(10), '')) AS line,
           length(regexp_extract(ahead, '[^\\n]*\\z')) + 1 AS "column"
    FROM (SELECT *, substr(text, 1, start) AS ahead FROM (SELECT *, strpos(text, literal) - 1 AS start FROM salted JOIN carried ON contains(text, literal))))"""
_CARRIERS = _with(_LITERALS, _FOUND_CARRIERS)


@query(_CARRIERS + "SELECT doc_id, kind, valid, count(*) AS n FROM held WHERE kind LIKE 'structured%' GROUP BY ALL")
def carriers_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carriers.carrier_rows(salted(spark, sf_dir)).filter(F.col("kind").startswith("structured"))
    return rows.groupBy("doc_id", "kind", "valid").agg(F.count(F.lit(1)).alias("n"))


@query(_CARRIERS + "SELECT doc_id, kind, valid, count(*) AS n FROM held WHERE kind LIKE 'html%' GROUP BY ALL")
def carriers_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carriers.carrier_rows(salted(spark, sf_dir)).filter(F.col("kind").startswith("html"))
    return rows.groupBy("doc_id", "kind", "valid").agg(F.count(F.lit(1)).alias("n"))


_PLACED = ', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('start', '"end"', 'line', '"column"'))


@query(_CARRIERS + f"SELECT doc_id, valid, {_PLACED} FROM held WHERE kind = 'variation_selector'")
def carriers_vs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carriers.carrier_rows(salted(spark, sf_dir)).filter("kind = 'variation_selector'")
    return rows.select("doc_id", "valid", long_("start"), long_("end"), long_("line"), long_("column"))


_STRIPPED = "text"
for _literal, _, _valid in CARRIED:
    if _valid:
        _STRIPPED = f"replace({_STRIPPED}, {_quoted(_literal)}, '')"


@query(_with() + f"SELECT doc_id, {_STRIPPED} AS stripped FROM salted")
def strip_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salted(spark, sf_dir).select("doc_id", carriers.strip_carriers(F.col("text")).alias("stripped"))


@query(
    _CARRIERS
    + """SELECT doc_id, 'provenance' AS category, 'c2pa_' || kind || CASE WHEN valid THEN '_valid' ELSE '_malformed' END AS signal, CAST(1 AS BIGINT) AS n,
       CASE WHEN valid THEN 'high' ELSE 'medium' END AS confidence, valid AS removable, CASE WHEN valid THEN 'strip_provenance' ELSE 'report' END AS planned_action,
       CAST(line AS BIGINT) AS line, CAST("column" AS BIGINT) AS "column", CAST(start AS BIGINT) AS "offset", CAST("end" AS BIGINT) AS end_offset FROM held"""
)
def c2pa_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: F.col("locations")[0][n].cast("long").alias(n)
    rows = carriers.carrier_findings(salted(spark, sf_dir))
    return rows.select("doc_id", "category", "signal", F.col("count").alias("n"), "confidence", "removable", "planned_action", at("line"), at("column"), at("offset"), at("end_offset"))


# ---- Markdown and source code ---------------------------------------------------------


_is = lambda line, *patterns: "(" + " OR ".join(f"regexp_matches({line}, {_quoted(p.replace('++', '+'))})" for p in patterns) + ")"
_LINES = f"""parted AS (
    SELECT doc_id, regexp_split_to_array(regexp_replace(text, {_quoted("(?:" + signals.LINE_END + ")" + chr(92) + "z")}, ''), {_quoted(signals.LINE_END)}) AS ls FROM salted WHERE text <> ''),
md AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM parted),
kinds AS (
    SELECT *, {_is('line', markdown.FENCE)} AS fence, {_is('line', r'^\s*$', r'^(?: {4}|\t)', *markdown.PROTECTED)} AS alone, {_is('line', markdown.LIST)} AS item,
           {_is('line', markdown.QUOTE)} AS quote, {_is('line', r'(?:[\\]|  )$')} AS hard, length(regexp_replace(line, '\\s+$', '')) AS width FROM md),
facts AS (
    SELECT *, coalesce(sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside,
           lead(alone OR item OR quote OR fence) OVER (PARTITION BY doc_id ORDER BY n) AS stops FROM kinds),
judged AS (SELECT *, NOT fence AND NOT inside AND stops IS NOT NULL AS plain FROM facts)"""


@query(
    _with(_LINES)
    + """, sums AS (
    SELECT doc_id, count(*) AS lines, sum(CAST(plain AND NOT hard AND NOT alone AND NOT stops AS INT)) AS soft,
           sum(CAST(plain AND NOT hard AND NOT alone AND NOT stops AND (item OR quote) AS INT)) AS continued, sum(CAST(plain AND hard AS INT)) AS hard FROM judged GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN CAST(coalesce(lines, 0) AS BIGINT) END AS lines, CASE WHEN text IS NOT NULL THEN CAST(coalesce(soft, 0) AS BIGINT) END AS soft_break_candidates,
       CASE WHEN text IS NOT NULL THEN CAST(coalesce(continued, 0) AS BIGINT) END AS list_continuations, CASE WHEN text IS NOT NULL THEN CAST(coalesce(hard, 0) AS BIGINT) END AS hard_breaks
FROM salted d LEFT JOIN sums s ON d.doc_id = s.doc_id"""
)
def markdown_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.audit(salted(spark, sf_dir))


@query(_with(_LINES) + "SELECT doc_id, CAST(width AS BIGINT) AS width, count(*) AS n FROM judged WHERE width IN (72, 78, 79, 80) AND ((plain AND NOT hard) OR stops IS NULL) GROUP BY ALL")
def markdown_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.widths(salted(spark, sf_dir)).select("doc_id", long_("width"), F.col("count").alias("n"))


@query()
def markdown_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salted(spark, sf_dir).select("doc_id", markdown.unwrap("text").alias("unwrapped"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("file"), F.when(F.col("doc_id") % 2 == 0, ".c").otherwise(".txt"))
    return salted(spark, sf_dir).withColumn("language", source_code.language_of(path))


@query()
def source_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_code.regions(source_code.scan(_sources(spark, sf_dir)))


@query()
def source_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_code.findings(_sources(spark, sf_dir))


@query(
    _with(_LITERALS)
    + f""", p AS (SELECT doc_id, replace(replace(text, chr(39), ''), chr(92), '') AS text FROM salted WHERE text IS NOT NULL),
u AS (SELECT doc_id, replace(text, {_quoted(WRAPPER)}, '') AS bare FROM p),
h AS (SELECT doc_id, length(bare) - length(regexp_replace(bare, '{_IGNORED}', '', 'g')) AS n FROM u)
SELECT doc_id, 'strings' AS context, 'hidden_unicode' AS signal, CAST(n AS BIGINT) AS n FROM h WHERE n > 0
UNION ALL SELECT doc_id, 'comments', 'hidden_unicode', 1 FROM p
UNION ALL SELECT doc_id, 'strings', 'c2pa_text_carrier', count(*) FROM p JOIN carried ON valid AND contains(text, literal) GROUP BY doc_id"""
)
def source_findings_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as Python sources: each in a string, with a comment after it that hides a character."""
    body = F.replace(F.replace("text", F.lit("'"), F.lit("")), F.lit("\\"), F.lit(""))
    text = F.concat(F.lit("text = '''"), body, F.lit("'''\nname = 1  # note\u200b\n"))
    rows = salted(spark, sf_dir).withColumn("text", text).withColumn("language", source_code.language_of(F.lit("file.py")))
    return source_code.findings(rows).groupBy("doc_id", "context", "signal").agg(F.count(F.lit(1)).alias("n"))


@query()
def source_clean_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_code.clean_comments(_sources(spark, sf_dir)).select("doc_id", "cleaned")


# ---- detectors ------------------------------------------------------------------------

_PROFILES = [
    {"profile": "local", "scheme": "literal_fixture", "marker": "LOCAL-MARK", "minimum_tokens": 3},
    {"profile": "other", "scheme": "unknown", "api_key": "x"},
    {"profile": "green", "scheme": "kgw"},
]
_ENOUGH = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query(
    _with()
    + f"""SELECT doc_id, 'local' AS profile, CASE WHEN {_ENOUGH} < 3 THEN 'insufficient_text' WHEN contains(text, 'LOCAL-MARK') THEN 'detected' ELSE 'not_detected' END AS status,
       CASE WHEN {_ENOUGH} < 3 THEN NULL WHEN contains(text, 'LOCAL-MARK') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM salted
UNION ALL SELECT doc_id, 'other', 'unsupported', NULL FROM salted UNION ALL SELECT doc_id, 'green', 'configuration_error', NULL FROM salted"""
)
def watermark_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.detect(salted(spark, sf_dir), _PROFILES).select("doc_id", "profile", "status", "score")


@query(_with() + "SELECT doc_id, CASE WHEN length(text) < 50 THEN 'insufficient_text' WHEN contains(text, 'MARK') THEN 'detected' ELSE 'not_detected' END AS status, CAST((length(text) - length(replace(text, 'MARK', ''))) // 4 AS BIGINT) AS hits FROM salted")
def harness_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.fixture_contains(salted(spark, sf_dir), "MARK", 50).select("doc_id", "status", long_("hits"))


@query(
    """SELECT source, lang, count(*) AS n, left(sha256('{"api_key":"<configured-secret>","marker":"' || coalesce(lang, '') || '","profile":"' || coalesce(source, '') || '","scheme":"literal_fixture"}'), 16) AS fingerprint
FROM documents GROUP BY source, lang"""
)
def profile_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each source and language, whose key does not show in its fingerprint."""
    groups = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.max(F.md5("text")).alias("key"))
    fields = {"profile": F.col("source"), "scheme": F.lit("literal_fixture"), "marker": F.col("lang"), "api_key": F.col("key")}
    config = F.create_map(*[x for n, c in fields.items() for x in (F.lit(n), c)])
    return profiles.fingerprints(groups.withColumn("config", config)).select("source", "lang", "n", "fingerprint")


@query(
    _with()
    + """, parted AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM salted),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM parted),
k AS (
    SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
           n - row_number() OVER (PARTITION BY doc_id, regexp_matches(line, '[^ \\t]') ORDER BY n) AS island FROM l)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(start + length(line)) AS BIGINT) AS "end", CAST(min(n) AS BIGINT) AS line, CAST(1 AS BIGINT) AS "column",
       CAST(max(n) AS BIGINT) AS end_line, CAST(arg_max(length(line), n) + 1 AS BIGINT) AS end_column, string_agg(line, chr(10) ORDER BY n) AS text
FROM k WHERE regexp_matches(line, '[^ \\t]') GROUP BY doc_id, island"""
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles.paragraphs(salted(spark, sf_dir))
    return rows.select("doc_id", *[long_(c) for c in ("start", "end", "line", "column", "end_line", "end_column")], "text")


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(-0.2::DOUBLE * CAST(l_quantity AS DOUBLE) + 5))), 9) AS probability, CAST(l_quantity AS DOUBLE) <= 10 AS flagged FROM lineitem")
def logistic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("l_quantity").cast("double")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", F.round(profiles.calibrated(score, -0.2, 5.0), 9).alias("probability"), profiles.crosses(score, 10.0, "lte").alias("flagged"))


_AUTHOR = {"method": profiles.METHOD, "metric": "mean_nll", "threshold": 2.5, "comparison": "lte", "minimum_tokens": 3, "calibration_slope": -2.0, "calibration_intercept": 5.0}


@query(
    """WITH s AS (SELECT event_id % 200 AS doc_id, event_id % 1000 AS seg, count(*) AS token_count, avg(value) AS mean_nll FROM events GROUP BY ALL)
SELECT doc_id, CASE WHEN sum(CAST(token_count >= 3 AS INT)) = 0 THEN 'insufficient_text' WHEN sum(CAST(token_count >= 3 AND mean_nll <= 2.5 AS INT)) > 0 THEN 'potentially_ai_generated' ELSE 'not_flagged' END AS status,
CAST(sum(CAST(token_count >= 3 AND mean_nll <= 2.5 AS INT)) AS BIGINT) AS flagged, CAST(sum(CAST(token_count >= 3 AS INT)) AS BIGINT) AS segments,
round(max(1 / (1 + exp(2 * mean_nll - 5))) FILTER (WHERE token_count >= 3), 9) AS probability FROM s GROUP BY doc_id"""
)
def authorship_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table stands for tokens with negative log-likelihoods."""
    tokens = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 200).alias("doc_id"), (F.col("event_id") % 1000).alias("seg"), (-F.col("value")).alias("logprob"), F.lit(1).alias("rank"))
    return profiles.authorship(profiles.likelihoods(tokens, ["doc_id", "seg"]), _AUTHOR).withColumn("probability", F.round("probability", 9))


# ---- reports --------------------------------------------------------------------------


@query(_with(_CHARS, _HITS) + "SELECT doc_id, count(*) AS total, count(*) >= 3 AS failed FROM hits WHERE category IN ('unicode_security', 'formatting') GROUP BY doc_id")
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = salted(spark, sf_dir).select("doc_id", signals.signal_counts(F.col("text")).alias("findings"))
    return reports.gate_rows(found, 3, ("unicode_security", "formatting"))


@query(
    _with(_CHARS, _HITS)
    + "SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in ch.CATEGORIES) + " FROM hits GROUP BY doc_id"
)
def category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = salted(spark, sf_dir).select("doc_id", signals.signal_counts(F.col("text")).alias("f")).filter(F.size("f") > 0)
    return found.select("doc_id", *[c.alias(n) for n, c in reports.category_columns(F.col("f")).items()])


_WORDS = "CAST(len(regexp_extract_all({0}, '[\\pL\\pN_]+')) AS BIGINT)"
_LINE_COUNT = "(" + _ENDS + f" + CASE WHEN text <> '' AND NOT regexp_matches(text, {_quoted('(?:' + signals.LINE_END + ')' + chr(92) + 'z')}) THEN 1 ELSE 0 END)"
_STAGES = ("before", "after")
_PLAN = f""", p AS (SELECT doc_id, text AS before, {_clean_sql(cleaning.CleanOptions())} AS after FROM salted),
q AS (SELECT *, {', '.join(f"{_LINE_COUNT.replace('text', x)} AS {x}_lines, {_WORDS.format(x)} AS {x}_words" for x in _STAGES)} FROM p)
"""


@query(
    _with()
    + _PLAN
    + f"""SELECT doc_id, before <> after AS changed, {', '.join(f'CAST(length({x}) AS BIGINT) AS {x}_characters, CAST({x}_lines AS BIGINT) AS {x}_lines, {x}_words' for x in _STAGES)},
       CAST(greatest(0, length(before) - length(after)) AS BIGINT) AS removed_characters, CAST(greatest(0, length(after) - length(before)) AS BIGINT) AS added_characters,
       CAST(greatest(0, before_lines - after_lines) AS BIGINT) AS joined_lines FROM q"""
)
def planned_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.planned(salted(spark, sf_dir), cleaning.clean(F.col("text")))
    return out.select("doc_id", "changed", *[long_(c) for c in out.columns if c not in ("doc_id", "changed")])


_AFTER = f"later AS (SELECT doc_id, {_clean_sql(cleaning.CleanOptions())} AS text FROM salted)"
_LATER = [_CHARS.replace("chars AS", "chars_later AS").replace("FROM salted", "FROM later"), _HITS.replace("hits AS", "hits_later AS").replace("FROM chars", "FROM chars_later")]


@query(
    _with(_CHARS, _HITS, _AFTER, *_LATER)
    + """, b AS (SELECT doc_id, list(DISTINCT signal) AS s FROM hits GROUP BY doc_id), a AS (SELECT doc_id, list(DISTINCT signal) AS s FROM hits_later GROUP BY doc_id)
SELECT b.doc_id, array_to_string(list_sort(list_filter(b.s, lambda x: NOT list_contains(coalesce(a.s, []), x))), ',') AS resolved,
       array_to_string(list_sort(list_filter(b.s, lambda x: list_contains(coalesce(a.s, []), x))), ',') AS unchanged
FROM b LEFT JOIN a ON a.doc_id = b.doc_id"""
)
def signal_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = salted(spark, sf_dir).withColumn("cleaned", cleaning.clean(F.col("text")))
    names = lambda c: F.transform(c, lambda s: s["signal"])
    rows = rows.select("doc_id", names(signals.signal_counts(F.col("text"))).alias("b"), F.coalesce(names(signals.signal_counts(F.col("cleaned"))), F.array().cast("array<string>")).alias("a"))
    told = lambda c, n: F.array_join(F.array_sort(c), ",").alias(n)
    return rows.filter(F.size("b") > 0).select("doc_id", told(F.array_except("b", "a"), "resolved"), told(F.array_intersect("b", "a"), "unchanged"))


_COUNTS_SQL = f"""n AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in ('unicode_security', 'typography', 'formatting'))} FROM hits GROUP BY doc_id),
letters AS (SELECT doc_id, regexp_replace(text, '[^\\pL]+', '', 'g') AS letters FROM salted),
mixed AS (SELECT doc_id, CASE WHEN len(found) > 1 THEN len(found) ELSE 0 END AS scripts FROM (SELECT doc_id, {_FOUND} AS found FROM letters)),
tokens AS (SELECT doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\pL_][\\pL\\pN_]*')) AS token FROM salted) WHERE regexp_matches(token, '[{''.join(_ALIKE)}]')),
odd AS (SELECT doc_id, count(*) AS tokens FROM (SELECT doc_id, {_TOLD} AS found FROM tokens) WHERE {_MIXED} GROUP BY doc_id),
borne AS (SELECT doc_id, count(*) AS provenance FROM held GROUP BY doc_id)"""


@query(
    _with(_CHARS, _HITS, _LITERALS, _FOUND_CARRIERS, _COUNTS_SQL)
    + _PLAN
    + f""", f AS (
    SELECT d.doc_id, CAST({_TOTAL} AS BIGINT) AS total, CASE WHEN text IS NOT NULL THEN CAST(coalesce(provenance, 0) AS BIGINT) END AS provenance,
           CASE WHEN text IS NOT NULL THEN CAST(coalesce(n.unicode_security, 0) + coalesce(scripts, 0) + coalesce(tokens, 0) AS BIGINT) END AS unicode_security,
           CASE WHEN text IS NOT NULL THEN CAST({_ENOUGH} >= 3 AND contains(text, 'LOCAL-MARK') AS BIGINT) END AS known_watermark,
           CASE WHEN text IS NOT NULL THEN CAST(coalesce(n.typography, 0) AS BIGINT) END AS typography, CASE WHEN text IS NOT NULL THEN CAST(coalesce(n.formatting, 0) AS BIGINT) END AS formatting,
           CAST(length(text) AS BIGINT) AS characters
    FROM salted d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN mixed ON mixed.doc_id = d.doc_id LEFT JOIN odd ON odd.doc_id = d.doc_id LEFT JOIN borne ON borne.doc_id = d.doc_id)
SELECT f.*, before_words AS words, before <> after || CASE WHEN right(after, 1) = chr(10) THEN '' ELSE chr(10) END AS changed, typography + formatting >= 2 AS failed FROM f JOIN q ON q.doc_id = f.doc_id"""
)
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports with a dry run, told by their counts; normalisation is left out, as SQL knows no NFKC."""
    options = reports.Options(metrics=True, dry_run=True, watermark_profiles=tuple(_PROFILES), threshold=2, categories=("typography", "formatting"))
    rows = reports.report(salted(spark, sf_dir), options)
    counts = reports.category_columns(F.filter("findings", lambda f: f["signal"] != "normalization_difference"))
    picked = [c.alias(n) for n, c in counts.items() if n != "authorship_signal"]
    return rows.select("doc_id", long_("total"), *picked, F.col("metrics.characters").cast("long").alias("characters"), F.col("metrics.words").cast("long").alias("words"), F.col("planned.changed").alias("changed"), "failed")


@query(_CARRIERS + "SELECT DISTINCT doc_id FROM held WHERE valid")
def compose_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not reformatted, as they bear valid provenance."""
    return reports.compose(salted(spark, sf_dir), reports.Options(unwrap_markdown=True)).filter("error is not null").select("doc_id")


@query()
def replacement_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = salted(spark, sf_dir).withColumn("cleaned", cleaning.clean(F.col("text")))
    return docs.select("doc_id", reports.replacement_spans(F.col("text"), settled("cleaned")).alias("spans"))


@query()
def unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = salted(spark, sf_dir).withColumn("cleaned", cleaning.clean(F.col("text")))
    return docs.select("doc_id", reports.unified_diff(F.col("text"), settled("cleaned"), F.col("doc_id").cast("string")).alias("diff"))


@query("SELECT DISTINCT source AS path FROM documents")
def dedupe_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("path")).transform(text_files.once)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
