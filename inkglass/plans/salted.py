"""The driver's documents with planted carriers, so that every detector has work.

A document's id chooses what is put after its 40th character; residue 0 gets nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.carriers import build_wrapper, encode_selectors

_MARK = "-----{} C2PA MANIFEST-----"
#: A valid provenance wrapper, and one of a version that is not known.
WRAPPER = "\ufeff" + encode_selectors(build_wrapper(b"manifest"))
BAD_WRAPPER = "\ufeff" + encode_selectors(build_wrapper(b"manifest", 2))

PAYLOADS = (
    "",
    "a​b",
    "‮abc‬ ⁦x⁩",
    "x️\U000e0101",
    "\U000e0041\U000e0042",
    "\U000f0001",
    "﷐￿",
    "��",
    "x﻿y",
    "a b　c d",
    "“q” ‘r’",
    "a — b – c ― d‐e‑f",
    "wait… and‥ so⋯",
    "【x】",
    "co­op⁠x͏",
    " pаypаl bοx ",
    "é ﬁ",
    "one\r\ntwo\r\n",
    "tail  \t\n   \nnext \n",
    "\n# -----BEGIN C2PA MANIFEST----- https://e.org/m -----END C2PA MANIFEST-----\n",
    "\n-----BEGIN C2PA MANIFEST-----\ndata:application/c2pa;base64,AAAA\n-----END C2PA MANIFEST-----\n",
    "\na wrapped\nparagraph\n\n- item wraps\n  onto this\n- next  \n```\ncode\n```\n",
    "\u0378 x\u0530",
    f"a{WRAPPER} “b”",
    f"a{BAD_WRAPPER} b",
    '\n<script type="application/c2pa">QUJD\nREVG</script>\n',
    '\n<script type="application/c2pa">not base64!</script>\n<link rel="c2pa-manifest" href="no scheme">\n',
    "\n// " + _MARK.format("BEGIN") + "\nno end\n",
    "\n# " + _MARK.format("BEGIN") + " not a uri " + _MARK.format("END") + "\n",
    "\n> quoted\n> again\n\n" + "w" * 72 + "\n" + "v" * 80 + "\n" + "1. one\n\n| a | b |\n|---|---|\nback\\\nslash\n",
    "\nLOCAL-MARK\nint x = 'k​'; // note​ here\n<link rel=\"c2pa-manifest\" href=\"https://e.org/m\">\n",    " g\u0585\u0585gle \u13aapple \u10e7ahoo w\ua4b3rd \u30ab\u30bf\u6f22\u3072 \uff21\uff22\u682a \u0430\u0431 \u03b1\u03b2_1 ",
    "a\u0301\u0323 e\u0323\u0301 q\u0307\u0323 \u212b\u2126 \u1100\u1161\u11a8 \u0958 x\u0316\u0315",
    "\n&lt;p&gt; &amp;lt; &amp;amp;amp; &eacute;&NTILDE; &#8217;&#x41;&#59; &unknown; &amp no &euro;\n<b>&amp;</b>\n&quot;\n",
)


#: All carriers of the payloads: what one is made of, its kind, and whether it is valid.
CARRIED = (
    ("# " + _MARK.format("BEGIN") + " https://e.org/m " + _MARK.format("END") + "\n", "structured_external_reference", True),
    (_MARK.format("BEGIN") + "\ndata:application/c2pa;base64,AAAA\n" + _MARK.format("END") + "\n", "structured_embedded", True),
    (WRAPPER, "variation_selector", True),
    (BAD_WRAPPER, "variation_selector", False),
    ('<script type="application/c2pa">QUJD\nREVG</script>', "html_inline", True),
    ('<script type="application/c2pa">not base64!</script>', "html_inline", False),
    ('<link rel="c2pa-manifest" href="no scheme">', "html_external_reference", False),
    ('<link rel="c2pa-manifest" href="https://e.org/m">', "html_external_reference", True),
    ("// " + _MARK.format("BEGIN") + "\n", "structured_block", False),
    ("# " + _MARK.format("BEGIN") + " not a uri " + _MARK.format("END") + "\n", "structured_block", False),
)


def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, text`` of all documents; texts are null where the input's are."""
    n = F.col("doc_id") % len(PAYLOADS)
    payload = F.element_at(F.array(*map(F.lit, PAYLOADS)), (n + 1).cast("int"))
    text = F.concat(F.substring("text", 1, 40), payload, F.substring("text", 41, 2**31 - 1))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", text.alias("text"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The same as a common table expression for DuckDB.
SALTED_SQL = (
    "salted AS (SELECT doc_id, lang, source, substr(text, 1, 40) || ["
    + ", ".join(map(_quoted, PAYLOADS))
    + f"][CAST(doc_id % {len(PAYLOADS)} AS INTEGER) + 1] || substr(text, 41) AS text FROM documents)"
)
