"""Normal forms against the character database, and entities against a plain reading of the rules."""

import html
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkglass.functions import entities, normalization
from inkglass.operators import cleaning, look_alikes


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def odd_texts(n):
    """Random texts of marks, precomposed letters, jamo and whatever decomposes."""
    r = random.Random(5)
    marks = [chr(p) for p in range(0x300, 0x370)] + list("़̖̣ͅাා්ᅡᆨᆧ")
    letters = list("aeoéṩωᾳ가각ᄀᄒक़कেෙ豈x ﬁ①Ａ㎒")
    split = [chr(p) for p in range(0x80, 0x30000) if not 0xD800 <= p <= 0xDFFF and (unicodedata.decomposition(chr(p)) or unicodedata.combining(chr(p)))]
    return ["".join(r.choice(r.choice([marks, letters, split])) for _ in range(r.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("form", ["NFC", "NFKC"])
def test_forms_equal_the_database(spark, form):
    texts = [*odd_texts(800), "", "plain", "a\nb́"]
    done = values(spark, texts, lambda c: normalization.normalized(c, form))
    assert done == [unicodedata.normalize(form, t) for t in texts]
    assert values(spark, texts, lambda c: normalization.differs(c, form)) == [unicodedata.normalize(form, t) != t for t in texts]


def test_forms_of_nulls_and_of_long_runs_of_marks(spark):
    marks = "e" + "̣́" * 5_000
    start = time.time()
    assert values(spark, [None, marks], normalization.normalized) == [None, unicodedata.normalize("NFC", marks)]
    assert time.time() - start < 60
    assert values(spark, [None], normalization.differs) in ([None], [False])


def test_composition_is_no_python(spark):
    plan = look_alikes.normalization(spark.createDataFrame([(1, "é")], "doc_id long, text string"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in plan.collect()] == [(1, True, True)]


def plain_entities(text):
    """Line by line, off from the first line with a < on; each round over the whole, until nothing changes."""

    def of(m):
        whole = m.group(0)
        if whole in entities.names():
            return entities.names()[whole]
        if whole.startswith("&#") and ";" not in (out := html.unescape(whole)):
            return out
        return whole

    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        if "<" in line:
            return "\n".join([*out, *lines[i:]])
        while (new := re.sub(entities.ENTITY, of, line)) != line:
            line = new
        out.append(line)
    return "\n".join(out)


def test_entities_equal_the_plain_reading(spark):
    r = random.Random(2)
    pieces = ["&amp;", "lt;", "&lt;", "&eacute;", "&NTILDE;", "&ETH;", "&#", "x41;", "65;", "&#0;", "&#128;", "&#xD800;", "&#x110000;", "&#99999999999;", "&#59;", "&#xFFFF;", "&#12ab;"]
    pieces += ["&#x1F600;", "&nosuch;", "&amp", "&", ";", "amp;", "\n", "<", " a ", "&#38;", "&am&#112;;lt;", "&CounterClockwiseContourIntegral;", "&nbsp;", "&AMP;", "&fjlig;"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 14))) for _ in range(400)]
    assert values(spark, [*texts, "", None], entities.unescaped) == [*map(plain_entities, texts), "", None]


def test_many_entities(spark):
    start = time.time()
    chain, many = "&" + "amp;" * 10_000 + "lt;", "&eacute;x\n" * 5_000
    assert values(spark, [chain, many], entities.unescaped) == ["<", "éx\n" * 5_000]
    assert time.time() - start < 60


@pytest.mark.parametrize(
    ("text", "cleaned"),
    [
        ("café Å", "café Å"),
        ("ạ́", "ạ́"),
        ("&amp;lt;b&gt;", "<b>"),
        ("&rsquo;x&nbsp;y&shy;", "'x y"),
        ("fish &amp chips", "fish &amp chips"),
        ("&lt;\n`code &amp; <b>`\n&amp;", "<\n`code &amp; <b>`\n&amp;"),
        ("&copy; &#x1F600;", "© 😀"),
    ],
)
def test_cleaning_composes_and_reads_entities(spark, text, cleaned):
    assert values(spark, [text], cleaning.clean) == [cleaned]


def test_cleaning_reads_no_entities_from_a_carrier_on(spark):
    link = '<link rel="c2pa-manifest" href="https://e.org/m">'
    block = "# -----BEGIN C2PA MANIFEST----- https://e.org/m -----END C2PA MANIFEST-----\n"
    texts = [f"&lt;\n&gt; {link} &lt;\n&amp;", f"&lt;\n{block}&amp;", "&gt;"]
    assert values(spark, texts, cleaning.clean) == [f"<\n&gt; {link} &lt;\n&amp;", f"<\n{block}&amp;", ">"]
