"""Edits against the standard library's matcher, on whole texts."""

import difflib
import random
import time

from pyspark.sql import functions as F

from inkglass.functions import edits
from inkglass.operators import cleaning, reports


def changed(r, text, times):
    """A text with some characters put in, taken out, or changed."""
    out = list(text)
    for _ in range(times):
        at = r.randint(0, len(out)) if out else 0
        out[at : at + r.choice([0, 0, 1, 3])] = r.choice(["", "—", " - ", "x", "…", "ab", "“"])
    return "".join(out)


def pairs(n):
    r = random.Random(1)
    words = ["the", "quick", "brown", "fox", "zebra", "jazz", "über", "日本", "語", "\n", "—"]
    for _ in range(n):
        kind = r.random()
        if kind < 0.5:
            a = "".join(r.choice("ab—x") for _ in range(r.randint(0, 14)))
            yield a, "".join(r.choice("ab—x") for _ in range(r.randint(0, 14)))
        elif kind < 0.9:
            a = " ".join(r.choice(words) for _ in range(r.randint(0, 25)))
            yield a, changed(r, a, r.randint(0, 6))
        else:
            a = " ".join(r.choice(words) for _ in range(r.randint(60, 120)))
            yield a, changed(r, a, r.randint(0, 12))


def test_blocks_and_edits_equal_the_library():
    for a, b in pairs(10_000):
        library = difflib.SequenceMatcher(None, a, b)
        blocks = edits.Matcher(a, b).blocks()
        assert blocks == [tuple(x) for x in library.get_matching_blocks()], (a, b)
        assert list(edits.edits(blocks)) == library.get_opcodes(), (a, b)


def test_unified_diffs_equal_the_library():
    r = random.Random(7)
    for _ in range(1500):
        a = [r.choice("abcde") + "\n" for _ in range(r.randint(0, 40))]
        b = changed(r, "".join(a), r.randint(0, 5)).splitlines(True) if r.random() < 0.5 else [x for x in a if r.random() < 0.8]
        assert edits.unified(a, b, "x", "y") == "".join(difflib.unified_diff(a, b, "x", "y"))


def test_long_texts():
    r = random.Random(3)
    start = time.time()
    plain = "".join(r.choice("etaoin shrdlu“”qxzj") for _ in range(1_000_000))
    ideographs = "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(300_000))
    # all letters of the first are too frequent to begin a stretch, so all that follows the common start is one replacement
    for text, n in ((plain, 1), (ideographs, 2)):
        other = text[:1000] + "—" + text[1001:150_000] + "zz" + text[150_010:]
        assert edits.replacements(text, other) == n
    assert time.time() - start < 60


def test_spans_of_a_report(spark):
    r = random.Random(11)
    texts = ["“hi” — said… Bob’s", "", "same", *("".join(r.choice(["word ", "“x” ", "a—b ", "wait… ", "it’s "]) for _ in range(60)) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("cleaned", cleaning.clean(F.col("text")))
    for row in docs.select("*", reports.replacement_spans(F.col("text"), F.col("cleaned")).alias("n"), reports.unified_diff("text", "cleaned", F.lit("d")).alias("d")).collect():
        codes = difflib.SequenceMatcher(None, row.text, row.cleaned).get_opcodes()
        assert row.n == sum(tag == "replace" for tag, *_ in codes)
        assert row.d == "".join(difflib.unified_diff(row.text.splitlines(True), row.cleaned.splitlines(True), "d", "d (cleaned)"))
