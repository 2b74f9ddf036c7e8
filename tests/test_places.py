"""Places in texts and counts of characters, against plain Python, and on long texts."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from inkglass.functions import spans
from inkglass.operators import carriers, metrics, profiles


def plain_place(text, o):
    return (text.count("\n", 0, o) + 1, o - (text.rfind("\n", 0, o) + 1) + 1, o)


def test_places_equal_plain_ones(spark):
    r = random.Random(1)
    rows = []
    for i in range(200):
        text = "".join(r.choice("ab\n\r𝒳é") for _ in range(r.randint(0, 40)))
        rows.append((i, text, [r.randint(0, len(text)) for _ in range(r.randint(0, 8))]))
    found = spark.createDataFrame(rows, "i int, t string, o array<int>").select("*", spans.places_of(F.col("t"), F.col("o")).alias("p")).collect()
    for row in found:
        assert [tuple(p) for p in row.p] == [plain_place(row.t, o) for o in row.o]


def test_many_places_of_a_long_text(spark):
    text = ("x" * 99 + "\n") * 100_000
    start = time.time()
    spread = F.sequence(F.lit(0), F.lit(9_999_999), F.lit(100))
    row = spark.createDataFrame([(text,)], "t string").select(spans.places_of(F.col("t"), spread).alias("p")).select(F.size("p").alias("n"), F.element_at("p", -1).alias("last")).first()
    assert (row.n, tuple(row.last)) == (100_000, (100_000, 1, 9_999_900))
    assert time.time() - start < 60


def test_cutting_many_spans(spark):
    text = "abcdefghij" * 20_000
    some = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct((10 * i).alias("start"), (10 * i + 9).alias("end")))
    row = spark.createDataFrame([(text,)], "t string").select(spans.without_spans(F.col("t"), some).alias("x")).first()
    assert row.x == "j" * 20_000
    overlapping = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((2, 6), (0, 3), (4, 5), (8, 8))])
    assert spark.createDataFrame([("0123456789",)], "t string").select(spans.without_spans(F.col("t"), overlapping).alias("x")).first().x == "6789"


def test_code_points_of_many_kinds(spark):
    r = random.Random(2)
    odd = [chr(p) for p in range(0x4E00, 0x4E00 + 8000)]
    texts = ["".join(r.choice(odd) for _ in range(100_000)), "éaé\U0001f600", "plain", "", None]
    start = time.time()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", metrics.code_points(F.col("t")).alias("m")).collect()
    assert time.time() - start < 60
    for row in rows:
        text = texts[row.i]
        expected = None if text is None else {f"U+{ord(c):04X}": n for c, n in Counter(text).items() if ord(c) > 127}
        assert row.m == expected


def test_places_of_carriers_and_paragraphs(spark):
    link = '<link rel="c2pa-manifest" href="https://e.org/m">'
    text = f"first line\ncontinues\n\nsecond {link}\n{link} end\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    rows = carriers.carrier_rows(docs).orderBy("start").collect()
    assert [(r.line, r.column) for r in rows] == [(4, 8), (5, 1)]
    found = docs.select(F.explode(carriers.carrier_findings_of(F.col("text"))).alias("f")).select("f.locations").collect()
    assert [(p.line, p.column, p.end_line, p.end_column) for r in found for p in r.locations] == [(4, 8, 4, 8 + len(link)), (5, 1, 5, 1 + len(link))]
    rows = profiles.paragraphs(docs).orderBy("start").collect()
    assert [(r.line, r.column, r.end_line, r.end_column) for r in rows] == [(1, 1, 2, 10), (4, 1, 5, len(link) + 5)]
