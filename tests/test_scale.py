"""What keeps memory and time bounded: how rows reach Python, and how often an expression is evaluated."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from inkglass.functions import normalization
from inkglass.operators import metrics
from inkglass.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(frame, kind="executedPlan"):
    return getattr(frame._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("name", ["unified_diff", "replacement_spans", "markdown_unwrap", "source_findings", "source_findings_python", "source_regions", "source_clean_comments"])
def test_whole_texts_reach_python_in_small_batches(spark, name):
    told = plan(catalogue.queries()[name](spark, SF))
    assert "BatchEvalPython" in told and "ArrowEvalPython" not in told


def test_cleaning_is_evaluated_once_where_refusals_are_picked(spark):
    cleaned = catalogue.queries()["clean_default"](spark, SF)
    refused = catalogue.queries()["compose_refusals"](spark, SF)
    mark = "【】"
    assert plan(refused, "optimizedPlan").count(mark) == plan(cleaned, "optimizedPlan").count(mark) > 0


def test_words_and_lines_are_counted_without_a_list_of_matches(spark):
    docs = spark.createDataFrame([("a b\r\n1x_y, \u00e9t\u00e9\r--\n\n..",), ("",), ("x",), ("a\u2028b\x0b",), (" -",)], "text string")
    told = docs.select(F.struct(*[c.alias(n) for n, c in metrics.metrics(F.col("text")).items()]).alias("m"))
    assert "regexp_extract_all(text" not in plan(told, "executedPlan") and "regexp_extract_all(text" not in plan(told, "optimizedPlan")
    assert [(r.m.words, r.m.lines, r.m.ascii_characters, r.m.non_ascii_characters) for r in told.collect()] == [(4, 5, 19, 2), (0, 0, 0, 0), (1, 1, 1, 0), (2, 2, 3, 1), (0, 1, 2, 0)]


def test_only_stretches_in_question_are_normalised_to_compare(spark):
    docs = spark.createDataFrame([("plain",), ("abc e\u0301 x",), ("e\u0316\u0301",), ("\u00e9\u0316 q\u0301",), ("\ufb01n",), ("\u0301",)], "text string")
    told = docs.select(normalization.differs(F.col("text")).alias("c"), normalization.differs(F.col("text"), "NFKC").alias("k"), "text")
    assert "arrays_zip" not in plan(told, "optimizedPlan")
    for r in told.collect():
        assert (r.c, r.k) == tuple(unicodedata.normalize(f, r.text) != r.text for f in ("NFC", "NFKC"))
