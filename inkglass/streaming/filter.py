"""Cleaning as a stream: a stateless map, the counterpart of a command-line filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import CleanOptions, clean


def clean_stream(lines: DataFrame, text_col: str = "value", options: CleanOptions = CleanOptions()) -> DataFrame:
    """A stream, or a table, with ``text_col`` cleaned; no state, so any output mode works."""
    return lines.withColumn(text_col, clean(F.col(text_col), options))
