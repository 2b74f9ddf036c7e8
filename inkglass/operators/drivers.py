"""Whole runs over files: one scan that reads, judges, writes and counts.

What cannot be read or may not be rewritten comes out of the same pass as what can, told apart
by its ``outcome``; counts are observed while the rows are written, so nothing is read twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import text_files
from . import metrics, reports
from .reports import Options

#: What may become of a file.
REJECTED, REFUSED, REPORTED, WRITTEN, UNCHANGED = "rejected", "refused", "reported", "written", "unchanged"


@dataclass(frozen=True)
class Outcome:
    """How many files there were, of these how many were no UTF-8, were not to be rewritten, were
    told of or written, and had findings over the threshold."""

    files: int
    rejected: int
    refused: int
    done: int
    over: int

    def status(self, exit_zero: bool = False) -> int:
        """1 if a file made trouble, or, unless ``exit_zero``, is over the threshold; else 0."""
        return int(self.rejected > 0 or self.refused > 0 or (self.over > 0 and not exit_zero))


def _written(rows: DataFrame, out: str) -> Outcome:
    """Write rows as JSON, a folder for each ``outcome``, and count them on the way."""
    seen = Observation()
    is_ = lambda *names: F.coalesce(F.count_if(F.col("outcome").isin(*names)), F.lit(0))
    counts = {
        "files": F.count(F.lit(1)),
        "rejected": is_(REJECTED),
        "refused": is_(REFUSED),
        "done": is_(REPORTED, WRITTEN, UNCHANGED),
        "over": F.count_if(F.coalesce(F.col("over"), F.lit(False))),
    }
    rows.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.partitionBy("outcome").json(out)
    # a run without any partition observes nothing
    return Outcome(**{n: int(seen.get.get(n) or 0) for n in counts})


def _over(findings: Column, options: Options) -> Column:
    if options.threshold is None:
        return F.lit(False)
    counted = F.filter(findings, lambda f: f["category"].isin(*options.categories))
    return F.aggregate(counted, F.lit(0).cast("long"), lambda n, f: n + f["count"]) >= options.threshold


def report_files(spark: SparkSession, paths: list[str], out: str, options: Options = Options()) -> Outcome:
    """Report on files, a JSON row each, below ``out`` in a folder for each outcome.

    ``outcome=reported`` has rows of :func:`..operators.reports.report`, with the ``path``;
    ``outcome=rejected`` has the paths of files that are not UTF-8, ``outcome=refused`` those that a dry run
    would not rewrite, with their report. Spark's reader passes empty files over, so they have no row.
    """
    files = text_files.read_all(spark, *paths)
    told = reports.report(files, options, "path", "text", "path")
    error = F.col("error") if "error" in told.columns else F.lit(None).cast("string")
    outcome = F.when(F.col("findings").isNull(), REJECTED).when(error.isNotNull(), REFUSED).otherwise(REPORTED)
    return _written(told.withColumn("outcome", outcome).withColumn("over", _over(F.col("findings"), options)), out)


def clean_files(spark: SparkSession, paths: list[str], report: str, options: Options = Options(), folder: str | None = None, backup: bool = False) -> Outcome:
    """Clean files into a folder, or in their place without one, and tell of it below ``report``.

    A row each: ``path, written, backup``, what kept it from being written (``error``), and,
    with the option ``metrics`` or a threshold, the ``findings`` and ``metrics`` of the text that was read, as JSON.
    Files that are not UTF-8, and Markdown that bears valid provenance and was to be joined,
    are left alone, and so are empty ones, which Spark's reader passes over. Line ends come back as they were. In place, a file that is clean already
    is ``unchanged``; a task that runs again does the same again. Folders must be mounted by
    all machines.
    """
    files = text_files.read_all(spark, *paths)
    rows = reports.compose(files, options, "text", "path")
    if options.metrics or options.threshold is not None:
        rows = reports.all_findings(rows, "text", "findings", None).withColumn("metrics", metrics.metrics_of(F.col("text")))
    else:
        rows = rows.withColumn("findings", F.lit(None).cast("array<struct<category:string,count:long>>")).withColumn("metrics", F.lit(None).cast("struct<words:int>"))
    over = F.when(F.col("text").isNotNull(), _over(F.col("findings"), options))
    outcome = F.when(F.col("text").isNull(), REJECTED).when(F.col("error").isNotNull(), REFUSED).otherwise(WRITTEN)
    same = F.col("cleaned") == F.col("text")
    todo = rows.select(
        "path", text_files.clean_name(F.col("path")).alias("name"), text_files.with_eol(F.col("cleaned"), F.col("eol")).alias("cleaned"),
        F.when((outcome == WRITTEN) & same & F.lit(folder is None), UNCHANGED).otherwise(outcome).alias("outcome"),
        "error", over.alias("over"), F.to_json("findings").alias("findings"), F.to_json("metrics").alias("metrics"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places: list[str | None] = []
            asides: list[str | None] = []
            for path, name, text, what in zip(batch["path"], batch["name"], batch["cleaned"], batch["outcome"]):
                wanted = what == WRITTEN
                asides.append(text_files.put_in_place(path, text, backup) if wanted and folder is None else None)
                places.append((path if folder is None else text_files.put_beside(folder, name, text)) if wanted else None)
            told = batch.drop(columns=["name", "cleaned"])
            yield told.assign(written=pd.Series(places, index=told.index, dtype=object), backup=pd.Series(asides, index=told.index, dtype=object))

    kind = "path string, outcome string, error string, over boolean, findings string, metrics string, written string, backup string"
    return _written(todo.mapInPandas(run, kind), report)
