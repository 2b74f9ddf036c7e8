"""Reports over findings: totals, gate, pivot, and previews of cleaning."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import edits
from ..functions.characters import CATEGORIES
from ..functions.spans import by_row, let, settled
from . import carriers, cleaning, look_alikes, markdown, metrics, profiles, signals, source_code
from .cleaning import CleanOptions


def category_totals(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document and one column per category."""
    sums = [F.sum(F.when(F.col("category") == c, F.col("count")).otherwise(0)).alias(c) for c in CATEGORIES]
    return findings.groupBy(id_col).agg(*sums)


def category_columns(counts: Column) -> dict[str, Column]:
    """The same from an array of counted signals or findings, as columns of its own row."""
    add = lambda c: F.aggregate(F.filter(counts, lambda x: x["category"] == c), F.lit(0).cast("long"), lambda a, x: a + x["count"])
    return {c: add(c) for c in CATEGORIES}


def gate(findings: DataFrame, threshold: int, categories: tuple[str, ...] = CATEGORIES, id_col: str = "doc_id") -> DataFrame:
    """``id_col, total, failed`` for documents with findings of the chosen categories."""
    rows = findings.filter(F.col("category").isin(*categories)).groupBy(id_col).agg(F.sum("count").alias("total"))
    return rows.withColumn("failed", F.col("total") >= threshold)


def gate_rows(rows: DataFrame, threshold: int, categories: tuple[str, ...] = CATEGORIES, id_col: str = "doc_id", findings_col: str = "findings") -> DataFrame:
    """As :func:`gate`, for rows that hold their findings, or counts of signals, as an array."""
    columns = category_columns(F.col(findings_col))
    total = reduce(lambda a, b: a + b, [columns[c] for c in categories])
    return rows.select(id_col, total.alias("total")).filter("total > 0").withColumn("failed", F.col("total") >= threshold)


def planned(docs: DataFrame, cleaned: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What cleaning would change: lengths before and after, net differences, joined lines."""
    rows = docs.select(id_col, F.col(text_col).alias("before"), cleaned.alias("after"))
    n = {s: metrics.metrics(F.col(s)) for s in ("before", "after")}
    return rows.select(
        id_col,
        (F.col("before") != F.col("after")).alias("changed"),
        *[n[s][m].alias(f"{s}_{m}") for s in n for m in ("characters", "lines", "words")],
        F.greatest(F.lit(0), F.length("before") - F.length("after")).alias("removed_characters"),
        F.greatest(F.lit(0), F.length("after") - F.length("before")).alias("added_characters"),
        F.greatest(F.lit(0), n["before"]["lines"] - n["after"]["lines"]).alias("joined_lines"),
    )


def signal_changes(before: DataFrame, after: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, resolved, unchanged``: sorted signals that cleaning removes and leaves."""
    sets = lambda d, n: d.groupBy(id_col).agg(F.collect_set("signal").alias(n))
    both = sets(before, "b").join(sets(after, "a"), id_col, "left")
    left = F.coalesce("a", F.array().cast("array<string>"))
    return both.select(id_col, F.array_sort(F.array_except("b", left)).alias("resolved"), F.array_sort(F.array_intersect("b", left)).alias("unchanged"))


def unified_diff(before: Column | str, after: Column | str, name: Column | str) -> Column:
    """A unified diff with three lines of context; empty where nothing changes."""
    lines = lambda t: (t or "").splitlines(True)
    return by_row(lambda a, b, n: edits.unified(lines(a), lines(b), str(n), f"{n} (cleaned)"), "string")(before, after, name)


def replacement_spans(before: Column | str, after: Column | str) -> Column:
    """How many stretches of whole texts are replaced (:mod:`..functions.edits`); 0 for equal texts and nulls."""
    return by_row(lambda a, b: 0 if a is None or b is None else edits.replacements(a, b), "int")(before, after)


def first_location(locations: Column) -> Column:
    """The first place as line:column, and how many more there are; a dash where there is none."""
    first, more = F.try_element_at(locations, F.lit(1)), F.size(locations) - 1
    told = F.concat(first["line"].cast("string"), F.lit(":"), first["column"].cast("string"), F.when(more > 0, F.format_string(" (+%d)", more)).otherwise(""))
    return F.coalesce(told, F.lit("-"))


@dataclass(frozen=True)
class Options:
    """What to do with documents, and how to tell of it. :meth:`check` knows what excludes what."""

    clean: CleanOptions = CleanOptions()
    final_newline: bool = True
    source: bool = False
    unwrap_markdown: bool = False
    metrics: bool = False
    dry_run: bool = False
    diff: bool = False
    form: str = "human"  # or json, csv
    output: str | None = None
    in_place: bool = False
    inputs: int = 1
    watermark_profiles: tuple[dict, ...] = ()
    threshold: int | None = None
    categories: tuple[str, ...] = CATEGORIES

    @property
    def reports(self) -> bool:
        """Whether these options ask for a report rather than for cleaned texts."""
        return self.dry_run or bool(self.watermark_profiles) or (self.metrics and not (self.output or self.in_place))

    def check(self) -> Options:
        wrong = {
            "a diff needs a dry run": self.diff and not self.dry_run,
            "a diff is no part of JSON or CSV": self.diff and self.form != "human",
            "source and Markdown are cleaned by different rules": self.source and self.unwrap_markdown,
            "one output file takes one input": self.output not in (None, "-") and self.inputs > 1,
            "a dry run writes nothing": self.dry_run and (self.output is not None or self.in_place),
            f"form must be human, json or csv, not {self.form}": self.form not in ("human", "json", "csv"),
            "unknown category": bool(set(self.categories) - set(CATEGORIES)),
        }
        for problem, is_so in wrong.items():
            if is_so:
                raise ValueError(problem)
        return self


def _bears_valid(text: Column) -> Column:
    return F.coalesce(carriers.may_carry(text) & F.exists(carriers.carriers(text), lambda c: c["valid"]), F.lit(False))


def compose(docs: DataFrame, options: Options = Options(), text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``docs`` with ``cleaned`` and ``error``: comments or the text cleaned, soft breaks joined, the last line ended.

    Markdown that still holds a valid carrier is not reformatted: its ``cleaned`` is null
    and ``error`` says why. Null texts stay null. Columns of these names are replaced.
    """
    options.check()
    text = F.col(text_col)
    if options.source:
        path = F.col(path_col) if path_col else F.lit(None).cast("string")
        rows = docs.withColumn("_language", source_code.language_of(path))
        rows = source_code.clean_comments(rows, text_col, "_language", "_clean", options.clean.strip_provenance).drop("_language")
    else:
        # a filter on ``error`` takes the expression with it, to where a text may be an expression too: both are named once
        refuses = options.unwrap_markdown and not options.clean.strip_provenance
        tell = lambda c: F.struct(c.alias("text"), (_bears_valid(c) if refuses else F.lit(False)).alias("refused"))
        rows = docs.withColumn("_told", let(text, lambda t: let(cleaning.clean(t, options.clean), tell)))
        rows = rows.withColumn("_refused", F.col("_told.refused")).withColumn("_clean", F.col("_told.text")).drop("_told")
    refused = F.lit(False) if options.source else F.col("_refused")
    if options.unwrap_markdown:
        rows = rows.withColumn("_clean", F.when(~refused, F.col("_clean"))).withColumn("_clean", markdown.unwrap(settled("_clean")))
    error = F.when(refused, "a valid provenance carrier would be reformatted; strip it first")
    rows = rows.withColumn("error", error).withColumn("cleaned", cleaning.final_newline(F.col("_clean"), options.final_newline))
    return rows.drop("_clean", "_refused")


def all_findings(docs: DataFrame, text_col: str = "text", out: str = "findings", results: Column | None = None) -> DataFrame:
    """``docs`` with ``out``, the findings of every kind in their order.

    Characters by category and signal, then scripts, tokens, normalisation, carriers, and
    the detected among ``results``, an array of :func:`.profiles.watermark_status`.
    """
    text = F.col(text_col)
    kinds = {
        "_f1": signals.character_findings(text),
        "_f2": signals.script_findings(text),
        "_f3": look_alikes.token_findings(text),
        "_f4": look_alikes.normalization_findings(F.col("_changes")),
        "_f5": carriers.carrier_findings_of(text),
    }
    if results is not None:
        kinds["_f6"] = profiles.watermark_findings(results)
    rows = docs.withColumn("_changes", look_alikes.normalization_changes(settled(text_col)))
    for name, column in kinds.items():
        rows = rows.withColumn(name, column)
    return rows.withColumn(out, F.when(text.isNotNull(), F.concat(*kinds))).drop("_changes", *kinds)


def report(docs: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, authorship: DataFrame | None = None) -> DataFrame:
    """One row per document, nothing exchanged but for ``authorship``.

    ``id_col, schema_version, total, findings, finding_count, unicode_ghosts, typographic,
    whitespace``, and, as the options ask: ``metrics, markdown`` (for names of Markdown files
    too), ``source, known_watermarks, planned, diff, error, failed`` (the threshold).
    ``authorship``: ``id_col, findings``, as :func:`.profiles.authorship_findings` gives.
    A null text has null facts. Rows that repeat an id are reported each.
    """
    options.check()
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), path.alias("_path"))
    text = F.col("_text")
    results = None
    if options.watermark_profiles:
        results = F.col("known_watermarks")
        rows = rows.withColumn("known_watermarks", F.array(*[profiles.watermark_status(text, p) for p in options.watermark_profiles]))
    rows = all_findings(rows, "_text", "findings", results)
    if authorship is not None:
        told = authorship.select(F.col(id_col).alias("_aid"), F.col("findings").alias("_af"))
        rows = rows.join(told, F.col("_id") == F.col("_aid"), "left").withColumn("findings", F.concat("findings", F.coalesce("_af", F.array().cast(f"array<{signals.FINDING}>")))).drop("_aid", "_af")
    blanks = signals.whitespace_counters(text)
    count = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, f: a + f["count"])
    rows = rows.withColumn("_counters", signals.counters(text)).withColumn("total", signals.total(text)).withColumn("finding_count", count("findings"))
    rows = rows.withColumn("whitespace", F.struct(*[c.alias(n) for n, c in blanks.items()]))
    columns = ["total", "findings", "finding_count", "_counters.unicode_ghosts", "_counters.typographic", "whitespace"]
    if options.metrics:
        rows = rows.withColumn("metrics", metrics.metrics_of(text))
        columns.append("metrics")
    wanted = F.lit(True) if options.unwrap_markdown else F.coalesce(F.lower("_path").rlike(r"\.(md|markdown|mdx)$"), F.lit(False))
    rows = rows.withColumn("markdown", F.when(wanted, markdown.audit_of(text)))
    columns.append("markdown")
    if options.source:
        rows = source_code.with_scan(rows.withColumn("_language", source_code.language_of(F.col("_path"))), "_text", "_language", "source")
        columns.append("source")
    if results is not None:
        columns.append("known_watermarks")
    if options.dry_run:
        rows = compose(rows, options, "_text", "_path")
        rows = all_findings(rows, "cleaned", "_after")
        rows = rows.withColumn("_spans", replacement_spans(settled("_text"), settled("cleaned"))).withColumn("_m1", F.col("metrics") if options.metrics else metrics.metrics_of(text)).withColumn("_m2", metrics.metrics_of(F.col("cleaned")))
        # detectors are not run again on the cleaned text, so what they found is not compared
        names = lambda c: F.array_distinct(F.transform(F.filter(c, lambda f: ~f["category"].isin("known_watermark", "authorship_signal")), lambda f: f["signal"]))
        before, after = names("findings"), names("_after")
        difference = F.length("_text") - F.length("cleaned")
        planned = {
            "changed": ~text.eqNullSafe(F.col("cleaned")),
            "before": F.col("_m1"),
            "after": F.col("_m2"),
            "removed_characters": F.greatest(F.lit(0), difference),
            "added_characters": F.greatest(F.lit(0), -difference),
            "replacement_spans": F.col("_spans"),
            "joined_lines": F.greatest(F.lit(0), F.col("_m1.lines") - F.col("_m2.lines")),
            "before_finding_count": F.col("finding_count"),
            "after_finding_count": count("_after"),
            "unchanged_findings": F.array_sort(F.array_intersect(before, after)),
            "resolved_findings": F.array_sort(F.array_except(before, after)),
        }
        rows = rows.withColumn("planned", F.when(F.col("error").isNull() & text.isNotNull(), F.struct(*[c.alias(n) for n, c in planned.items()])))
        columns += ["planned", "error"]
        if options.diff:
            rows = rows.withColumn("diff", unified_diff(settled("_text"), settled("cleaned"), F.coalesce("_path", F.col("_id").cast("string"))))
            columns.append("diff")
    if options.threshold is not None:
        picked = reduce(lambda a, b: a + b, [category_columns(F.col("findings"))[c] for c in options.categories])
        rows = rows.withColumn("failed", picked >= options.threshold)
        columns.append("failed")
    return rows.select(F.col("_id").alias(id_col), F.lit(signals.SCHEMA_VERSION).alias("schema_version"), *columns)


def csv_rows(reports: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One flat row per report: totals, one column per category, and whatever scalar facts the reports hold."""

    def scalars(prefix: str, path: str, kind: T.StructType) -> list[Column]:
        plain = sorted(f.name for f in kind.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)))
        return [F.col(f"{path}.{n}").alias(f"{prefix}{n}") for n in plain]

    kinds = {f.name: f.dataType for f in reports.schema.fields}
    out = [F.col(id_col).alias("file"), F.col("schema_version"), F.col("total"), *[c.alias(n) for n, c in category_columns(F.col("findings")).items()]]
    if "metrics" in kinds:
        out += scalars("", "metrics", kinds["metrics"])
    if "planned" in kinds:
        out += scalars("planned_", "planned", kinds["planned"])
        for stage in ("before", "after"):
            # the counts of findings are facts of the plan, and told there
            out += scalars(f"{stage}_", f"planned.{stage}", kinds["planned"][stage].dataType)
    taken: set[str] = set()
    names = [c for c in out if not (reports.select(c).columns[0] in taken or taken.add(reports.select(c).columns[0]))]
    return reports.select(*names)


def human(reports: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, report``: each report as text, one line per finding and one per group of facts."""
    line = lambda f: F.concat_ws("  ", F.rpad(f["category"], 18, " "), F.rpad(f["signal"], 34, " "), F.lpad(f["count"].cast("string"), 6, " "), F.rpad(first_location(f["locations"]), 14, " "), F.rpad(f["confidence"], 13, " "), f["planned_action"])
    facts = [n for n in ("metrics", "markdown", "source", "known_watermarks", "planned") if n in reports.columns]
    more = [F.when(F.col(n).isNotNull(), F.concat(F.lit(n + ": "), F.to_json(F.when(F.col(n).isNotNull(), F.col(n))))) for n in facts]
    head = F.concat(F.lit("File: "), F.col(id_col).cast("string"), F.lit("\nSchema: "), F.col("schema_version"), F.lit("  anomalies: "), F.col("total").cast("string"))
    diff = [F.col("diff")] if "diff" in reports.columns else []
    return reports.select(id_col, F.concat_ws("\n", head, F.array_join(F.transform("findings", line), "\n"), *more, *diff).alias("report"))
