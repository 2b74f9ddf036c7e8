"""Exact dedup: content hash, then byte comparison inside each hash group.

Built-in expressions only. Rows are grouped by a 128-bit hash *and* the text, so equal
hashes of different texts never meet in one class; partial aggregation collapses copies
inside each task before the exchange, so a text that fills a third of the table sends one
row a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_hash", digest(F.col("_text")))


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``.

    ``keep`` names the row of equal texts that stays: ``min`` (the smallest id, the
    default) or ``max``. Null texts count as empty. Null ids are never chosen over an id;
    a group of null ids only has ``keep_id`` null and keeps them. Rows that repeat both id
    and text share one fate. Other columns are ignored, so their names cannot clash. An
    empty table gives no rows.
    """
    best = {"min": F.min, "max": F.max}[keep]
    keyed = _keyed(docs, id_col, text_col, digest)
    classes = stash(
        keyed.groupBy("_hash", "_text")
        .agg(F.count(F.lit(1)).alias("group_size"), best("_id").alias("keep_id"))
        .select("_hash", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), "group_size", "keep_id"),
        "exact-classes",
    )
    # Texts that share the hash are told apart by SHA-256; were two of them to share that
    # as well, the classes could not be named, and a wrong answer is worse than none.
    if classes.groupBy("_hash", "text_sha256").count().filter("count > 1").limit(1).count():
        raise ValueError("two different texts share both digests")
    ids = keyed.select("_id", "_hash", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"))
    return ids.join(classes, ["_hash", "text_sha256"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows that stay, one for each text, with the columns of ``docs``.

    The aggregation carries the row itself, so texts cross the network once. Rows that
    repeat both id and text leave a single row. Nulls as in :func:`duplicate_groups`.
    """
    pick = {"min": F.min_by, "max": F.max_by}[keep]
    names = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in names if c != text_col]
    row = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)], F.col(text_col).isNull().alias("_null"))
    kept = docs.select(content_hash(text).alias("_hash"), text.alias("_text"), F.col(id_col).alias("_order"), row.alias("_row"))
    # min_by and max_by pass over null ids; a group that has no other keeps any one row
    first = kept.groupBy("_hash", "_text").agg(F.coalesce(pick("_row", "_order"), F.first("_row")).alias("_row"))
    return first.select(
        *[
            F.when(~F.col("_row._null"), F.col("_text")).alias(c) if c == text_col else F.col(f"_row._{rest.index(c)}").alias(c)
            for c in names
        ]
    )
