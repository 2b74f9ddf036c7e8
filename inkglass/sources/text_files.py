"""Whole text files as documents: strict UTF-8, line ends kept."""

from __future__ import annotations

import itertools
import os
import shutil
import tempfile
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def eol_of(text: Column) -> Column:
    """CRLF if the text has any, else CR if it has any, else LF."""
    return F.when(F.contains(text, F.lit("\r\n")), "\r\n").when(F.contains(text, F.lit("\r")), "\r").otherwise("\n")


def once(inputs: DataFrame) -> DataFrame:
    """Inputs without those that name a ``path`` again."""
    return inputs.dropDuplicates(["path"])


def read_all(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, length, text, eol`` of files; ``text`` and ``eol`` are null where a file is not UTF-8.

    A file that is named twice is read once.
    """
    files = once(spark.read.format("binaryFile").load(list(dict.fromkeys(paths))))
    texts = files.select("path", "length", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return texts.withColumn("eol", F.when(F.col("text").isNotNull(), eol_of(F.col("text"))))


def read_texts(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Documents ``path, text, eol``, and rejects ``path, length``: files that are not UTF-8."""
    texts = read_all(spark, *paths)
    good = texts.filter("text is not null").select("path", "text", "eol")
    return good, texts.filter("text is null").select("path", "length")


def with_eol(text: Column, eol: Column) -> Column:
    """A text of LF lines with other line ends."""
    return F.replace(text, F.lit("\n"), eol)


def clean_name(path: Column) -> Column:
    """a/b.txt becomes a/b.clean.txt, and a/b becomes a/b.clean."""
    return F.regexp_replace(path, r"^(.*?)(\.[^./]+)?$", "$1.clean$2")


def _path(uri: str) -> str:
    return unquote(urlsplit(uri).path) if uri.startswith("file:") else uri


def _write_whole(path: str, content: bytes, like: str | None = None) -> None:
    """A file that is there whole or not at all: written beside its place, synced, then moved there."""
    handle, beside = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=f".{os.path.basename(path)}.", suffix=".part")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        if like:
            shutil.copymode(like, beside)
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise


def _set_aside(path: str) -> str:
    """Copy a file to the first of ``path.tmp, path.tmp.1, ...`` that does not exist; none is overwritten."""
    for n in itertools.count():
        name = f"{path}.tmp" + (f".{n}" if n else "")
        try:
            with open(name, "xb") as copy, open(path, "rb") as original:
                shutil.copyfileobj(original, copy)
        except FileExistsError:
            continue
        shutil.copystat(path, name)
        return name
    raise AssertionError


def put_beside(folder: str, name: str, text: str | None) -> str:
    """Write a text to a folder under the last part of ``name``; where it went."""
    os.makedirs(folder, exist_ok=True)
    place = os.path.join(folder, os.path.basename(_path(name)))
    _write_whole(place, (text or "").encode())
    return place


def put_in_place(uri: str, text: str | None, backup: bool = False) -> str | None:
    """Replace a file at once, unless it holds the text already; where the old one was set aside."""
    path, content = _path(uri), (text or "").encode()
    with open(path, "rb") as f:
        if f.read() == content:
            return None
    aside = _set_aside(path) if backup else None
    _write_whole(path, content, like=path)
    return aside


def write_texts(docs: DataFrame, folder: str) -> DataFrame:
    """Write each ``text`` with the line ends ``eol`` as a file of its own: ``path, written``, once collected.

    Files are named by :func:`clean_name` of ``path`` and need a folder that all machines
    mount; tables go by Spark's own writers. Two paths of one name would share a file, so
    names must be distinct. A task that runs again writes the same files again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "written": [put_beside(folder, n, t) for n, t in zip(batch["name"], batch["text"])]})

    named = docs.select("path", clean_name(F.col("path")).alias("name"), with_eol(F.col("text"), F.col("eol")).alias("text"))
    return named.mapInPandas(run, "path string, written string")


def replace_in_place(docs: DataFrame, backup: bool = False) -> DataFrame:
    """Replace the files ``path`` by ``text`` with the line ends ``eol``: ``path, backup``, once collected.

    Each file is replaced at once and keeps its mode; ``backup`` sets the old one aside
    first, under a name that is free. Files that hold the text already are left alone, so a
    task that runs again changes nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            aside = [put_in_place(uri, text, backup) for uri, text in zip(batch["path"], batch["text"])]
            yield pd.DataFrame({"path": batch["path"], "backup": pd.Series(aside, dtype=object)})

    return docs.select("path", with_eol(F.col("text"), F.col("eol")).alias("text")).mapInPandas(run, "path string, backup string")


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Flat rows, such as those of :func:`..operators.reports.csv_rows`."""
    rows.write.option("header", True).csv(path)
