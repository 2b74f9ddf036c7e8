"""WARC archives: writing pages as records, and reading records back by boundary chains.

Writing uses Spark's text sink: each part file is one archive, records one after another,
and a record's closing blank lines are the sink's line separator. Reading cuts the archives
at the version line, in splits of any size, on any file system. Every cut is only a
candidate, as payloads may hold that line too: each task emits its candidates' offsets and
the offsets of their successors by content length, and pointer jumping from the start of
each archive keeps the candidates that the chain of lengths reaches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

MAGIC = "WARC/1.0\r\n"
CLOSE = "\r\n\r\n"
#: Payloads shorter than this are never written as revisits.
REVISIT_BYTES = 100
#: Fixed date, so that equal pages give equal archives.
DATE = "1970-01-01T00:00:00Z"

_SAFE = r"[\x00-\x20\x7f]"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shortest: int = REVISIT_BYTES) -> DataFrame:
    """``id, url, html, digest, bytes, refers``: ``refers`` is the id of the response that a
    revisit points to, null for responses.

    Of equal payloads (by SHA-256 and length) of ``shortest`` bytes and more, the page with
    the smallest id is the response. Pages with a null id are always responses.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    first = stash(
        rows.filter((F.col("bytes") >= shortest) & F.col("id").isNotNull())
        .groupBy(F.col("digest").alias("_d"))
        .agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_times"))
        .filter("_times > 1"),
        "warc-first",
    )
    met = (F.col("digest") == F.col("_d")) & (F.col("bytes") >= shortest)
    refers = F.when(F.col("id") != F.col("_first"), F.col("_first"))
    return rows.join(first, met, "left").select("id", "url", "html", "digest", "bytes", refers.alias("refers"))


def _urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def record_text(record: DataFrame) -> Column:
    """A record without its magic's successor: all but the closing blank lines."""
    revisit = F.col("refers").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    # an address is one header line, whatever it holds
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), _SAFE, "%20")
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, line("WARC-Refers-To", _urn(F.col("refers")))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )


def write_archives(records: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Write planned records as archives of at most ``per_file`` records each."""
    lines = records.select(record_text(records).alias("value"))
    lines.write.option("lineSep", CLOSE).option("maxRecordsPerFile", per_file).text(path)


SUMMARY = "headers string, content_bytes long, content_sha256 string"


def _chunks(spark: SparkSession, path: str, give: str = "offsets") -> DataFrame:
    """``file, block, local, size, ahead``: what lies between two magic lines.

    ``local`` is the chunk's offset from the first one of its split, which is the part of
    ``file`` that starts at ``block``; ``size`` counts its bytes, and ``ahead`` how far its
    record's successor is from the chunk's start, null where it begins with no header. Where
    ``give`` is ``summary``, also :data:`SUMMARY` of what a record in the chunk would be, and
    where it is ``raw``, the chunk itself.
    """
    read = spark.read.option("lineSep", MAGIC).text(path)
    cut = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    more = {"offsets": "", "summary": f", {SUMMARY}", "raw": ", raw binary"}[give]
    names = {"offsets": [], "summary": ["headers", "content_bytes", "content_sha256"], "raw": ["raw"]}[give]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a split's rows come one after another, in the order of the file
        split, at = None, 0
        for batch in batches:
            rows = []
            for file, block, value in zip(batch["file"], batch["block"], batch["value"]):
                if split != (file, block):
                    split, at = (file, block), 0
                start = _content_start(value)
                length = _content_length(value[:start]) if start else None
                ahead = None if length is None else start + length + len(CLOSE) + len(MAGIC)
                extra = _summary(value) if give == "summary" else (value,) if give == "raw" else ()
                rows.append((file, block, at, len(value), ahead, *extra))
                at += len(value) + len(MAGIC)
            yield pd.DataFrame(rows, columns=["file", "block", "local", "size", "ahead", *names]).astype({"ahead": "Int64"})

    return cut.mapInPandas(run, f"file string, block long, local long, size long, ahead long{more}")


def _content(value: bytes) -> tuple[bytes, bytes]:
    start = _content_start(value)
    return value[:start], value[start : start + (_content_length(value[:start]) or 0)]


def _summary(value: bytes) -> tuple[str, int, str]:
    headers, content = _content(value)
    return headers.decode("utf-8", "replace"), len(content), hashlib.sha256(content).hexdigest()


def _content_start(value: bytes) -> int:
    """Where the content begins, 0 if there is no end of a header."""
    at = value.find(b"\r\n\r\n")
    return at + 4 if at >= 0 else 0


def _content_length(header: bytes) -> int | None:
    for line in header.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def _placed(chunks: DataFrame, bases: DataFrame) -> DataFrame:
    """Chunks with ``at``, their offset in the file; ``bases`` has the offset of each split."""
    return chunks.join(bases, ["file", "block"]).withColumn("at", F.col("base") + F.col("local"))


def reachable(pointers: DataFrame) -> DataFrame:
    """``file, at`` of the candidates on the chain from the first one of each file.

    ``pointers``: ``file, at, next``, with ``at`` a candidate's offset and ``next`` its
    successor's. Each round doubles the length of all jumps, so n records take log2(n).
    """
    known = stash(pointers.groupBy("file").agg(F.min("at").alias("at")), "warc-reach")
    jumps = pointers
    while True:
        ahead = jumps.select(F.col("file").alias("_f"), F.col("at").alias("_a"), F.col("next").alias("_n"))
        step = known.join(ahead, (F.col("file") == F.col("_f")) & (F.col("at") == F.col("_a"))).select("file", F.col("_n").alias("at"))
        # only offsets where a candidate is can be reached
        step = step.join(pointers.select("file", "at"), ["file", "at"])
        grown = stash(known.union(step).distinct(), "warc-reach")
        if grown.count() == known.count():
            return grown
        known = grown
        jumps = stash(
            jumps.join(ahead, (F.col("file") == F.col("_f")) & (F.col("next") == F.col("_a"))).select("file", "at", F.col("_n").alias("next")), "warc-jumps"
        )


def read_records(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """``file, at, headers, content_bytes, content_sha256, content``: the records of all archives under ``path``.

    ``at`` is a record's byte offset, ``headers`` its header lines as one string without the
    magic line, ``content`` its content as binary; without ``contents`` that is left out, and
    no content leaves the task that reads it but of records that are cut. A chain that meets something that is no
    record ends there, and what follows in that file is not read. Files without any record,
    and empty folders of archives, give no rows.
    """
    sizes = stash(_chunks(spark, path), "warc-offsets")
    totals = sizes.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stash(totals.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base")), "warc-bases")
    # what stands before a file's first magic is no candidate
    placed = stash(_placed(sizes, bases).filter("at > 0").select("file", "at", "size", "ahead"), "warc-placed")
    pointers = stash(placed.filter("ahead is not null").select("file", "at", (F.col("at") + F.col("ahead")).alias("next")), "warc-pointers")
    first = placed.groupBy("file").agg(F.min("at").alias("_first"))
    chain = reachable(pointers.join(first.filter(F.col("_first") == len(MAGIC)).select("file"), "file"))
    kept = stash(placed.join(chain, ["file", "at"]).select("file", "at", "size", "ahead"), "warc-kept")
    # a record that its own chunk does not hold goes on in the chunks of rejected candidates
    whole = F.col("ahead") <= F.col("size") + len(MAGIC)
    chunks = _placed(_chunks(spark, path, "raw"), bases)
    if contents:
        parts = _parsed(chunks.join(kept.filter(whole).select("file", "at"), ["file", "at"]))
    else:
        briefs = _placed(_chunks(spark, path, "summary"), bases).join(kept.filter(whole).select("file", "at"), ["file", "at"])
        parts = briefs.select("file", (F.col("at") - len(MAGIC)).alias("at"), "headers", "content_bytes", "content_sha256")
    cut = kept.filter(~whole)
    if cut.limit(1).count():
        over = cut.select("file", F.col("at").alias("_start"), (F.col("at") + F.col("ahead")).alias("_end"))
        spans = kept.select("file", "at", "ahead").union(placed.join(cut.select("file").distinct(), "file", "left_semi").join(kept.select("file", "at"), ["file", "at"], "left_anti").select("file", "at", F.lit(None).cast("long")))
        back = Window.partitionBy("file").orderBy("at")
        owner = F.last(F.when(F.col("ahead").isNotNull(), F.col("at")), ignorenulls=True).over(back)
        owned = stash(spans.select("file", "at", owner.alias("_owner")), "warc-owned").join(
            over.select("file", F.col("_start").alias("_owner"), "_end"), ["file", "_owner"]
        )
        pieces = chunks.join(owned.filter("at < _end"), ["file", "at"]).groupBy("file", "_owner").agg(F.sort_array(F.collect_list(F.struct("at", F.hex("raw").alias("raw")))).alias("p"))
        joined = F.unhex(F.array_join(F.transform("p", lambda x: x["raw"]), MAGIC.encode().hex()))
        whole_again = _parsed(pieces.select("file", F.col("_owner").alias("at"), joined.alias("raw")))
        parts = parts.unionByName(whole_again if contents else whole_again.drop("content"))
    return parts


def _parsed(chunks: DataFrame) -> DataFrame:
    return chunks.select("file", "at", "raw").mapInPandas(_parse, f"file string, at long, {SUMMARY}, content binary")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file, at, raw in zip(batch["file"], batch["at"], batch["raw"]):
            rows.append((file, at - len(MAGIC), *_summary(raw), _content(raw)[1]))
        yield pd.DataFrame(rows, columns=["file", "at", "headers", "content_bytes", "content_sha256", "content"])


def header(name: str) -> Column:
    """A header's value, null where the record has none of the name."""
    found = F.regexp_extract("headers", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(F.col("headers").rlike(rf"(?im)^{name}:"), found)
