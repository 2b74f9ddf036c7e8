"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Used where a session of one machine names no shared folder, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints/inkglass"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    A session of one machine may leave it unset; on a cluster there is no such folder to guess.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; its files go when the driver ends."""
    path = f"{shared_dir(spark)}/inkglass-{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The table survives lost executors, its size is known to the planner (so a join
    broadcasts it only if it is really small), and a join with it has a plain exchange on
    either side, which adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stash_buckets(df: DataFrame, tag: str, buckets: int, key: str) -> DataFrame:
    """As :func:`stash`, as a table of ``buckets`` buckets by ``key``, which later groupings need not exchange.

    Its name stays in the session's catalog; its files go when the driver ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Words in a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))
