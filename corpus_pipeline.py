"""From raw documents to encoded training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.llm import exact_dedup, mixing, near_dedup, quality_crf, sentencepiece_lattice
from inkglass.llm.queries import SENTENCEPIECE_MODEL, held_out

#: Documents whose quality score is below this are rejected.
REJECT_BELOW = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality go; the classifier learns from the labels that are not held out."""
    names = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    chain = quality_crf.fit(docs, labels)
    out = max(names, key=len) + "_score"  # longer than any name, so none of them
    return quality_crf.score(docs, chain, out=out).filter(F.col(out) >= REJECT_BELOW).select(*names)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text stays, the one with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def deduplicate_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8."""
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document comes as often as the mix takes it."""
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix."""
    model = sentencepiece_lattice.load_model(SENTENCEPIECE_MODEL)
    return sentencepiece_lattice.encode(docs, model, carry=["doc_id", "lang", "source"]).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("exact dedup", deduplicate),
    ("MinHash near-dedup", deduplicate_near),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", encode),
]

#: The classifier, the mix and the encoder are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on all that the one before kept.

    Each stage's documents are written to the shared folder before the next reads them, as
    the stages read them several times.
    """
    from inkglass.llm.common import stash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
