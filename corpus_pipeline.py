"""From raw documents to packed training sequences, as stages that read what the one before wrote.

Quality rules and near duplicates drop documents, the secret scan masks what it finds, mixing samples to target
weights, packing returns token pieces instead of documents.

Nulls: a null or empty text has too few words for the rules and goes; a null doc_id, source or lang stays, and rows without
a doc_id are nobody's duplicates. Repeated rows share their fate; two texts of one doc_id are judged each by itself. Very long
texts are worked on whole. Further columns of any name go through all stages but the last as they are. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trickstat.llm import mixing, ngram_join, packing, quality_rules, secret_scan
from trickstat.llm.queries import vocabulary
from trickstat.llm.shared import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their language's perplexity band keep."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id."""
    return ngram_join.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars, if there, as it is then."""
    out = secret_scan.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens come closer to the tempered shares of sources, languages and topics."""
    return mixing.sampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and its place in it."""
    return packing.pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secrets),
    ("mixing_weights", mix),
    ("best_fit_packing", pack),
]

#: Tokens, perplexities and best-fit packing are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
