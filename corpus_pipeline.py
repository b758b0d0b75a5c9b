"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage sees all that its predecessor kept.  A stage that filters returns the columns of its input
unchanged; the last returns each document's token digest.  Nulls, empty texts, repeated rows and empty
tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldmill.llm import bpe, decontamination, language_id, quality_classifier, simhash
from foldmill.llm.common import made_so_far, materialize, release, release_since, table
from foldmill.llm.queries import tokenizer_path


#: Jaccard similarity of five-word shingles from which texts are near copies.
SIMILAR = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents too far from every learned language go."""
    return language_id.accepted(docs, language_id.train(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks as low quality go."""
    return quality_classifier.accepted(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays; texts of similarity 0.8 or more are near duplicates."""
    return simhash.deduplicated(docs, similar=SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left."""
    out = bpe.with_digests(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("bpe_encoding", encode),
]
#: Fitted models, a graph's components and an exact tokenizer are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of the tables in between, only the last one stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = made_so_far()
        kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release_since(spark, before, kept)
        release(docs)
        docs = kept
    return docs
