"""The ``opN_<name>`` queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, language_id, license_scan, quality_classifier, quality_rules, sharding, simhash, token_counts, url_filter
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id", "window").agg(F.max("matched").alias("matched"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.evaluated(url_filter.captured(pages), url_filter.reported(pages))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetch_day", "listed_since")})


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.with_score(docs, model)
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


SHARDS = [f"shard-{k:02d}" for k in range(32)]
SLOTS = sharding.next_prime(sharding.SLOTS_PER_SHARD * len(SHARDS))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.with_language(docs.drop("lang"), language_id.train(docs))
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policy(quality_rules.ledger(texts(spark, sf_dir)), "v1")
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return book.select("doc_id", *measures, quality_rules.rejected("base").alias("base_failed"), "kept", "failed_bits")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.with_counts(texts(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.with_digests(texts(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_url_filter,
        op3_quality_classifier,
        op4_sharding,
        op5_language_id,
        op6_quality_rules,
        op7_token_counts,
        op8_license_scan,
        op9_simhash_dedup,
        op10_bpe_round_trip,
    )
}
#: The others are fitted models, exact tokenizers or iterative; tests hold them against brute force.
ORACLES = {
    "op1_decontamination": decontamination.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op4_sharding": sharding.ORACLE.format(n=len(SHARDS), m=SLOTS),
    "op6_quality_rules": quality_rules.ORACLE,
    "op8_license_scan": license_scan.oracle(),
}
