"""Verbs on a keyed state (key, value): reads and copy-on-write changes as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The row of the greatest ``order`` for each key, by partial aggregation."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("x"))
    return best.select(*keys, *[F.col(f"x.{v}").alias(v) for v in values])


def get(state: DataFrame, key: str) -> DataFrame:
    """One row (key, found, value); ``value`` is the text NULL on a miss."""
    hit = state.where((F.col("key") == key) & (F.col("key") != "")).agg(F.max("value").alias("v"))
    return hit.select(F.lit(key).alias("key"), F.col("v").isNotNull().alias("found"), F.coalesce("v", F.lit("NULL")).alias("value"))


def multi_get(state: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, found, value) of each probe key."""
    hit = probes.join(state.where("key <> ''").withColumnRenamed("value", "v"), "key", "left")
    return hit.select("key", F.col("v").isNotNull().alias("found"), F.coalesce("v", F.lit("NULL")).alias("value"))


def upsert(state: DataFrame, sets: DataFrame) -> DataFrame:
    """``state`` after blind writes, at most one a key; rows without a key or value are no-ops."""
    new = sets.dropna(subset=["key", "value"]).select("key", "value", F.lit(1).alias("age"))
    return newest(state.select("key", "value", F.lit(0).alias("age")).unionByName(new), ["key"], ["age"], ["value"])


def modify(state: DataFrame, mods: DataFrame) -> DataFrame:
    """``state`` after writes that need an existing key, at most one a key."""
    new = mods.dropna(subset=["key", "value"]).select("key", F.col("value").alias("new"))
    return state.join(new, "key", "left").select("key", F.coalesce("new", "value").alias("value"))


def delete(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys.select("key"), "key", "left_anti")


def sizes(state: DataFrame) -> DataFrame:
    """(n_keys, n_bytes) of a state."""
    total = F.coalesce(F.sum(F.octet_length("key") + F.octet_length("value")), F.lit(0)).cast("bigint")
    return state.agg(F.count(F.lit(1)).alias("n_keys"), total.alias("n_bytes"))
