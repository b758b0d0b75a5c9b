"""Command logs derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cmdlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, op, key, value): signup and click set, purchase modifies, error deletes, view gets."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.expr("case when event_type in ('signup', 'click') then 'SET' when event_type = 'purchase' then 'MOD' when event_type = 'error' then 'DEL' else 'GET' end")
    key = F.concat(F.lit("u"), F.col("user_id"), F.lit(":"), F.col("event_id") % 20)
    rows = events.select(F.col("event_id").alias("seq"), op.alias("op"), key.alias("key"), "props")
    return rows.select("seq", "op", "key", F.when(F.col("op").isin("SET", "MOD"), F.col("props")).alias("value"))


#: The same log, as common table expressions for the oracles.
LOG_SQL = """log AS (
  SELECT event_id AS seq,
         CASE WHEN event_type IN ('signup', 'click') THEN 'SET' WHEN event_type = 'purchase' THEN 'MOD' WHEN event_type = 'error' THEN 'DEL' ELSE 'GET' END AS op,
         'u' || user_id || ':' || (event_id % 20) AS key,
         CASE WHEN event_type IN ('signup', 'click', 'purchase') THEN props END AS value
  FROM events
)"""

#: Writes that take effect, by the anchor rule, over a relation ``log``.
EFF_SQL = """anchored AS (
  SELECT *, last_value(CASE WHEN op IN ('SET', 'DEL') THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq) AS anchor FROM log
), eff AS (SELECT seq, op, key, value FROM anchored WHERE op IN ('SET', 'DEL') OR (op = 'MOD' AND anchor = 'SET'))"""

STATE_SQL = """newest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM eff),
state AS (SELECT key, value FROM newest WHERE rn = 1 AND op <> 'DEL')"""
