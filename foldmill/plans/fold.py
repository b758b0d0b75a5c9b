"""The fold of an ordered command log: current state, effective writes, as-of replies.

SET and DEL always take effect ("anchors"); MOD takes effect only if its key exists, that is, if the last
anchor before it is a SET.  So a key's state after any prefix of the log follows from two running maxima:
the last anchor, and the last SET or MOD.  If the anchor is a SET, the value is that of the last SET or
MOD; else the key is absent.

A final state needs no window at all: both maxima are partial aggregates, so a hot key costs one row a
task in the shuffle.  As-of reads run in two levels: maxima of each (key, block of seq), a running
maximum over a key's blocks, and windows inside a block, so no task ever holds all rows of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers in one block; a window sorts at most this many rows of a key.
BLOCK = 1 << 20


def anchor() -> Column:
    return F.when(F.col("op").isin("SET", "DEL"), F.struct("seq", "op"))


def write() -> Column:
    return F.when(F.col("op").isin("SET", "MOD"), F.struct("seq", "value"))


def state(log: DataFrame) -> DataFrame:
    """(key, value) of all keys that exist after the whole log."""
    last = log.groupBy("key").agg(F.max(anchor()).alias("a"), F.max(write()).alias("w"))
    return last.where("a.op = 'SET'").select("key", F.col("w.value").alias("value"))


def latest_writes(log: DataFrame) -> DataFrame:
    """(key, value, seq, is_deleted): the last effective write of each key, tombstones included."""
    last = log.groupBy("key").agg(F.max(anchor()).alias("a"), F.max(write()).alias("w")).where("a is not null")
    alive = F.col("a.op") == "SET"
    return last.select("key", F.when(alive, F.col("w.value")).alias("value"), F.when(alive, F.col("w.seq")).otherwise(F.col("a.seq")).alias("seq"), (~alive).alias("is_deleted"))


def as_of(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """``log`` with ``anchor`` and ``write``, the last ones at each row, the row itself included."""
    rows = log.withColumns({"block": F.expr(f"seq div {block}"), "own_a": anchor(), "own_w": write()})
    sums = rows.groupBy("key", "block").agg(F.max("own_a").alias("a"), F.max("own_w").alias("w"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("key", "block", F.max("a").over(before).alias("in_a"), F.max("w").over(before).alias("in_w"))
    upto = Window.partitionBy("key", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({"run_a": F.max("own_a").over(upto), "run_w": F.max("own_w").over(upto)})
    joined = inner.join(carried, ["key", "block"])
    # A running value inside the block is later than any carried one.
    return joined.select(*log.columns, F.coalesce("run_a", "in_a").alias("anchor"), F.coalesce("run_w", "in_w").alias("write"))


def effective_writes(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """The SET, DEL and MOD commands that change the store."""
    rows = as_of(log.where("op <> 'GET'"), block)
    return rows.where("op <> 'MOD' or anchor.op = 'SET'").select("seq", "op", "key", "value")


def replies(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """(seq, op, key, got, reply): what each command is answered; ``got`` is null on a miss."""
    rows = as_of(log, block)
    found = (F.col("op") == "GET") & (F.col("key") != "") & (F.col("anchor.op") == "SET")
    got = F.when(found, F.col("write.value"))
    reply = F.when(F.col("op") == "GET", F.coalesce(got, F.lit("NULL"))).otherwise(F.lit("OK"))
    return rows.select("seq", "op", "key", got.alias("got"), reply.alias("reply"))
