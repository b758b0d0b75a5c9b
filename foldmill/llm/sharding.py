"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table (offset and skip from
hashes of its name).  Shards take turns, each claiming the next free slot it prefers, until the table is
full, so shares differ by at most one slot and a changed set of shards moves few slots.  The table has a
fixed number of rows, is broadcast, and places a document in constant time by the hash of its key; nothing
is shuffled, and a hot source spreads like any other rows because keys are hashed.

Cases: a null key is placed like an empty one; equal keys always share a shard; an empty table gives an
empty result; texts are not read; other columns pass through, and ``slot`` and ``shard`` replace columns
of these names; a table size that is not prime, or smaller than the number of shards, is an error, as are
repeated shard names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, without

#: Slots for each shard at least, if no table size is given.
SLOTS_PER_SHARD = 128
#: Bytes of input, about, that one written file holds.
FILE_BYTES = 256 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def next_prime(n: int) -> int:
    while not is_prime(n):
        n += 1
    return n


def number(text: str, start: int) -> int:
    """60 bits of the MD5 of a text, from hexadecimal digit ``start`` on."""
    return int(hashlib.md5(text.encode()).hexdigest()[start : start + 15], 16)


def fill(shards: list[str], size: int) -> list[int]:
    """The shard's index in each slot."""
    if not shards or len(set(shards)) < len(shards) or not is_prime(size) or size < len(shards):
        raise ValueError("shards must be distinct and the table size a prime of at least their number")
    at = [number(s, 0) % size for s in shards]
    skip = [number(s, 15) % (size - 1) + 1 if size > 1 else 1 for s in shards]
    table, left = [-1] * size, size
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot_of(key: Column, size: int) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % F.lit(size).cast("bigint")


def placed(df: DataFrame, key_col: str, shards: list[str], size: int | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard``."""
    size = size or next_prime(SLOTS_PER_SHARD * len(shards))
    rows = list(enumerate(shards[k] for k in fill(shards, size)))
    key = fresh([*df.columns, "slot", "shard"], "_key")
    df = without(df.withColumns({key: df[key_col]}), ["slot", "shard"])
    table = df.sparkSession.createDataFrame(rows, "slot bigint, shard string")
    return without(df.withColumns({"slot": slot_of(F.col(key), size)}).join(F.broadcast(table), "slot", "left"), [key])


def write_shards(df: DataFrame, path: str, key_col: str, shards: list[str], files_per_shard: int | None = None, size: int | None = None) -> None:
    """Write one folder for each shard, each of at most ``files_per_shard`` files of about equal rows.

    By default there are so many that a file holds about ``FILE_BYTES`` of the input, by the plan's estimate.
    Rows of a shard take turns over its files, so a hot key is spread too, and every file is a task of its own.
    """
    if files_per_shard is None:
        stated = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        files_per_shard = max(1, -(-min(stated, 1 << 60) // (FILE_BYTES * len(shards))))
    out = placed(df, key_col, shards, size)
    number, part = fresh(out.columns, "_number"), fresh(out.columns, "_part")
    numbers = F.create_map(*[F.lit(x) for k, s in enumerate(shards) for x in (s, k)])
    spread = out.withColumns({number: numbers[F.col("shard")], part: (F.monotonically_increasing_id() % files_per_shard).cast("int")})
    target = F.col(number) * files_per_shard + F.col(part)
    without(spread.repartitionById(len(shards) * files_per_shard, target), [number, part]).write.partitionBy("shard").parquet(path)


#: The same table, filled turn by turn in a recursion, and the same placement ({n} shards, {m} slots).
ORACLE = """
WITH RECURSIVE s AS (
  SELECT i, CAST('0x' || substr(md5(printf('shard-%02d', i)), 1, 15) AS BIGINT) % {m} AS first,
         CAST('0x' || substr(md5(printf('shard-%02d', i)), 16, 15) AS BIGINT) % ({m} - 1) + 1 AS skip
  FROM range({n}) t(i)
), pref AS (SELECT i, list((first + j * skip) % {m} ORDER BY j) AS slots FROM s, range({m}) r(j) GROUP BY i),
turn AS (
  SELECT 0 AS t, list_transform(range({m}), lambda x: -1) AS tab
  UNION ALL
  SELECT t + 1, list_concat(tab[1:chosen], [t % {n}], tab[chosen + 2:])
  FROM (SELECT t, tab, list_filter(p.slots, lambda x: tab[x + 1] = -1)[1] AS chosen FROM turn JOIN pref p ON p.i = t % {n} WHERE t < {m})
), filled AS (SELECT unnest(tab) AS k, unnest(range({m})) AS slot FROM turn WHERE t = {m})
SELECT doc_id, slot, printf('shard-%02d', k) AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {m} AS slot FROM documents) JOIN filled USING (slot)
"""
