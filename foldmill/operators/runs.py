"""Sorted immutable runs: flush, catalog, merge read, pruning, compaction.

A run is a set of rows (key, value, seq, is_deleted, level, run_seq) with one row a key, written sorted by
key.  Reads take the newest version of each key over all runs and then drop tombstones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bloom

#: Fixed values of the level policy.
BASE_BYTES, RATIO, LEVELS, L0_RUNS = 262_144, 3, 7, 4


def flush(writes: DataFrame, rows_per_run: int = 1000, l0_runs: int = L0_RUNS) -> DataFrame:
    """Runs of effective writes (seq, op, key, value), cut by sequence number; newest write a key and run.

    The last ``l0_runs`` runs are level 0, the older ones level 1.
    """
    run = F.expr(f"seq div {rows_per_run}")
    rows = writes.select("key", "value", "seq", (F.col("op") == "DEL").alias("is_deleted"), run.alias("run_seq"))
    best = rows.groupBy("run_seq", "key").agg(F.max(F.struct("seq", "value", "is_deleted")).alias("x"))
    last = rows.agg(F.max("run_seq")).scalar()
    level = F.when(F.col("run_seq") > last - l0_runs, 0).otherwise(1)
    return best.select("key", "x.value", "x.seq", "x.is_deleted", level.cast("int").alias("level"), "run_seq")


def runs_by_bytes(writes: DataFrame, budget: int = BASE_BYTES, block: int = 4096) -> DataFrame:
    """``writes`` (seq, key, value) with ``run_seq``: a new run starts each ``budget`` bytes of the log.

    A prefix sum in two levels: sums of blocks of ``seq``, a running sum over blocks, windows in blocks.
    """
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    rows = writes.withColumns({"size": size.cast("bigint"), "block": F.expr(f"seq div {block}")})
    sums = rows.groupBy("block").agg(F.sum("size").alias("bytes")).withColumn("wide", F.expr("block div 65536"))
    # Blocks of blocks keep even this running sum out of one task; only their few sums meet in one.
    tops = sums.groupBy("wide").agg(F.sum("bytes").alias("bytes"))
    past = Window.orderBy("wide").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("wide", F.coalesce(F.sum("bytes").over(past), F.lit(0)).alias("top"))
    past = Window.partitionBy("wide").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("low", F.coalesce(F.sum("bytes").over(past), F.lit(0))).join(tops, "wide").select("block", (F.col("low") + F.col("top")).alias("before"))
    past = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("inner", F.coalesce(F.sum("size").over(past), F.lit(0)))
    return inner.join(before, "block").select(*writes.columns, F.expr(f"(before + inner) div {budget}").alias("run_seq"))


def rotate(writes: DataFrame, budget: int = BASE_BYTES, tablets: int = 1) -> DataFrame:
    """``writes`` (seq, op, key, value) with ``tablet`` and ``run_seq``, as a table in memory fills and is frozen.

    A table counts the bytes of its keys and newest values; an overwrite counts by the difference, a deletion as a
    key without a value.  It is frozen before a write that would take it over ``budget`` (a deletion: once it
    is full).  Where one run ends decides where the next one does, so this is one pass in order of ``seq`` that
    holds one table, at most ``budget`` bytes.  ``tablets`` parts of the key space have tables of their own
    and are passed over side by side.
    """
    tablet = F.pmod(F.xxhash64("key"), F.lit(tablets)).cast("int")
    rows = writes.select("seq", "op", "key", "value", tablet.alias("tablet")).repartitionById(tablets, "tablet").sortWithinPartitions("tablet", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, total, sizes = None, 0, 0, {}
        for batch in batches:
            out = []
            ops, keys, values, parts = (batch.column(k).to_pylist() for k in (1, 2, 3, 4))
            for op, key, value, part in zip(ops, keys, values, parts):
                if part != now:
                    now, number, total, sizes = part, 0, 0, {}
                size = len(key.encode()) + (len(value.encode()) if value and op != "DEL" else 0)
                if sizes and (total >= budget if op == "DEL" else total + size > budget):
                    number, total, sizes = number + 1, 0, {}
                total += size - sizes.get(key, 0)
                sizes[key] = size
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "run_seq"])

    return rows.mapInArrow(run, "seq bigint, op string, key string, value string, tablet int, run_seq bigint")


#: Bytes that a written file holds, about.
FILE_BYTES = 128 << 20


def write_sorted(rows: DataFrame, path: str, files: int | None = None, bloom_keys: int = 200_000) -> None:
    """Write rows in ranges of key, sorted, with Parquet statistics and a Bloom filter on the key.

    By default there are as many files as the rows' bytes ask for.
    """
    if files is None:
        size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 16
        files = max(1, -(-(rows.agg(F.sum(size)).first()[0] or 0) // FILE_BYTES))
    ranged = rows.repartitionByRange(files, "key").sortWithinPartitions("key")
    ranged.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(bloom_keys)).parquet(path)


def stats(runs: DataFrame) -> DataFrame:
    """The catalog: (level, run_seq, n_rows, n_bytes, min_key, max_key)."""
    n_bytes = F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("bigint")
    return runs.groupBy("level", "run_seq").agg(
        F.count(F.lit(1)).alias("n_rows"), n_bytes.alias("n_bytes"), F.min("key").alias("min_key"), F.max("key").alias("max_key")
    )


def newest(runs: DataFrame) -> DataFrame:
    """The newest version of each key over all runs (lowest level, then latest run), tombstones included."""
    best = runs.groupBy("key").agg(F.max(F.struct((-F.col("level")).alias("up"), "run_seq", "seq", "value", "is_deleted", "level")).alias("x"))
    return best.select("key", "x.value", "x.seq", "x.is_deleted", "x.level", "x.run_seq")


def merge_read(runs: DataFrame) -> DataFrame:
    return newest(runs).where("not is_deleted").select("key", "value")


def layered_get(probes: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """(key, value, layer): the first layer that has the key decides; a tombstone there is a miss."""
    each = [layer.select("key", "value", "is_deleted", F.lit(k).alias("layer")) for k, layer in enumerate(layers)]
    rows = each[0]
    for x in each[1:]:
        rows = rows.unionByName(x)
    wanted = rows.join(probes.select("key").distinct(), "key", "left_semi")
    best = wanted.groupBy("key").agg(F.min(F.struct("layer", "is_deleted", "value")).alias("x"))
    hit = probes.join(best, "key", "left")
    alive = F.col("x.is_deleted") == F.lit(False)
    return hit.select("key", F.coalesce(F.when(alive, F.col("x.value")), F.lit("NULL")).alias("value"), F.coalesce(F.when(alive, F.col("x.layer")), F.lit(-1)).cast("bigint").alias("layer"))


#: Slots into which keys are cut to find the runs that may hold them, and bounds that are looked at to cut them.
SLOTS, BOUNDS = 256, 4096
#: Estimated size of a catalog, listed by slot, up to which it is broadcast.
CATALOG_BYTES = 64 << 20


def slot_of(key: Column, cuts: list[str]) -> Column:
    """The number of ``cuts`` (sorted) that are not after the key: 16 comparisons, then 16 more."""
    step = max(1, int(len(cuts) ** 0.5))
    tops = F.array(*[F.lit(c) for c in cuts[step - 1 :: step]]) if cuts else F.array().cast("array<string>")
    every = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<string>")
    before = F.size(F.filter(tops, lambda c: c <= key)) * step
    return before + F.size(F.filter(F.slice(every, before + 1, F.lit(step)), lambda c: c <= key))


def even_cuts(keys: DataFrame, slots: int = SLOTS, bounds: int = BOUNDS) -> list[str]:
    """Keys that cut ``keys`` (c) into about equal parts, from ``bounds`` of them at most (by hash).

    Any cuts give the same results; even ones make their search cheap.
    """
    some = sorted((r["c"] for r in keys.where("c is not null").distinct().orderBy(F.xxhash64("c"), "c").limit(bounds).collect()), key=str.encode)
    return [some[k * len(some) // slots] for k in range(1, slots)] if len(some) >= slots else some


def cuts_of(catalog: DataFrame, slots: int = SLOTS, bounds: int = BOUNDS) -> list[str]:
    """Keys that cut the runs' bounds into about equal parts."""
    return even_cuts(catalog.select(F.explode(F.array("min_key", "max_key")).alias("c")), slots, bounds)


def listed(catalog: DataFrame, cuts: list[str], columns: list[str]) -> DataFrame:
    """``catalog`` once for each slot that a run's range spans, with ``slot`` and ``first_slot``."""
    low, high = slot_of(F.col("min_key"), cuts), slot_of(F.col("max_key"), cuts)
    return catalog.withColumn("first_slot", low).select(*columns, "first_slot", F.explode(F.sequence("first_slot", high)).alias("slot"))


def candidates(probes: DataFrame, catalog: DataFrame, limit: int = CATALOG_BYTES) -> DataFrame:
    """(key, level, run_seq): runs whose key range holds the probe.

    A range join as an equality join: the key space is cut at bounds of the runs themselves, a run is listed
    under each slot it spans, and the range is tested within a slot - so what meets is what matches, but for
    the two slots at a run's ends.  A catalog (one row a run) of up to ``limit`` bytes is broadcast.
    """
    cuts = cuts_of(catalog)
    spans = listed(catalog, cuts, ["level", "run_seq", "min_key", "max_key"])
    size = spans.agg(F.coalesce(F.sum(F.octet_length("min_key") + F.octet_length("max_key") + 64), F.lit(0))).first()[0]
    asked = probes.select("key", slot_of(F.col("key"), cuts).alias("slot"))
    return asked.join(F.broadcast(spans) if size <= limit else spans, "slot").where("key between min_key and max_key").select("key", "level", "run_seq")


def may_hold(probes: DataFrame, keys: DataFrame, catalog: DataFrame, filters: DataFrame, path: str) -> DataFrame:
    """(run_seq, key, present) of the runs whose range and filter (packed, written to ``path``) allow a probe, and
    whether the run's ``keys`` (run_seq, key) have it.

    Filters are dealt into groups; probes meet the groups whose ranges hold them, and all runs of a group at once.
    The runs that have a probe are joined to it before, not to what is found: false positives are never shuffled.
    """
    groups = bloom.store(filters, catalog, "run_seq", path)
    asked = candidates(probes.where("key is not null"), groups).select("key", F.col("run_seq").alias("file"))
    placed = catalog.sparkSession.read.schema("run bigint").parquet(path).select(F.col("run").alias("run_seq"), F.input_file_name().alias("file"))
    held = keys.join(probes.select("key").distinct(), "key", "left_semi").join(placed, "run_seq")
    held = held.groupBy("file", "key").agg(F.collect_list("run_seq").alias("held"))
    return bloom.probe_stored(asked.join(held, ["file", "key"], "left").select("file", "key", "held"), "run_seq")


def summed(points: DataFrame) -> DataFrame:
    """``points`` (key, kind, run_seq, level, add) with ``upto``, the sum of ``add`` up to each in that order.

    Slots of the key space are summed alone; what lies before a slot is the sum of few rows.
    """
    cuts = even_cuts(points.select(F.col("key").alias("c")))
    rows = points.withColumn("slot", slot_of(F.col("key"), cuts))
    past = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one row a slot
    tops = rows.groupBy("slot").agg(F.sum("add").alias("own")).select("slot", F.coalesce(F.sum("own").over(past), F.lit(0)).alias("top"))
    inner = Window.partitionBy("slot").orderBy("key", "kind", "run_seq", "level").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("inner", F.sum("add").over(inner)).join(F.broadcast(tops), "slot").withColumn("upto", F.col("top") + F.col("inner"))


def bounds_of(catalog: DataFrame, end: int) -> DataFrame:
    """The runs' lowest keys (kind 0), which add 1, and highest keys (kind 2), which add ``end``."""
    known = catalog.where("min_key is not null").select("run_seq", F.col("level").cast("int").alias("level"), "min_key", "max_key")
    low = known.select(F.col("min_key").alias("key"), F.lit(0).alias("kind"), "run_seq", "level", F.lit(1).alias("add"))
    return low.unionByName(known.select(F.col("max_key").alias("key"), F.lit(2).alias("kind"), "run_seq", "level", F.lit(end).alias("add")))


def counted(probes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key, n_runs): how many runs' key ranges hold each probe; what ``candidates`` would list is not listed.

    In order of key, a run counts from its lowest key on and no longer after its highest: one running sum.
    """
    asked = probes.select("key", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("run_seq"), F.lit(None).cast("int").alias("level"), F.lit(0).alias("add"))
    return summed(bounds_of(catalog, -1).unionByName(asked)).where("kind = 1").select("key", F.col("upto").alias("n_runs"))


#: Neighbours of a run that are listed from one row, and pairs that one task lists, about.
NEIGHBOURS, PAIRS = 4096, 2_000_000


def overlapping(catalog: DataFrame) -> DataFrame:
    """(run_a, run_b): pairs of runs, a before b, whose key ranges meet; for planning, on the catalog only.

    In order of lowest key, the later runs that meet a run are its next neighbours, those which start up to its highest
    key: each pair is listed once, and nothing else is.  Neighbours are dealt in pieces, as runs that span all keys
    meet all others.
    """
    at = summed(bounds_of(catalog, 0))
    first = at.where("kind = 0").select("run_seq", "level", F.col("upto").alias("place"))
    last = at.where("kind = 2").select("run_seq", "level", F.col("upto").alias("last"))
    spans = first.join(last, ["run_seq", "level"]).where("last > place").select("run_seq", "place", "last")
    n_runs, n_pairs = first.count(), spans.agg(F.coalesce(F.sum(F.expr("last - place")), F.lit(0))).first()[0]
    pieces = spans.select("run_seq", "last", F.explode(F.expr(f"sequence(place + 1, last, {NEIGHBOURS}L)")).alias("low"))
    pieces = pieces.repartition(max(1, -(-n_pairs // PAIRS)), "low", "run_seq")
    each = pieces.select("run_seq", F.explode(F.expr(f"sequence(low, least(last, low + {NEIGHBOURS - 1}))")).alias("place"))
    other = first.select("place", F.col("run_seq").alias("other"))
    met = each.join(F.broadcast(other) if n_runs * 16 <= CATALOG_BYTES else other, "place").where("run_seq <> other")
    return met.select(F.least("run_seq", "other").alias("run_a"), F.greatest("run_seq", "other").alias("run_b"))


def budgets(spark: SparkSession) -> DataFrame:
    """(level, budget_bytes)."""
    return spark.range(LEVELS).select(F.col("id").alias("level"), (F.lit(BASE_BYTES) * F.pow(F.lit(float(RATIO)), F.col("id"))).cast("bigint").alias("budget_bytes"))


def pick(catalog: DataFrame) -> DataFrame:
    """At most one row (level, n_runs, n_bytes): level 0 with four runs or more, else the first level over budget."""
    levels = catalog.groupBy(F.col("level").cast("bigint").alias("level")).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_bytes").cast("bigint").alias("n_bytes"))
    due = levels.join(F.broadcast(budgets(catalog.sparkSession)), "level")
    due = due.where(f"(level = 0 and n_runs >= {L0_RUNS}) or (level >= 1 and n_bytes >= budget_bytes)")
    return due.orderBy("level").limit(1).select("level", "n_runs", "n_bytes")


def pick_l0(catalog: DataFrame) -> DataFrame:
    """One row: the key range and runs of level 0, and the runs of level 1 that overlap the range."""
    zero = catalog.where("level = 0").agg(
        F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.count(F.lit(1)).alias("n_l0"), F.min("run_seq").alias("first_run"), F.max("run_seq").alias("last_run")
    )
    low, high = zero.select("min_key").scalar(), zero.select("max_key").scalar()
    met = catalog.where((F.col("level") == 1) & (F.col("min_key") <= high) & (low <= F.col("max_key"))).agg(F.count(F.lit(1)))
    return zero.withColumn("n_l1", met.scalar())


def candidate(catalog: DataFrame) -> DataFrame:
    """(level, run_seq): the inputs of the next compaction; empty if none is due.

    Level 0 goes whole, as its runs overlap; of a deeper level over budget, its oldest run.  With them go the
    runs of the next level whose keys meet theirs, and no others.
    """
    due = pick(catalog).select(F.col("level").cast("int").alias("due"))
    own = catalog.join(F.broadcast(due), F.col("level") == F.col("due"))
    oldest = own.agg(F.min("run_seq").alias("oldest"))
    own = own.crossJoin(F.broadcast(oldest)).where("level = 0 or run_seq = oldest")  # one row on the right
    bounds = own.groupBy("level").agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"))
    met = catalog.join(F.broadcast(bounds.withColumnRenamed("level", "due")), F.col("level") == F.col("due") + 1).where("min_key <= high and low <= max_key")
    return own.select("level", "run_seq").unionByName(met.select("level", "run_seq"))


def compact(runs: DataFrame, level: int, target_run: int, bottom: bool = False) -> DataFrame:
    """One run of the next level (the deepest level stays): the newest version of each key.

    At the bottom (``bottom``, or the deepest level) no older version can lie below, so tombstones go.
    """
    target = min(level + 1, LEVELS - 1)
    merged = newest(runs)
    merged = merged.where("not is_deleted") if bottom or target == LEVELS - 1 else merged
    return merged.select("key", "value", "seq", "is_deleted", F.lit(target).cast("int").alias("level"), F.lit(target_run).cast("bigint").alias("run_seq"))
