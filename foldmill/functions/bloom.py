"""Bloom filters over DataFrames: sizing, bit positions, packed words, probing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Error rate, most bits, most hashes, and the size for an unusable request.
RATE, MOST_BITS, MOST_HASHES, DEFAULT = 0.01, 1 << 23, 20, (1024, 3)


def bits(n: Column, rate: float = RATE) -> Column:
    """floor(-n ln p / ln(2)^2), at most 2^23."""
    if not 0 < rate < 1:
        return F.lit(DEFAULT[0]).cast("bigint")
    m = F.floor(-n.cast("double") * F.log(F.lit(rate)) / F.pow(F.log(F.lit(2.0)), F.lit(2.0))).cast("bigint")
    return F.when(n > 0, F.least(m, F.lit(MOST_BITS).cast("bigint"))).otherwise(F.lit(DEFAULT[0]).cast("bigint"))


def hashes(n: Column, m: Column, rate: float = RATE) -> Column:
    """floor(m / n ln 2), from 1 to 20."""
    if not 0 < rate < 1:
        return F.lit(DEFAULT[1]).cast("bigint")
    k = F.floor(m.cast("double") / n.cast("double") * F.log(F.lit(2.0))).cast("bigint")
    return F.when(n > 0, F.greatest(F.lit(1).cast("bigint"), F.least(k, F.lit(MOST_HASHES).cast("bigint")))).otherwise(F.lit(DEFAULT[1]).cast("bigint"))


def half(key: Column, start: int) -> Column:
    """48 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), start, 12), 16, 10).cast("bigint")


def hashed(keys: DataFrame) -> DataFrame:
    """``keys`` with both halves of the key's hash, taken once a key."""
    return keys.withColumns({"h1": half(F.col("key"), 1), "h2": half(F.col("key"), 13)})


#: The k positions (h1 + i h2) mod m, from columns h1, h2, m and k.
POSITIONS = "transform(sequence(0L, k - 1), i -> (h1 + i * h2) % m)"
#: Bytes of filters up to which they are broadcast to the probes.
BROADCAST_BYTES = 64 << 20


def build(keys: DataFrame, by: str, rate: float = RATE) -> DataFrame:
    """(by, m, k, word, bits): the filter of each group of distinct (by, key), 64 positions a word.

    Words are combined by partial aggregation, so a group's keys never meet in one task.
    """
    sizes = keys.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("m", bits(F.col("n"), rate)).withColumn("k", hashes(F.col("n"), F.col("m"), rate))
    at = hashed(keys.select(by, "key")).join(sizes, by).select(by, "m", "k", F.explode(F.expr(POSITIONS)).alias("p"))
    return at.groupBy(by, "m", "k", F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))


def packed(filters: DataFrame, by: str) -> DataFrame:
    """(by, m, k, words): each filter as one array of 64-bit words, zero words included; 1 MB at most (2**23 bits)."""
    every = filters.select(by, "m", "k").distinct().select(by, "m", "k", F.explode(F.expr("sequence(0L, (m - 1) div 64)")).alias("word"), F.lit(0).cast("bigint").alias("bits"))
    full = filters.select(by, "m", "k", "word", "bits").unionByName(every).groupBy(by, "m", "k", "word").agg(F.bit_or("bits").alias("bits"))
    return full.groupBy(by, "m", "k").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("x")).select(by, "m", "k", F.col("x.bits").alias("words"))


def save(filters: DataFrame, path: str) -> None:
    """Write packed filters; they can be loaded whole, or the one of a group alone by a pushed filter."""
    filters.write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def probe(candidates: DataFrame, filters: DataFrame, by: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(by, key) of ``candidates`` for which all positions are set in ``filters`` (packed): no false negative.

    Filters of up to ``limit`` bytes by their sizes are broadcast.  Larger ones are taken apart into words
    and joined on (by, word), so that no filter is copied for each candidate.
    """
    total = filters.agg(F.coalesce(F.sum((F.col("m") + 63) / 8 + 64), F.lit(0))).first()[0]
    asked = hashed(candidates.select(by, "key"))
    if total <= limit:
        set_at = F.expr("forall(sequence(0L, k - 1), i -> getbit(words[cast((h1 + i * h2) % m div 64 as int)], cast((h1 + i * h2) % m % 64 as int)) = 1)")
        return asked.join(F.broadcast(filters), by).where(set_at).select(by, "key")
    words = filters.select(by, F.posexplode("words").alias("word", "bits"))
    asked = asked.join(filters.select(by, "m", "k"), by).select(by, "key", "k", F.explode(F.expr(POSITIONS)).alias("p"))
    asked = asked.withColumns({"word": F.expr("cast(p div 64 as int)"), "at": F.expr("cast(p % 64 as int)")})
    found = asked.join(words, [by, "word"]).where("getbit(bits, at) = 1")
    return found.groupBy(by, "key", "k").agg(F.count(F.lit(1)).alias("hit")).where("hit = k").select(by, "key")


#: Bytes of filters that a worker holds at once, of a filter's bits while they are turned, and probes of one task and step.
GROUP_BYTES, TURN_BYTES, PROBES, STEP = 16 << 20, 32 << 20, 16_384, 2048


class Sliced:
    """Filters of runs (run, m, k, min_key, max_key, words) by bit: for each position, which runs have it set.

    Runs with the same m and k share a probe's positions, so one AND of k rows of bits answers for all of them.
    """

    def __init__(self, table: pa.Table) -> None:
        lows, highs = ([x.encode() for x in table.column(c).to_pylist()] for c in ("min_key", "max_key"))
        self.bounds = sorted({*lows, *highs})
        place = {b: 2 * i + 1 for i, b in enumerate(self.bounds)}
        self.runs = table.column("run").to_numpy()
        self.low, self.high = (np.array([place[b] for b in x], np.int64) for x in (lows, highs))
        self.index = {int(r): i for i, r in enumerate(self.runs)}
        shapes: dict[tuple[int, int], list[int]] = {}
        for i, shape in enumerate(zip(table.column("m").to_pylist(), table.column("k").to_pylist())):
            shapes.setdefault(shape, []).append(i)
        words = table.column("words").combine_chunks()
        starts, flat = words.offsets.to_numpy(), words.values.to_numpy()
        self.parts = []
        for (m, k), own in sorted(shapes.items()):
            step = max(8, TURN_BYTES // m // 8 * 8)
            turned = []
            for at in range(0, len(own), step):
                bits = np.stack([np.unpackbits(flat[starts[i] : starts[i + 1]].view(np.uint8), bitorder="little")[:m] for i in own[at : at + step]])
                turned.append(np.packbits(bits.T, axis=1, bitorder="little"))
            bits = np.concatenate(turned, axis=1)
            if bits.shape[1] > 4:
                bits = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)
            wide = bits.itemsize * 8
            own = np.array(own)
            edges = np.arange(0, len(own), wide)
            self.parts.append((m, k, own, bits, np.minimum.reduceat(self.low[own], edges), np.maximum.reduceat(self.high[own], edges)))

    def places(self, keys: list[str]) -> np.ndarray:
        """Where each key lies among the runs' bounds: odd on a bound, even between two."""
        from bisect import bisect_left

        out = np.empty(len(keys), np.int64)
        for n, key in enumerate(keys):
            raw = key.encode()
            i = bisect_left(self.bounds, raw)
            out[n] = 2 * i + (i < len(self.bounds) and self.bounds[i] == raw)
        return out

    def hits(self, place: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, run) numbers whose range and filter allow the probe."""
        probes, found = [], []
        for m, k, own, bits, low, high in self.parts:
            near = np.flatnonzero((low <= place.max()) & (high >= place.min()))
            if not len(near):
                continue
            first = near[0]
            view = bits[:, first : near[-1] + 1]
            both = view[h1 % m]
            for i in range(1, k):
                both &= view[(h1 + i * h2) % m]
            row, column = np.nonzero(both)
            at, bit = np.nonzero(np.unpackbits(both[row, column].view(np.uint8).reshape(len(row), bits.itemsize), axis=1, bitorder="little"))
            row, run = row[at], own[(first + column[at]) * bits.itemsize * 8 + bit]
            inside = (self.low[run] <= place[row]) & (place[row] <= self.high[run])
            probes.append(row[inside])
            found.append(run[inside])
        return (np.concatenate(probes), np.concatenate(found)) if probes else (np.empty(0, int), np.empty(0, int))


_last: tuple[str, Sliced] | None = None


def sliced(path: str) -> Sliced:
    """The filters of one file; a worker keeps the last one."""
    global _last
    if _last is None or _last[0] != path:
        import pyarrow.parquet as pq
        from pyarrow import fs

        _last = None
        store, file = fs.FileSystem.from_uri(path)
        _last = (path, Sliced(pq.ParquetFile(store.open_input_file(file)).read()))
    return _last[1]


def store(filters: DataFrame, catalog: DataFrame, by: str, path: str) -> DataFrame:
    """Write ``filters`` (packed) with the key ranges of ``catalog`` in files of about ``GROUP_BYTES``, each a range of
    lowest keys; returns (level, run_seq, min_key, max_key): each file as if it were a run, its address as the number."""
    size = filters.agg(F.coalesce(F.sum((F.col("m") + 63) / 8 + 64), F.lit(0))).first()[0]
    files = max(1, -(-int(size) // GROUP_BYTES))
    ranged = filters.join(catalog.where("min_key is not null").select(by, "min_key", "max_key"), by).withColumnRenamed(by, "run")
    ranged.repartitionByRange(files, "min_key", "run").sortWithinPartitions("min_key", "run").write.parquet(path)
    back = filters.sparkSession.read.schema("run bigint, min_key string, max_key string").parquet(path)
    groups = back.groupBy(F.input_file_name().alias("run_seq")).agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))
    return groups.withColumn("level", F.lit(0))


def probe_stored(asked: DataFrame, by: str) -> DataFrame:
    """(by, key, present) for each of ``asked`` (file, key, held) and run of the file whose range and filter allow the
    key; ``held`` are the runs of the file that have it.

    Work is a few words for 64 runs and probe, and what is found; a worker holds one file's filters and ``STEP`` probes.
    """
    n = max(1, -(-asked.count() // PROBES))
    dealt = hashed(asked.repartitionByRange(n, "file", "key").sortWithinPartitions("file", "key")).select("file", "key", "h1", "h2", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(0).to_pylist()
            at = 0
            while at < len(files):
                end = min(at + STEP, len(files))
                while files[end - 1] != files[at]:  # sorted by file
                    end -= 1
                own, part = sliced(files[at]), batch.slice(at, end - at)
                keys, at = part.column(1), end
                probes, found = own.hits(own.places(keys.to_pylist()), part.column(2).to_numpy(), part.column(3).to_numpy())
                held = [n * len(own.runs) + own.index[r] for n, rs in enumerate(part.column(4).to_pylist()) for r in rs or ()]
                present = np.isin(probes * len(own.runs) + found, np.array(held, np.int64))
                for low in range(0, len(found), 200_000):
                    some = slice(low, low + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(own.runs[found[some]], pa.int64()), keys.take(pa.array(probes[some])), pa.array(present[some])], names=[by, "key", "present"])

    return dealt.mapInArrow(run, f"{by} bigint, key string, present boolean")
