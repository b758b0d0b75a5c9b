"""A keyed table on storage: runs in Parquet, their Bloom filters, a manifest, levelled compaction.

``apply`` folds a command log over the table and writes one new run of level 0; ``compact`` merges runs as
the level policy asks: level 0, or the oldest run of a level over budget, with the overlapping runs of the next
level, into runs of about the budget each.  A manifest file names the runs of a version.  A new version is
written whole under a temporary name and renamed, so readers see the old one or the new one, and a lost job
leaves nothing that a manifest names; where a store has no atomic rename, two writers at once may both succeed.
Opening a folder finds its latest version.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom
from ..plans import fold
from ..schemas import RUN
from . import runs, store


def meets(run: dict, low: bytes, high: bytes) -> bool:
    return run["min_key"].encode() <= high and low <= run["max_key"].encode()


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, budget_bytes: int = runs.BASE_BYTES) -> None:
        self.spark, self.path, self.budget = spark, path.rstrip("/"), budget_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        versions = sorted(n for n in found if n.startswith("manifest-"))
        self.version, self.batch, self.runs = 0, -1, []
        if versions:
            saved = json.loads(self._read(versions[-1]))
            self.version, self.batch, self.runs = saved["version"], saved["batch"], saved["runs"]

    def _read(self, name: str) -> str:
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()  # one small file
        return rows[0][0]

    def _publish(self, new: list[dict], batch: int) -> None:
        version = self.version + 1
        temporary, final = self._path(f"{self.path}/.{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest-{version:012d}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": version, "batch": batch, "runs": new}).encode()))
        out.close()
        if not self._fs.rename(temporary, final):
            raise RuntimeError(f"version {version} exists: another writer was faster")
        self.version, self.batch, self.runs = version, batch, new

    def _load(self, chosen: list[dict]) -> DataFrame:
        if not chosen:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*[f"{self.path}/{r['name']}" for r in chosen])

    def _number(self) -> int:
        return 1 + max((r["run_seq"] for r in self.runs), default=-1)

    def _store(self, rows: DataFrame, number: int) -> list[dict]:
        """Write rows (key, value, seq, is_deleted, level, part), sorted by part and key, as runs numbered from
        ``number``, one for each ``part``; their manifest entries."""
        name = f"run-{number:012d}-{uuid.uuid4().hex[:8]}"
        tagged = rows.select("key", "value", "seq", "is_deleted", F.col("level").cast("int").alias("level"), (F.col("part") + F.lit(number)).cast("bigint").alias("run_seq"), "part")
        tagged.write.option("parquet.bloom.filter.enabled#key", "true").partitionBy("part").parquet(f"{self.path}/{name}")
        stored = self._fs.listStatus(self._path(f"{self.path}/{name}"))
        if not any(s.getPath().getName().startswith("part=") for s in stored):
            return []
        back = self.spark.read.schema(RUN).parquet(f"{self.path}/{name}/part=*")
        filters = f"bloom-{name[4:]}"
        bloom.save(bloom.packed(bloom.build(back.select("run_seq", "key"), "run_seq"), "run_seq"), f"{self.path}/{filters}")
        stats = runs.stats(back).collect()  # one row a run
        return [{"name": f"{name}/part={r['run_seq'] - number}", "bloom": filters, **r.asDict()} for r in sorted(stats, key=lambda r: r["run_seq"])]

    def _write(self, rows: DataFrame, level: int, pieces: int) -> list[dict]:
        """Write rows as ``pieces`` runs at most, disjoint in key and of about equal rows."""
        ranged = rows.repartitionByRange(pieces, "key").sortWithinPartitions("key")
        return self._store(ranged.withColumns({"part": F.spark_partition_id(), "level": F.lit(level)}), self._number())

    # ------------------------------------------------------------------------------------------- reads

    def scan(self) -> DataFrame:
        """(key, value) of all keys."""
        return runs.merge_read(self._load(self.runs))

    def stored(self) -> DataFrame:
        """All rows of all runs, as they are stored."""
        return self._load(self.runs)

    def catalog(self) -> DataFrame:
        """(level, run_seq, n_rows, n_bytes, min_key, max_key) of each run, from the manifest."""
        columns = "level int, run_seq bigint, n_rows bigint, n_bytes bigint, min_key string, max_key string"
        names = [c.split()[0] for c in columns.split(", ")]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in self.runs], columns)

    def may_hold(self, key: str) -> list[dict]:
        """The runs whose range and whose filter allow the key."""
        raw = key.encode()
        near = [r for r in self.runs if meets(r, raw, raw)]
        if not near:
            return []
        filters = self.spark.read.parquet(*sorted({f"{self.path}/{r['bloom']}" for r in near})).where(F.col("run_seq").isin([r["run_seq"] for r in near]))
        asked = self.spark.createDataFrame([(r["run_seq"], key) for r in near], "run_seq bigint, key string")
        passed = {r["run_seq"] for r in bloom.probe(asked, filters, "run_seq").collect()}  # one row a run
        return [r for r in near if r["run_seq"] in passed]

    def versions(self, key: str) -> DataFrame:
        """The stored rows of one key; only runs that may hold it are opened, with the key as a pushed filter."""
        return self._load(self.may_hold(key)).where(F.col("key") == key)

    def get(self, key: str) -> DataFrame:
        """One row (key, found, value)."""
        return store.get(runs.merge_read(self.versions(key)), key)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key, value) of those ``keys`` (distinct) that the table has."""
        return runs.merge_read(self._load(self.runs).join(keys.select("key"), "key", "left_semi"))

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return store.multi_get(self.lookup(probes.select("key").distinct()), probes)

    # ------------------------------------------------------------------------------------------ writes

    def apply(self, log: DataFrame, batch: int | None = None) -> None:
        """Fold commands (seq, op, key, value) over the table; ``seq`` orders them within the call.

        ``batch`` is kept in the manifest, so that a caller who repeats a batch can tell.
        """
        writes = log.where("op <> 'GET'").select("seq", "op", "key", "value")
        # What a key holds already is a SET before all commands.
        before = self.lookup(writes.select("key").distinct()).select(F.lit(-1).cast("bigint").alias("seq"), F.lit("SET").alias("op"), "key", "value")
        last = fold.latest_writes(before.unionByName(writes)).where("seq >= 0")
        made = self._write(last, 0, 1)
        if made or batch is not None:
            self._publish([*self.runs, *made], self.batch if batch is None else batch)

    def put(self, rows: DataFrame) -> None:
        """Blind writes of (key, value), at most one row a key."""
        self.apply(rows.select(F.lit(0).cast("bigint").alias("seq"), F.lit("SET").alias("op"), "key", "value"))

    def delete(self, keys: DataFrame) -> None:
        self.apply(keys.select(F.lit(0).cast("bigint").alias("seq"), F.lit("DEL").alias("op"), "key", F.lit(None).cast("string").alias("value")).distinct())

    def flush(self, rows: DataFrame) -> None:
        """Store runs that were made elsewhere (columns of ``RUN``; ``run_seq`` counts from 0), all in one job."""
        dealt = rows.repartition("run_seq").sortWithinPartitions("run_seq", "key").withColumnRenamed("run_seq", "part")
        if made := self._store(dealt, self._number()):
            self._publish([*self.runs, *made], self.batch)

    def due(self) -> int | None:
        """The level to compact next: level 0 from four runs on, else the first level over its budget."""
        for level in range(runs.LEVELS - 1):
            own = [r for r in self.runs if r["level"] == level]
            if level == 0 and len(own) >= runs.L0_RUNS or level and sum(r["n_bytes"] for r in own) >= self.budget * runs.RATIO**level:
                return level
        return None

    def inputs(self, level: int) -> list[dict]:
        """All runs of level 0, or the oldest one of another level, and the runs of the next level that they meet."""
        own = [r for r in self.runs if r["level"] == level]
        own = own if level == 0 else [min(own, key=lambda r: r["run_seq"])]
        low, high = min(r["min_key"].encode() for r in own), max(r["max_key"].encode() for r in own)
        return own + [r for r in self.runs if r["level"] == level + 1 and meets(r, low, high)]

    def compact(self) -> bool:
        """One step; false if no level is due.  Tombstones go if no deeper run can hold an older version."""
        level = self.due()
        if level is None:
            return False
        chosen = self.inputs(level)
        low, high = min(r["min_key"].encode() for r in chosen), max(r["max_key"].encode() for r in chosen)
        bottom = not any(r["level"] > level + 1 and meets(r, low, high) for r in self.runs)
        pieces = max(1, -(-sum(r["n_bytes"] for r in chosen) // self.budget))
        made = self._write(runs.compact(self._load(chosen), level, 0, bottom), level + 1, pieces)
        gone = {r["name"] for r in chosen}
        self._publish([r for r in self.runs if r["name"] not in gone] + made, self.batch)
        return True

    def vacuum(self) -> None:
        """Remove runs, filters and manifests that the latest version does not name."""
        live = {r["name"] for r in self.runs}
        kept = {r["name"].split("/")[0] for r in self.runs} | {r["bloom"] for r in self.runs} | {f"manifest-{self.version:012d}"}
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name not in kept:
                self._fs.delete(s.getPath(), True)
            elif name.startswith("run-"):
                for part in self._fs.listStatus(s.getPath()):
                    if part.getPath().getName().startswith("part=") and f"{name}/{part.getPath().getName()}" not in live:
                        self._fs.delete(part.getPath(), True)
