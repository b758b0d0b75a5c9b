"""Runs, merge reads, compaction, pruning and Bloom filters."""

import random

import pytest
from pyspark.sql import functions as F

from foldmill.functions import bloom
from foldmill.operators import runs
from foldmill.plans import fold
from foldmill.schemas import RUN

from .test_fold import dict_fold, frame, random_log


def run_rows(spark, rows):
    return spark.createDataFrame(rows, RUN)


def test_merge_equals_fold(spark):
    commands = random_log(5)
    made = runs.flush(fold.effective_writes(frame(spark, commands)), rows_per_run=300)
    kv, _ = dict_fold(commands)
    assert dict(map(tuple, runs.merge_read(made).collect())) == kv
    once = runs.compact(made, 0, 99)
    assert dict(map(tuple, runs.merge_read(once).collect())) == kv
    assert dict(map(tuple, runs.merge_read(runs.compact(once, 1, 100, bottom=True)).collect())) == kv


def test_newest_of_four_level_zero_runs(spark):
    made = run_rows(spark, [("k", str(v), v, False, 0, v) for v in (1, 2, 3, 4)])
    assert runs.merge_read(made).first()["value"] == "4" and runs.compact(made, 0, 9).first()["value"] == "4"


def test_last_record_and_single_row_run_survive(spark):
    made = run_rows(spark, [("a", "1", 1, False, 0, 1), ("z", "2", 2, False, 0, 1), ("zz", "3", 3, False, 0, 2)])
    assert sorted(r["key"] for r in runs.compact(made, 0, 9).collect()) == ["a", "z", "zz"]


def test_tombstone_hides_older_run(spark):
    made = run_rows(spark, [("k", None, 5, True, 0, 5), ("k", "v", 1, False, 1, 1)])
    assert not runs.merge_read(made).collect() and not runs.merge_read(runs.compact(made, 0, 9)).collect()
    assert runs.compact(made, 0, 9).count() == 1 and runs.compact(made, 1, 9, bottom=True).count() == 0


def test_lower_level_wins_over_later_run(spark):
    made = run_rows(spark, [("k", "new", 5, False, 0, 2), ("k", "old", 4, False, 1, 7)])
    assert runs.merge_read(made).first()["value"] == "new"


def test_layers(spark):
    active = run_rows(spark, [("a", None, 9, True, None, None)])
    older = run_rows(spark, [("a", "1", 1, False, None, None), ("b", "", 2, False, None, None)])
    probes = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    found = {r["key"]: (r["value"], r["layer"]) for r in runs.layered_get(probes, [active, older]).collect()}
    assert found == {"a": ("NULL", -1), "b": ("", 1), "c": ("NULL", -1)}


def test_pick(spark):
    def catalog(rows):
        return spark.createDataFrame(rows, "level int, run_seq long, n_rows long, n_bytes long, min_key string, max_key string")

    four = [(0, k, 1, 10, "a", "m") for k in range(4)]
    big = [(1, 9, 1, 800_000, "b", "c")]
    assert [tuple(r) for r in runs.pick(catalog(four + big)).collect()] == [(0, 4, 40)]
    assert [tuple(r) for r in runs.pick(catalog(four[:3] + big)).collect()] == [(1, 1, 800_000)]
    assert runs.pick(catalog(four[:3])).collect() == []
    assert runs.pick(catalog([])).collect() == []
    assert runs.pick_l0(catalog(four + big)).first()["n_l1"] == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_zone_map_candidates(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aAé一\U0001f600z") for _ in range(rnd.randint(0, 3)))
    catalog = [(0, k, *sorted([word(), word()], key=str.encode)) for k in range(40)]
    probes = sorted({word() for _ in range(100)})
    frame_ = spark.createDataFrame(catalog, "level int, run_seq long, min_key string, max_key string")
    expect = {(p, r) for p in probes for _, r, lo, hi in catalog if lo.encode() <= p.encode() <= hi.encode()}
    for limit in (runs.CATALOG_BYTES, 0):
        found = runs.candidates(spark.createDataFrame([(p,) for p in probes], "key string"), frame_, limit)
        assert sorted((r["key"], r["run_seq"]) for r in found.collect()) == sorted(expect)
    pairs = {(a[1], b[1]) for a in catalog for b in catalog if a[1] < b[1] and a[2].encode() <= b[3].encode() and b[2].encode() <= a[3].encode()}
    plan = runs.overlapping(frame_)
    assert sorted(map(tuple, plan.collect())) == sorted(pairs)
    assert "NestedLoop" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_are_counted_without_listing_them(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aAé一\U0001f600z") for _ in range(rnd.randint(0, 3)))
    catalog = [(0, k, *sorted([word(), word()], key=str.encode)) for k in range(40)] + [(1, 40, None, None)]
    probes = [None, *sorted({word() for _ in range(100)})]
    frame_ = spark.createDataFrame(catalog, "level int, run_seq long, min_key string, max_key string")
    found = runs.counted(spark.createDataFrame([(p,) for p in probes], "key string"), frame_)
    expect = {p: sum(lo is not None and lo.encode() <= p.encode() <= hi.encode() for _, _, lo, hi in catalog) if p is not None else 0 for p in probes}
    assert dict(map(tuple, found.collect())) == expect and found.count() == len(probes)
    assert runs.counted(spark.createDataFrame([("a",)], "key string"), frame_.limit(0)).collect() == [("a", 0)]


def test_zone_map_lists_no_candidates(spark):
    from foldmill import catalog

    plan = catalog.zone_map_prune(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan


def test_keys_with_one_first_character_spread_over_slots(spark):
    """Runs of disjoint ranges whose keys all start alike: a probe meets few runs, not all."""
    catalog = spark.range(1000).selectExpr("1 as level", "id as run_seq", "printf('u%06d', id * 10) as min_key", "printf('u%06d', id * 10 + 9) as max_key")
    cuts = runs.cuts_of(catalog)
    assert len(cuts) == runs.SLOTS - 1
    most = runs.listed(catalog, cuts, ["run_seq"]).groupBy("slot").count().agg(F.max("count")).first()[0]
    assert most <= 16
    found = runs.candidates(spark.range(10_000).selectExpr("printf('u%06d', id) as key"), catalog)
    assert found.count() == 10_000 and found.where("cast(substring(key, 2) as int) div 10 <> run_seq").count() == 0


def test_pairs_of_runs_that_span_all_keys_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(runs, "NEIGHBOURS", 16, raising=False)
    monkeypatch.setattr(runs, "PAIRS", 1000, raising=False)
    catalog = spark.range(150).selectExpr("cast(id % 2 as int) as level", "id as run_seq", "if(id % 3 = 0, 'a', printf('a%03d', id)) as min_key", "'z' as max_key")
    found = runs.overlapping(catalog)
    assert found.count() == found.distinct().count() == 150 * 149 // 2 and found.where("run_a >= run_b").count() == 0
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 4000


def test_rotation_counts_what_a_table_holds(spark):
    """Runs as a table of at most 60 bytes makes them; overwrites count by the difference; tablets are apart."""
    rnd = random.Random(5)
    commands = [(rnd.choice(["SET", "SET", "DEL"]), f"k{rnd.randrange(12)}", "v" * rnd.randrange(9)) for _ in range(400)]
    writes = spark.createDataFrame([(k, op, key, None if op == "DEL" else v) for k, (op, key, v) in enumerate(commands)], "seq bigint, op string, key string, value string")
    found = [r["run_seq"] for r in runs.rotate(writes, 60).orderBy("seq").collect()]
    held, number, expect = {}, 0, []
    for op, key, v in commands:
        size = len(key) + (0 if op == "DEL" else len(v))
        total = sum(held.values())
        if held and (total >= 60 if op == "DEL" else total + size > 60):
            held, number = {}, number + 1
        held[key] = size
        expect.append(number)
    assert found == expect and number > 10
    parts = runs.rotate(writes, 60, tablets=3)
    for t in range(3):
        own = parts.where(F.col("tablet") == t)
        alone = runs.rotate(own.select("seq", "op", "key", "value"), 60)
        assert [tuple(r) for r in own.select("seq", "run_seq").orderBy("seq").collect()] == [tuple(r) for r in alone.select("seq", "run_seq").orderBy("seq").collect()]


def test_bloom(spark, tmp_path):
    keys = spark.range(3000).select((F.col("id") % 3).alias("run_seq"), F.concat(F.lit("k"), "id").alias("key"))
    bloom.save(bloom.packed(bloom.build(keys, "run_seq"), "run_seq"), str(tmp_path / "filters"))
    filters = bloom.load(spark, str(tmp_path / "filters"))
    assert filters.count() == 3
    others = spark.range(3000).select((F.col("id") % 3).alias("run_seq"), F.concat(F.lit("x"), "id").alias("key"))
    passed = []
    for limit in (bloom.BROADCAST_BYTES, 0):
        assert bloom.probe(keys, filters, "run_seq", limit).count() == 3000  # no false negative
        passed.append(sorted(map(tuple, bloom.probe(others, filters, "run_seq", limit).collect())))
    assert passed[0] == passed[1] and len(passed[0]) < 0.03 * 3000
    size = spark.createDataFrame([(0,), (1000,), (10**9,)], "n long").select(bloom.bits(F.col("n")), bloom.hashes(F.col("n"), bloom.bits(F.col("n"))))
    assert [tuple(r) for r in size.collect()] == [(1024, 3), (9585, 6), (1 << 23, 1)]


@pytest.mark.parametrize("group_bytes", [1 << 20, 2000])
def test_runs_that_may_hold_a_probe(spark, tmp_path, monkeypatch, group_bytes):
    """Runs of one shape and of many, wide and narrow, in one file and in several: as range and filter, pair by pair."""
    monkeypatch.setattr(bloom, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(bloom, "PROBES", 150)
    rnd = random.Random(8)
    sizes = [20] * 70 + [rnd.randint(1, 60) for _ in range(20)]
    own = [(r, f"é{k}") for r, n in enumerate(sizes) for k in rnd.sample(range(400) if r % 3 else range(r * 4, r * 4 + 70), n)]
    keys = spark.createDataFrame(own, "run_seq long, key string")
    catalog = runs.stats(keys.selectExpr("0 as level", "run_seq", "key", "cast(null as string) as value"))
    filters = bloom.packed(bloom.build(keys, "run_seq"), "run_seq").localCheckpoint()
    probes = spark.createDataFrame([(None,), ("",), ("z",), *[(f"é{k}",) for k in range(0, 900, 2)]], "key string")
    found = runs.may_hold(probes, keys, catalog, filters, f"file://{tmp_path}/groups")
    hits = bloom.probe(runs.candidates(probes, catalog), filters, "run_seq").collect()
    assert sorted(map(tuple, found.collect())) == sorted((r, k, (r, k) in set(own)) for r, k in hits)
    assert (len(list((tmp_path / "groups").glob("part-*"))) > 1) == (group_bytes == 2000)
    assert runs.may_hold(probes.limit(0), keys, catalog, filters, f"file://{tmp_path}/none").collect() == []
    assert runs.may_hold(probes, keys.limit(0), catalog.limit(0), filters.limit(0), f"file://{tmp_path}/no_runs").collect() == []


def test_found_pairs_meet_no_join(spark):
    from foldmill import catalog

    plan = catalog.bloom_probe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]


def test_sorted_write(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("k"), F.col("id") % 977, F.lit("_"), "id").alias("key"), F.lit("v").alias("value"))
    runs.write_sorted(rows, str(tmp_path / "run"), files=4)
    back = spark.read.parquet(str(tmp_path / "run"))
    assert back.count() == 5000
    plan = back.where("key = 'k3_3'")._jdf.queryExecution().toString()
    assert "EqualTo(key,k3_3)" in plan
