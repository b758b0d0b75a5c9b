"""The stored table against a dictionary, over many versions, compactions and reopenings."""

import pytest

from foldmill.operators.runs import L0_RUNS
from foldmill.operators.table import KeyedTable

from .test_fold import dict_fold, frame, random_log


def test_table(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    commands = random_log(31, n=700, keys=60)
    table, steps = KeyedTable(spark, path, budget_bytes=20), 0
    for k in range(7):
        table.apply(frame(spark, commands[k * 100 : (k + 1) * 100], 5))
        kv, _ = dict_fold(commands[: (k + 1) * 100])
        assert dict(map(tuple, table.scan().collect())) == kv
        while table.compact():
            steps += 1
            assert dict(map(tuple, table.scan().collect())) == kv
        assert sum(r["level"] == 0 for r in table.runs) < L0_RUNS
        table = KeyedTable(spark, path, budget_bytes=20)
    assert steps >= 2
    table.vacuum()
    assert dict(map(tuple, KeyedTable(spark, path).scan().collect())) == kv
    key = next(iter(kv))
    assert table.get(key).first()["value"] == kv[key] and table.get("absent").first()["found"] is False
    table.delete(spark.createDataFrame([(key,), ("absent",)], "key string"))
    table.put(spark.createDataFrame([("new", "")], "key string, value string"))
    kv = {k: v for k, v in kv.items() if k != key} | {"new": ""}
    assert dict(map(tuple, table.scan().collect())) == kv


def test_empty_table_and_lost_race(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    a, b = KeyedTable(spark, path), KeyedTable(spark, path)
    assert a.scan().collect() == [] and a.due() is None and not a.compact()
    a.apply(frame(spark, [("GET", "x", None)]))
    assert a.version == 0
    a.put(spark.createDataFrame([("k", "1")], "key string, value string"))
    with pytest.raises(RuntimeError):
        b.put(spark.createDataFrame([("k", "2")], "key string, value string"))
    assert KeyedTable(spark, path).get("k").first()["value"] == "1"


def test_compaction_takes_one_run_and_its_overlaps(spark, tmp_path):
    """Of a level over budget one run goes down, cut into runs of about the budget; the others stay as they are."""
    path = f"file://{tmp_path}/table"
    table = KeyedTable(spark, path, budget_bytes=4000)
    log = lambda a, b: spark.range(a, b).selectExpr("id as seq", "'SET' as op", "printf('k%06d', id) as key", "repeat('v', 20) as value")
    for k in range(4):
        table.apply(log(k * 200, k * 200 + 200))
    assert table.due() == 0 and table.compact()
    assert len(table.runs) > 4 and {r["level"] for r in table.runs} == {1} and max(r["n_bytes"] for r in table.runs) < 8000
    spans = sorted((r["min_key"], r["max_key"]) for r in table.runs)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert table.due() == 1
    oldest, others = min(table.runs, key=lambda r: r["run_seq"]), {r["name"] for r in table.runs}
    assert table.compact()
    assert others - {r["name"] for r in table.runs} == {oldest["name"]}
    assert {r["level"] for r in table.runs if r["name"] not in others} == {2}
    assert table.scan().count() == 800
    before = len(table.runs)
    table.vacuum()
    again = KeyedTable(spark, path, budget_bytes=4000)
    assert len(again.runs) == before and again.scan().count() == 800 and again.get("k000333").first()["found"]


def test_filters_pass_by_runs_without_the_key(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    table = KeyedTable(spark, path)
    for k in range(3):
        table.put(spark.range(300).selectExpr(f"concat('k', id * 3 + {k}) as key", f"'v{k}' as value"))
    held = [len(KeyedTable(spark, path).may_hold(f"k{n}")) for n in (150, 151, 152)]
    assert all(1 <= n <= 3 for n in held) and sum(held) <= 4
    assert [table.get(f"k{n}").first()["value"] for n in (150, 151, 152)] == ["v0", "v1", "v2"]
    plan = table.versions("k150")._jdf.queryExecution().toString()
    assert "EqualTo(key,k150)" in plan
