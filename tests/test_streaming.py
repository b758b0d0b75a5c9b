"""The stateful stream against the dictionary fold, over several micro-batches, with a late command."""

import pytest

from foldmill.schemas import CMDLOG
from foldmill.operators.table import KeyedTable
from foldmill.streaming.state import fold_into_table, run_available

from .test_fold import dict_fold, frame, random_log


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_stream(spark, tmp_path, rocksdb):
    commands = random_log(21, n=600, keys=40)
    for k in range(3):
        frame(spark, commands[k * 200 : (k + 1) * 200], k * 200).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(5, "SET", commands[5][1], "late")], CMDLOG)
    source = spark.readStream.schema(CMDLOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_available(source, str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    last = {}
    for r in sorted(out, key=lambda r: r["seq"]):
        last[r["key"]] = r["value"]
    kv, replies = dict_fold(commands)
    assert {k: v for k, v in last.items() if v is not None} == kv
    got = {r["seq"]: r["got"] for r in out if r["op"] == "GET"}
    assert all(("NULL" if got[k] is None else got[k]) == replies[k] for k, c in enumerate(commands) if c[0] == "GET")
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = run_available(source, str(tmp_path / "out2"), str(tmp_path / "cp2")).where("late").collect()
    assert all(r["op"] == "SET" and r["value"] != "late" for r in again if r["seq"] == 5)


def test_state_comes_with_the_rows(spark, tmp_path):
    """No call to the JVM for each key's state."""
    from foldmill.streaming.state import fold_stream

    frame(spark, random_log(23, n=20)).write.parquet(str(tmp_path / "in"))
    plan = fold_stream(spark.readStream.schema(CMDLOG).parquet(str(tmp_path / "in")))._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan


def test_stream_into_a_table(spark, tmp_path):
    """Micro-batches folded over a stored table, with compaction between them; run again after more input."""
    commands = random_log(22, n=900, keys=40)
    for k in range(6):
        frame(spark, commands[k * 150 : (k + 1) * 150], k * 150).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 3:
            first = k
            source = spark.readStream.schema(CMDLOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            fold_into_table(source, f"file://{tmp_path}/table", str(tmp_path / "replies"), str(tmp_path / "cp"), 200)
            assert KeyedTable(spark, f"file://{tmp_path}/table").batch == first
    fold_into_table(source, f"file://{tmp_path}/table", str(tmp_path / "replies"), str(tmp_path / "cp"), 200)
    kv, replies = dict_fold(commands)
    table = KeyedTable(spark, f"file://{tmp_path}/table")
    assert dict(map(tuple, table.scan().collect())) == kv
    assert max(r["level"] for r in table.runs) >= 1 and sum(r["level"] == 0 for r in table.runs) < 4
    found = spark.read.parquet(str(tmp_path / "replies")).orderBy("seq").collect()
    assert [r["reply"] for r in found] == replies
