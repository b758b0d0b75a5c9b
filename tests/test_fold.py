"""The fold against a plain dictionary, and one case for each rule of the command semantics."""

import random

import pytest

from foldmill.operators import store
from foldmill.plans import fold
from foldmill.schemas import CMDLOG, STATE


def frame(spark, commands, start=0):
    return spark.createDataFrame([(k + start, *c) for k, c in enumerate(commands)], CMDLOG)


def dict_fold(commands):
    kv, replies = {}, []
    for op, key, value in commands:
        if op == "SET":
            kv[key] = value
        elif op == "MOD" and key in kv:
            kv[key] = value
        elif op == "DEL":
            kv.pop(key, None)
        replies.append((kv.get(key, "NULL") if key else "NULL") if op == "GET" else "OK")
    return kv, replies


def random_log(seed, n=4000, keys=300):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        op = rnd.choice(["SET", "MOD", "DEL", "GET"])
        out.append((op, f"k{int(rnd.random() ** 2 * keys)}", rnd.choice(["", "NULL", "DELETE", "é", str(rnd.random())]) if op in ("SET", "MOD") else None))
    return out


@pytest.mark.parametrize("block", [7, 1000, fold.BLOCK])
def test_random_log(spark, block):
    commands = random_log(block)
    kv, replies = dict_fold(commands)
    log = frame(spark, commands)
    assert dict(map(tuple, fold.state(log).collect())) == kv
    assert [r["reply"] for r in fold.replies(log, block).orderBy("seq").collect()] == replies
    again = fold.state(fold.effective_writes(log, block))
    assert dict(map(tuple, again.collect())) == kv


CASES = {
    "modify a missing key": ([("MOD", "a", "1"), ("GET", "a", None)], "NULL"),
    "modify after delete": ([("SET", "a", "1"), ("DEL", "a", None), ("MOD", "a", "2"), ("GET", "a", None)], "NULL"),
    "modify then set": ([("MOD", "a", "1"), ("SET", "a", "2"), ("GET", "a", None)], "2"),
    "delete a missing key": ([("DEL", "a", None), ("GET", "a", None)], "NULL"),
    "set twice": ([("SET", "a", "1"), ("SET", "a", "2"), ("GET", "a", None)], "2"),
    "empty key": ([("SET", "", "x"), ("GET", "", None)], "NULL"),
    "stored text NULL": ([("SET", "a", "NULL"), ("GET", "a", None)], "NULL"),
    "stored text DELETE": ([("SET", "a", "DELETE"), ("GET", "a", None)], "DELETE"),
    "empty value": ([("SET", "a", ""), ("GET", "a", None)], ""),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    commands, reply = CASES[name]
    assert fold.replies(frame(spark, commands)).orderBy("seq").collect()[-1]["reply"] == reply


def test_documented_batch(spark):
    commands = [("SET", "key1", "value1"), ("SET", "key2", "value2"), ("MOD", "key1", '"ababab"'), ("DEL", "key2", None), ("GET", "key1", None), ("GET", "key2", None)]
    log = frame(spark, commands)
    from foldmill.sources import resp

    (body,) = [r["body"] for r in resp.framed_replies(fold.replies(log)).collect()]
    # Fixed value: the documented reply to this batch.
    assert body == '*6\r\n+OK\r\n+OK\r\n+OK\r\n+OK\r\n$8\r\n"ababab"\r\n$4\r\nNULL\r\n'
    assert list(map(tuple, fold.state(log).collect())) == [("key1", '"ababab"')]


def test_empty_log(spark):
    log = frame(spark, [])
    assert not fold.state(log).collect() and not fold.replies(log).collect()


def test_store_verbs(spark):
    state = spark.createDataFrame([("a", "1"), ("b", ""), ("", "x")], STATE)
    new = spark.createDataFrame([("a", "2"), ("c", "3"), (None, "4"), ("d", None)], "key string, value string")
    assert sorted(map(tuple, store.upsert(state, new).collect())) == [("", "x"), ("a", "2"), ("b", ""), ("c", "3")]
    assert sorted(map(tuple, store.modify(state, new).collect())) == [("", "x"), ("a", "2"), ("b", "")]
    assert sorted(map(tuple, store.delete(state, new).collect())) == [("", "x"), ("b", "")]
    assert store.get(state, "b").first()["value"] == "" and store.get(state, "z").first()["value"] == "NULL"
    assert store.get(state, "").first()["value"] == "NULL"
    assert tuple(store.sizes(state).first()) == (3, 4)


def test_text_order(spark):
    state = spark.createDataFrame([(k, "v") for k in ["é", "a", "Z", "10", "9"]], STATE)
    assert [r["key"] for r in state.orderBy("key").collect()] == ["10", "9", "Z", "a", "é"]


def test_sequential_load(spark):
    """Unique keys, no overwrite: all are found again."""
    log = spark.range(100_000).selectExpr("id as seq", "'SET' as op", "cast(id as string) as key", "concat('value', id) as value")
    probes = spark.range(100_000).selectExpr("cast(id as string) as key")
    out = store.multi_get(fold.state(log), probes)
    assert out.where("not found or value <> concat('value', key)").count() == 0 and out.count() == 100_000
