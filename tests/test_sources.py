"""Binary and text logs, and the length-prefixed text protocol."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldmill.functions import text
from foldmill.plans import fold
from foldmill.schemas import RESP_IN
from foldmill.sources import resp, textlog, wal

from .test_fold import dict_fold, frame, random_log

# Fixed value: the documented commands in the log's format.
FIXED = bytes.fromhex("00040000006b6579310600000076616c756531" "00040000006b6579320600000076616c756532" "02040000006b65793108000000226162616261622203040000006b65793200000000")
COMMANDS = [("SET", "key1", "value1"), ("SET", "key2", "value2"), ("MOD", "key1", '"ababab"'), ("DEL", "key2", None)]


def test_fixed_bytes():
    assert b"".join(wal.encode(*c) for c in COMMANDS) == FIXED
    assert [x[1:] for x in wal.decode(FIXED)] == COMMANDS


@pytest.mark.parametrize("cut", range(len(FIXED)))
def test_torn_tail(cut):
    ends, at = [], 0
    for c in COMMANDS:
        at += len(wal.encode(*c))
        ends.append(at)
    assert [x[1:] for x in wal.decode(FIXED[:cut])] == COMMANDS[: sum(e <= cut for e in ends)]


def test_unknown_opcode_is_skipped():
    assert [x[1] for x in wal.decode(b"\x07" + FIXED[1:])] == ["SET", "MOD", "DEL"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["SET", "MOD", "DEL"]), st.text(max_size=20), st.text(max_size=20)), max_size=20))
def test_record_round_trip(commands):
    commands = [(op, k, None if op == "DEL" else v) for op, k, v in commands]
    assert [x[1:] for x in wal.decode(b"".join(wal.encode(*c) for c in commands))] == commands


def test_log_folder(spark, tmp_path):
    commands = random_log(9, n=1500)
    log = frame(spark, commands)
    path = f"file://{tmp_path}/log"
    wal.write(log, path, segments=3)
    assert not list((tmp_path / "log").glob("_*"))
    back = wal.read(spark, path)
    assert [tuple(r)[1:] for r in back.orderBy("seq").collect()] == [c for c in commands if c[0] != "GET"]
    assert dict(map(tuple, fold.state(back).collect())) == dict_fold(commands)[0]


def test_segments_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """A segment cut into several partitions, at the marks of its index; without an index, in one."""
    commands = [c for c in random_log(12, n=4000) if c[0] != "GET"]
    log, path = frame(spark, commands), f"file://{tmp_path}/log"
    monkeypatch.setattr(wal, "MARK_BYTES", 1000)
    writer = wal.LogWriter(path)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    table = log.select("seq", "op", "key", "value").toArrow()
    writer.commit([writer.write(iter(b for b in table.to_batches(max_chunksize=50)))])
    monkeypatch.undo()
    assert sorted(f.name for f in (tmp_path / "log").iterdir()) == ["segment-00000000.idx", "segment-00000000.log"]
    for split in (700, 5000, 1 << 30):
        back = wal.read(spark, path, split)
        assert [tuple(r) for r in back.orderBy("seq").collect()] == [(k, *c) for k, c in enumerate(commands)]
        size = (tmp_path / "log" / "segment-00000000.log").stat().st_size
        assert back.rdd.getNumPartitions() == -(-size // split) and (split > 5000 or back.rdd.getNumPartitions() > 4)
    (tmp_path / "log" / "segment-00000000.idx").unlink()
    whole = (tmp_path / "log" / "segment-00000000.log").read_bytes()
    (tmp_path / "log" / "segment-00000000.log").write_bytes(whole[:-3])
    back = wal.read(spark, path, 700)
    assert back.rdd.getNumPartitions() == 1 and [tuple(r)[1:] for r in back.orderBy("seq").collect()] == commands[:-1]


def test_records_larger_than_a_piece(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    commands = [("SET", "a" * 3000, "x" * 200_000), ("DEL", "b", None), ("SET", "c", "é" * 100_000), ("MOD", "d", "")]
    wal.write(frame(spark, commands), path)
    monkeypatch.setattr("foldmill.sources.splits.PIECE", 1000)
    rows = [r for p in wal.LogReader(path, 1 << 30).partitions() for b in wal.LogReader(path, 1 << 30).read(p) for r in b.to_pylist()]
    assert [(r["op"], r["key"], r["value"]) for r in rows] == commands


ODD = [
    ("SET", "a", ""), ("SET", "b", "x y"), ("SET", "d d", "1"), ("SET", "", "2"), ("MOD", "b", "line\nbreak\r\n"), ("SET", "q", "\\n\\\\_ \\e \\"), ("SET", "\\e", "\\e"),
    ("SET", "tab", "\t'\"$1\u2028"), ("DEL", "a", None), ("SET", " ", "  "), ("SET", "n", "NULL"),
]


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_text_log(spark, tmp_path, split):
    """Every command is read back as it was written, however the parts are cut."""
    commands = [c for c in random_log(10, n=400)] + ODD
    path = f"file://{tmp_path}/text"
    textlog.write(frame(spark, commands), path, parts=3)
    back = textlog.read(spark, path, split=split)
    assert [tuple(r)[1:] for r in back.orderBy("seq").collect()] == [c for c in commands if c[0] != "GET"]
    assert dict(map(tuple, fold.state(back).collect())) == dict_fold(commands)[0]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(alphabet="\\ _nre\n\ra", max_size=8), st.text(alphabet="\\ _nre\n\ra", max_size=12)), min_size=1, max_size=20))
def test_text_fields_round_trip(spark, pairs):
    df = spark.createDataFrame(pairs, "k string, v string")
    out = df.select(textlog.escape(F.col("k")).alias("k"), textlog.escape(F.col("v")).alias("v"))
    held = out.collect()
    assert all(r[0] and r[1] and not set(" \n\r") & set(r[0] + r[1]) for r in held)
    assert [tuple(r) for r in out.select(textlog.unescape(F.col("k")), textlog.unescape(F.col("v"))).collect()] == pairs


def test_foreign_text_log(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "single.log").write_text("SET a C:\\new\n\nSET  b  x y\nNOP c 1\nDEL a\nSET\nSET last 9")
    rows = textlog.read(spark, f"file://{tmp_path}/old", escaped=False, split=5).orderBy("seq").collect()
    assert [tuple(r)[1:] for r in rows] == [("SET", "a", "C:\\new"), ("SET", "b", "x"), ("DEL", "a", None), ("SET", "last", "9")]


def bulk(s):
    return f"${len(s.encode())}\r\n{s}\r\n"


def request(commands):
    return f"*{len(commands)}\r\n" + "".join(bulk(op) + bulk(k) + (bulk(v) if op in ("SET", "MOD") else "") for op, k, v in commands)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["SET", "GET", "MOD", "DEL"]), st.text(max_size=12), st.text(max_size=12)), max_size=10))
def test_parse_round_trip(commands):
    expect = [(op, k, v if op in ("SET", "MOD") else None, None) for op, k, v in commands]
    assert resp.parse(request(commands)) == expect


@pytest.mark.parametrize(
    "body, error",
    [
        ("$3\r\nGET\r\n$1\r\na\r\n", "-ERR\r\n"),
        (None, "-ERR\r\n"),
        ("*2\r\n$3\r\nFOO\r\n$1\r\na\r\n", "-ERR OP\r\n"),
        ("*2\r\n$3\r\nset\r\n$1\r\na\r\n", "-ERR OP\r\n"),
        ("*2\r\n$4\r\nINCR\r\n$1\r\na\r\n", "-ERR OP LEN\r\n"),
        ("*2\r\nGET\r\n", "-ERR FIND NO CMD\r\n"),
        ("*2\r\n$3\r\nGET\r\n", "-ERR FIND NO KEY\r\n"),
        ("*2\r\n$3\r\nGET\r\n$9\r\na\r\n", "-ERR KEY LEN1\r\n"),
        ("*2\r\n$3\r\nGET\r\n$1\r\nabc\r\n", "-ERR KEY LEN2\r\n"),
        ("*3\r\n$3\r\nSET\r\n$1\r\na\r\n", "-ERR FIND NO"),
        ("*3\r\n$3\r\nSET\r\n$1\r\na\r\n$9\r\nb\r\n", "-ERR VALUE LEN1\r\n"),
        ("*3\r\n$3\r\nSET\r\n$1\r\na\r\n$1\r\nbcd\r\n", "-ERR VALUE LEN2 \r\n"),
    ],
)
def test_errors(body, error):
    assert resp.parse(body)[0] == (None, None, None, error)


@pytest.mark.parametrize("digits", ["9" * 5000, "0" * 5000 + "1", "9" * 19])
def test_lengths_of_any_number_of_digits(digits):
    long = not digits.startswith("0")
    assert resp.parse(f"*1\r\n${digits}\r\nGET\r\n")[0][3] == "-ERR OP LEN\r\n"
    assert resp.parse(f"*2\r\n$3\r\nGET\r\n${digits}\r\na\r\n")[0] == ((None, None, None, "-ERR KEY LEN1\r\n") if long else ("GET", "a", None, None))
    assert resp.parse(f"*3\r\n$3\r\nSET\r\n$1\r\na\r\n${digits}\r\nb\r\n")[0] == ((None, None, None, "-ERR VALUE LEN1\r\n") if long else ("SET", "a", "b", None))


def test_requests_are_answered(spark):
    """Bytes in, framed replies out: the documented batch, then requests with errors, in one order."""
    documented = [("SET", "key1", "value1"), ("SET", "key2", "value2"), ("MOD", "key1", '"ababab"'), ("DEL", "key2", None), ("GET", "key1", None), ("GET", "key2", None)]
    bodies = [
        (1, "*15\r\n" + request(documented).split("\r\n", 1)[1]),
        (2, "*4\r\n" + bulk("FOO") + bulk("x") + bulk("GET") + bulk("key1") + "$3\r\nSET\r\n$1\r\na\r\n$9\r\nb\r\n"),
        (3, "nothing"), (4, None), (5, "*0\r\n"), (6, request([("SET", "e", ""), ("GET", "e", None)])), (9, request([("GET", "seen", None)])),
    ]
    before = spark.createDataFrame([("seen", "earlier")], "key string, value string")
    found = resp.execute(spark.createDataFrame(bodies, RESP_IN).repartition(3), before).orderBy("req_id").collect()
    # Fixed value: the documented reply.
    assert [tuple(r) for r in found] == [
        (1, '*6\r\n+OK\r\n+OK\r\n+OK\r\n+OK\r\n$8\r\n"ababab"\r\n$4\r\nNULL\r\n'),
        (2, '*3\r\n-ERR OP\r\n$8\r\n"ababab"\r\n-ERR VALUE LEN1\r\n'), (3, "-ERR\r\n"), (4, "-ERR\r\n"), (5, "*0\r\n"), (6, "*2\r\n+OK\r\n$0\r\n\r\n"), (9, "*1\r\n$7\r\nearlier\r\n"),
    ]
    with pytest.raises(Exception, match="request ids"):
        resp.execute(spark.createDataFrame([(-1, "*0\r\n$3\r\nGET\r\n")], RESP_IN)).collect()


def test_reading_goes_on_after_an_error():
    body = "*9\r\n" + bulk("FOO") + bulk("x") + bulk("GET") + bulk("a") + bulk("SET") + bulk("b") + bulk("")
    assert [c[0] for c in resp.parse(body)] == [None, "GET", "SET"]


def test_empty_requests(spark):
    assert resp.read(spark.createDataFrame([], RESP_IN)).collect() == []


def test_commands_are_put_out_as_they_are_read(spark):
    """A batch of many requests gives pieces of about ``ROWS`` commands, not one."""

    class Once:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            body = request([("SET", "k", "v"), ("GET", "k", None)] * 25)
            batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([body] * 2000)], names=["req_id", "body"])
            return list(run(iter([batch])))

    out = resp.read(Once())
    assert sum(b.num_rows for b in out) == 100_000 and max(b.num_rows for b in out) < 10_100
    assert out[3].slice(0, 2).to_pylist() == [{"req_id": 600, "idx": k, "op": op, "key": "k", "value": v, "error": None} for k, op, v in ((1, "SET", "v"), (2, "GET", None))]


def test_inline_lines(spark):
    cases = {
        "SET a 1": ("SET", "a", "1", 3), "GET  a": ("GET", "a", "", 2), "SET a 'x y'": ("SET", "a", "x y", 3), r'MOD a "q\"r\\s"': ("MOD", "a", r'q"r\s', 3),
        "DEL a": ("DEL", "a", "", 2), "INCR a": ("", "a", "", 0), "": ("", "", "", 0), "SET a": ("SET", "a", "", 0), "SET a b c": ("SET", "a", "b c", 3),
    }
    line = F.col("line")
    df = spark.createDataFrame([(x,) for x in cases], "line string").select("line", text.inline_op(line).alias("o"), text.inline_key(line).alias("k"), text.inline_value(line).alias("v"))
    found = {r["line"]: tuple(r)[1:] for r in df.withColumn("n", text.inline_tokens(F.col("o"), F.col("k"), F.col("v"))).collect()}
    assert found == cases
