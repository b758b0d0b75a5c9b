"""Binary command logs: ``op u8, key length u32, key, value length u32, value``, little-endian.

A log is a folder of segments.  Writing ranges the commands by ``seq`` and gives each range its own segment, as
many as the log's size asks for; a segment is written under a temporary name and renamed once its task has
committed, so a lost task leaves nothing behind.  Beside a segment lies an index: record number and byte offset
at every few megabytes.  With it a segment is read in byte ranges by different tasks; a segment of another
writer has none and is read by one task, in pieces.  The order is the segments' names, then file position.  A
torn tail is dropped, and so are records of an unknown opcode.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from ..schemas import CMDLOG
from .splits import SPLIT, Range, pieces, ranges, store_of, text_array

OPCODES = {"SET": 0, "MOD": 2, "DEL": 3}
VERBS = {v: k for k, v in OPCODES.items()}
#: Commands that one segment can hold; a sequence number is segment * SEGMENT + position.
SEGMENT = 1 << 32
#: Bytes of a segment, about, and between two entries of its index.
SEGMENT_BYTES, MARK_BYTES = 128 << 20, 4 << 20
#: Records that a reader puts out at once at most.
BATCH = 20_000
MARK = np.dtype([("offset", "<u8"), ("record", "<u8")])


def encode(op: str, key: str, value: str | None) -> bytes:
    k, v = key.encode(), b"" if op == "DEL" else (value or "").encode()
    return struct.pack("<BI", OPCODES[op], len(k)) + k + struct.pack("<I", len(v)) + v


def encode_batch(batch: pa.RecordBatch) -> pa.Array:
    """One record for each row of (op, key, value) whose op is logged."""
    ops, keys, values = (batch.column(batch.schema.get_field_index(n)) for n in ("op", "key", "value"))
    logged = pc.is_in(ops, pa.array(list(OPCODES)))
    ops, keys, values = (x.filter(logged) for x in (ops, keys, values))
    keys = keys.cast(pa.binary())
    values = pc.if_else(pc.equal(ops, "DEL"), pa.scalar(b"", pa.binary()), pc.fill_null(values.cast(pa.binary()), b""))
    head, tail = np.empty(len(ops), [("op", "u1"), ("size", "<u4")]), np.empty(len(ops), "<u4")
    head["op"] = np.array(list(OPCODES.values()))[pc.index_in(ops, pa.array(list(OPCODES))).to_numpy(zero_copy_only=False).astype(int)]
    head["size"] = pc.binary_length(keys).to_numpy(zero_copy_only=False)
    tail[:] = pc.binary_length(values).to_numpy(zero_copy_only=False)
    fixed = [pa.Array.from_buffers(pa.binary(x.itemsize), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in (head, tail)]
    return pc.binary_join_element_wise(fixed[0], keys, fixed[1], values, pa.scalar(b"", pa.binary()))


def places(data: bytes, limit: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(opcode, key start, key end, value start, value end) of at most ``limit`` whole records, and where they end."""
    out, at, n, head, word = [], 0, len(data), struct.Struct("<BI").unpack_from, struct.Struct("<I").unpack_from
    while at + 5 <= n and len(out) < limit:
        code, size = head(data, at)
        key_end = at + 5 + size
        if key_end + 4 > n:
            break
        end = key_end + 4 + word(data, key_end)[0]
        if end > n:
            break
        out.append((code, at + 5, key_end, key_end + 4, end))
        at = end
    return out, at


def decode(data: bytes) -> Iterator[tuple[int, str, str, str | None]]:
    """(position, op, key, value) of the whole records of a segment."""
    for position, (code, a, b, c, d) in enumerate(places(data, len(data))[0]):
        if code in VERBS:
            value = None if VERBS[code] == "DEL" else data[c:d].decode("utf-8", "replace")
            yield position, VERBS[code], data[a:b].decode("utf-8", "replace"), value


@dataclass
class Segment(WriterCommitMessage):
    partition: int
    temporary: str


class LogWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Segment:
        from pyspark import TaskContext

        store, root = store_of(self.path)
        store.create_dir(root, recursive=True)
        partition = TaskContext.get().partitionId()
        name = f"{root}/_{partition}-{uuid.uuid4().hex}"
        marks, at, record = [(0, 0)], 0, 0
        with store.open_output_stream(name) as out:
            for batch in batches:
                if at - marks[-1][0] >= MARK_BYTES:
                    marks.append((at, record))
                records = encode_batch(batch)
                if len(records):
                    data = b"".join(records.to_pylist())
                    out.write(data)
                    at, record = at + len(data), record + len(records)
        with store.open_output_stream(f"{name}.idx") as out:
            out.write(np.array(marks, MARK).tobytes())
        return Segment(partition, name)

    def commit(self, messages) -> None:
        store, root = store_of(self.path)
        for m in messages:
            if m is not None:  # the index first: a segment never waits for it
                store.move(f"{m.temporary}.idx", f"{root}/segment-{m.partition:08d}.idx")
                store.move(m.temporary, f"{root}/segment-{m.partition:08d}.log")

    def abort(self, messages) -> None:
        store, _ = store_of(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.temporary)
                store.delete_file(f"{m.temporary}.idx")


class LogReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        return ranges(self.path, ".log", self.split, whole=lambda name, names: f"{name[:-4]}.idx" not in names)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Records from the first marked one of the range to the first of the next range."""
        store, _ = store_of(self.path)
        digits = re.search(r"segment-(\d+)\.log$", part.path)
        base = (int(digits[1]) if digits else 0) * SEGMENT
        at, record, stop = part.start, 0, part.stop
        if part.start or part.stop < part.size:
            with store.open_input_stream(f"{part.path[:-4]}.idx") as f:
                marks = np.frombuffer(f.read(), MARK)
            first, last = (int(np.searchsorted(marks["offset"], x)) for x in (part.start, part.stop))
            if first == len(marks) or first == last:
                return
            at, record = int(marks["offset"][first]), int(marks["record"][first])
            stop = int(marks["offset"][last]) if last < len(marks) else part.size
        rest = b""
        for piece in pieces(store, part.path, at):
            data = rest + piece
            while True:
                found, end = places(data, BATCH)
                # Records from ``stop`` on belong to the next range.
                keep = next((k for k, x in enumerate(found) if at + x[1] - 5 >= stop), len(found))
                if keep:
                    yield self.batch(data, found[:keep], base + record)
                if keep < len(found):
                    return
                record, at, data = record + len(found), at + end, data[end:]
                if len(found) < BATCH:
                    break
            if at >= stop:
                return
            rest = data

    @staticmethod
    def batch(data: bytes, found: list[tuple[int, int, int, int, int]], first: int) -> pa.RecordBatch:
        known = [(k, x) for k, x in enumerate(found, first) if x[0] in VERBS]
        values = [None if x[0] == OPCODES["DEL"] else data[x[3] : x[4]] for _, x in known]
        arrays = [
            pa.array([k for k, _ in known], pa.int64()),
            pa.array([VERBS[x[0]] for _, x in known], pa.string()),
            text_array([data[x[1] : x[2]] for _, x in known]),
            text_array(values),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=CMDLOG.names)


class LogSource(DataSource):
    """``df.write.format("fold_log").save(path)``, ``spark.read.format("fold_log").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "fold_log"

    def schema(self) -> str:
        return "seq bigint, op string, key string, value string"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite) -> LogWriter:
        return LogWriter(self.options["path"])


def write(log: DataFrame, path: str, segments: int | None = None) -> None:
    """Write the commands that change state, in order of ``seq``; by default a segment holds ``SEGMENT_BYTES``."""
    log.sparkSession.dataSource.register(LogSource)
    rows = log.where(F.col("op").isin(*OPCODES)).select("seq", "op", "key", "value")
    if segments is None:
        size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 9
        segments = max(1, -(-(rows.agg(F.sum(size)).first()[0] or 0) // SEGMENT_BYTES))
    ranged = rows.repartitionByRange(segments, "seq").sortWithinPartitions("seq")
    ranged.write.format("fold_log").mode("append").save(path)


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The commands of all segments; ``seq`` is the order in the log."""
    spark.dataSource.register(LogSource)
    return spark.read.format("fold_log").option("split", split).load(path)
