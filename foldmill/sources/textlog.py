r"""Text command logs: one ``<op> <key> <value>`` a line, split at spaces.

What a plain field cannot hold is escaped by a backslash: ``\\`` for a backslash, ``\_`` for a space, ``\n`` and
``\r`` for line breaks, ``\e`` for an empty text; a null value has no field.  So every key and value is read back
as it was.  Logs of other writers, which know no escapes, are read with ``escaped=False``.

Written as parts that are ranges of ``seq``, each part in order, as many as their size asks for.  A part is read
in byte ranges by different tasks; a line's number is its part's number and its place in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..functions.text import tokens
from .splits import SPLIT, Range, pieces, ranges, store_of, text_array

#: Bytes of a part at most; a line's ``seq`` is part * PART + byte offset.
PART = 1 << 40
PART_BYTES = 128 << 20
#: Escapes, but for the backslash itself and the empty text.
ESCAPES = {" ": r"\_", "\n": r"\n", "\r": r"\r"}
EMPTY = r"\e"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in ESCAPES.items():
        out = F.replace(out, F.lit(plain), F.lit(code))
    return F.when(text == "", F.lit(EMPTY)).otherwise(out)


def unescape(field: Column) -> Column:
    def inner(part: Column) -> Column:
        for plain, code in ESCAPES.items():
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    # Escaped backslashes first: what is between them holds single ones only.
    plain = F.array_join(F.transform(F.split(field, r"\\\\"), inner), "\\")
    return F.when(field == EMPTY, F.lit("")).when(F.contains(field, F.lit("\\")), plain).otherwise(field)


def write(log: DataFrame, path: str, parts: int | None = None) -> None:
    """Write the commands that change state; by default a part holds about ``PART_BYTES``."""
    rows = log.where(F.col("op").isin("SET", "MOD", "DEL"))
    if parts is None:
        size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 6
        parts = max(1, -(-(rows.agg(F.sum(size)).first()[0] or 0) // PART_BYTES))
    value = F.when(F.col("op") != "DEL", escape(F.col("value")))
    line = F.concat_ws(" ", "op", escape(F.col("key")), value).alias("value")
    rows.repartitionByRange(parts, "seq").sortWithinPartitions("seq").select(line).write.text(path)


class LineReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        return ranges(self.path, "", self.split)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Lines that start in the range; the last one may end beyond it."""
        store, _ = store_of(self.path)
        digits = re.match(r"part-(\d+)", part.path.rsplit("/", 1)[-1])
        number = int(digits[1]) if digits else 0
        at, rest, skip = max(0, part.start - 1), b"", part.start > 0
        for data in pieces(store, part.path, at):
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            if skip and lines:  # the end of the line before
                at += len(lines.pop(0)) + 1
                skip = False
            yield from self.numbered(lines, number, at, part.stop)
            at += sum(map(len, lines)) + len(lines)
            if at >= part.stop:
                return
        if rest and not skip:
            yield from self.numbered([rest], number, at, part.stop)

    @staticmethod
    def numbered(lines: list[bytes], number: int, at: int, stop: int) -> Iterator[pa.RecordBatch]:
        seqs = []
        for line in lines:
            if at >= stop:
                break
            seqs.append(number * PART + at)
            at += len(line) + 1
        if seqs:
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), text_array(lines[: len(seqs)])], names=["seq", "text"])


class LineSource(DataSource):
    """``spark.read.format("fold_lines").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "fold_lines"

    def schema(self) -> str:
        return "seq bigint, text string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("split", SPLIT)))


def read(spark: SparkSession, path: str, escaped: bool = True, split: int = SPLIT) -> DataFrame:
    """(seq, op, key, value) of all lines that hold a command; further fields of a line are passed over."""
    spark.dataSource.register(LineSource)
    t = tokens(F.col("text"))
    key, value = F.get(t, F.lit(1)), F.get(t, F.lit(2))
    if escaped:
        key, value = unescape(key), unescape(value)
    rows = spark.read.format("fold_lines").option("split", split).load(path)
    rows = rows.select("seq", F.get(t, F.lit(0)).alias("op"), key.alias("key"), value.alias("value"))
    return rows.where(F.col("op").isin("SET", "MOD", "DEL") & F.col("key").isNotNull())
