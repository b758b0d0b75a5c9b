"""What the operators share: table access, shared-folder tables, rows known by their place, Arrow maps."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where intermediate tables go if the session names no shared folder: on a single machine only.
LOCAL_SHARED = "file:///tmp/checkpoints/foldmill"
#: Bytes of row bitmaps up to which they are broadcast: 64 MB tell apart 500 million rows.
BITMAP_BYTES = 64 << 20
#: Rows that one bitmap tells apart (Spark's bitmaps have 4,096 bytes).
BITMAP_ROWS = 32_768

#: Tables written by ``materialize`` and not removed yet.
_left: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and all executors share (``spark.checkpoint.dir``)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stays until ``release`` or ``release_all``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foldmill_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _left.discard(path)


def release(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and that no later step reads."""
    path = getattr(df, "_foldmill_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def made_so_far() -> frozenset[str]:
    """The tables that ``materialize`` has written and that are still there."""
    return frozenset(_left)


def release_since(spark: SparkSession, before: frozenset[str], keep: DataFrame) -> None:
    """Remove the tables written after ``before`` was taken, but for ``keep``: what a finished step leaves behind."""
    for path in _left - before - {getattr(keep, "_foldmill_path", None)}:
        _delete(spark, path)


def release_all(spark: SparkSession) -> int:
    """Remove all tables that ``materialize`` wrote in this process; results that read them end here."""
    paths = list(_left)
    for path in paths:
        _delete(spark, path)
    return len(paths)


# --------------------------------------------------------------------------------------- rows by their place


def is_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of a file: projections and filters over a single file scan."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.children().size() == 1:
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "HadoopFsRelation" in node.relation().getClass().getName()


def placed_rows(df: DataFrame, name: str) -> tuple[DataFrame, str, str]:
    """``df`` with two more columns that name each row: a hash of its file's path, and its number in the file.

    These come from the file scan, cost no shuffle and are the same at each reading.  A frame that is more
    than a scan is written to the shared folder first.
    """
    if not is_scan(df):
        df = materialize(df, name)
    file, row = fresh(df.columns, "_file"), fresh(df.columns, "_row")
    place = df.metadataColumn("_metadata")  # not a column of the data by that name
    return df.withColumns({file: F.xxhash64(place["file_path"]), row: place["row_index"]}), file, row


def chosen_rows(rows: DataFrame, places: DataFrame, file: str, row: str, keep: bool = True, limit: int = BITMAP_BYTES) -> DataFrame:
    """The rows whose place (``file``, ``row``) is in ``places`` - or with ``keep`` false, is not.

    ``places`` becomes a bitmap for each 32,768 rows of a file, one bit a row, so the rows stay where they
    lie: bitmaps of up to ``limit`` bytes by count are broadcast.  Beyond that both sides are shuffled.
    """
    part = fresh([*rows.columns, *places.columns], "_part")
    bits = fresh([*rows.columns, part], "_bits")
    number = F.expr(f"`{row}` div {BITMAP_ROWS}")
    maps = places.select(F.col(file), number.alias(part), F.col(row)).groupBy(file, part).agg(F.bitmap_construct_agg(F.col(row) % BITMAP_ROWS).alias(bits))
    maps = materialize(maps, "bitmaps")
    small = maps.count() * (BITMAP_ROWS // 8 + 64) <= limit
    out = rows.withColumns({part: number}).join(F.broadcast(maps) if small else maps, [file, part], "left")
    at = F.col(row) % BITMAP_ROWS
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.expr(f"cast(`{row}` % {BITMAP_ROWS} div 8 as int)") + 1), 1)), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return without(out.where(is_set if keep else ~is_set), [part, bits]).select(*[F.col(f"`{c}`") for c in rows.columns])


def fresh(columns: Iterable[str], base: str) -> str:
    """A column name that none of ``columns`` has, whatever the case."""
    taken = {c.lower() for c in columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without its columns of these names, whatever the case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


#: Rows, and bytes of text, that an operator's Python code sees at once (one row may have more bytes).
SLICE_ROWS, SLICE_BYTES = 512, 2 << 20
#: Bytes of the batches that Spark hands to a Python worker, in place of Spark's own default of 64 MB: a batch
#: is held twice by the executor and once by the worker.
ARROW_CONF, ARROW_DEFAULT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"

#: The one large object that a worker process keeps from task to task, and its name.
_resident: list = [None, None]


def resident(name, make: Callable[[], object]):
    """The object of this name, made once a process; another name's object is let go before it is made."""
    if _resident[0] != name:
        _resident[:] = None, None
        _resident[:] = name, make()
    return _resident[1]


def trim() -> None:
    """Give memory that this worker process has freed back to the system; at the end of a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library can
        pass


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand over batches of ``ARROW_BYTES``, unless the session asks for a size of its own."""
    if spark.conf.get(ARROW_CONF, ARROW_DEFAULT) == ARROW_DEFAULT:
        spark.conf.set(ARROW_CONF, ARROW_BYTES)


def slices(batch: pa.RecordBatch, position: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces that bound what a worker holds, whatever the lengths of the texts."""
    column = batch.column(position)
    if pa.types.is_list(column.type):
        sizes = 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = int(np.searchsorted(ends, before + SLICE_BYTES, "right"))
        stop = min(max(stop, at + 1), at + SLICE_ROWS)
        yield batch.slice(at, stop - at)
        at = stop


def append_columns(
    df: DataFrame,
    text_col: str,
    added: list[tuple[str, T.DataType]],
    per_batch: Callable[[list[str | None]], list[pa.Array]],
    name=None,
) -> DataFrame:
    """``df`` with the columns that ``per_batch`` computes from the whole texts of each slice of rows.

    Rows are neither moved nor reordered.  The added columns replace columns of the same name.  A worker that
    holds a ``resident`` object of a name other than ``name`` lets it go.
    """
    small_batches(df.sparkSession)
    kept = without(df, [n for n, _ in added])
    carrier = None
    if text_col not in kept.columns:
        carrier = fresh(kept.columns, "_text_in")
        kept = kept.withColumns({carrier: df[text_col]})
    position = kept.columns.index(carrier or text_col)
    names = [n for n, _ in added]
    fields = [f for f in kept.schema.fields if f.name != carrier]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + [T.StructField(n, t, True) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _resident[0] != name:
            _resident[:] = None, None
        for batch in (part for whole in batches for part in slices(whole, position)):
            texts = batch.column(position).to_pylist()
            arrays = [batch.column(i) for i in range(batch.num_columns) if not (carrier and i == position)]
            labels = [batch.schema.names[i] for i in range(batch.num_columns) if not (carrier and i == position)]
            yield pa.RecordBatch.from_arrays(arrays + per_batch(texts), names=labels + names)
        trim()

    return kept.mapInArrow(run, schema)
