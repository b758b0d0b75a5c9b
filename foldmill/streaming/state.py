"""The fold as a stream: keyed state updated command by command, or a stored table updated batch by batch.

Each key keeps its value and the last sequence number applied to it.  The rows of a micro-batch are
sorted by ``seq`` within the key; a command that is not later than the last one applied is late and goes
out as such instead of changing the state.  A key's rows of one micro-batch are sorted in one task, so the source's
limit on a micro-batch (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bounds what a hot key holds.

``fold_into_table`` holds no key's rows together: each micro-batch is folded as a log over a stored table, which is
compacted as it fills.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.table import KeyedTable
from ..plans import fold

OUTPUT = "key string, seq bigint, op string, value string, got string, late boolean"


#: What is kept of a key.
STATE = "alive boolean, value string, seq bigint"


def fold_key(key: tuple[str], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The output of one key's rows of a micro-batch.  State comes and goes with the rows' own Arrow batches: a
    stateful processor would ask the JVM for each key's, several times."""
    columns = ([], [], [])
    for part in rows:
        for own, name in zip(columns, ("seq", "op", "value")):
            own.extend(part[name].tolist())
    alive, value, last = state.get if state.exists else (False, None, -1)
    out = []
    for seq, op, new in sorted(zip(*columns), key=itemgetter(0)):
        late, got = seq <= last, None
        if not late:
            last = seq
            if op == "SET" or (op == "MOD" and alive):
                alive, value = True, new
            elif op == "DEL":
                alive, value = False, None
            elif op == "GET" and alive:
                got = value
        out.append((key[0], seq, op, value if alive else None, got, late))
    state.update((alive, value, last))
    yield pd.DataFrame(out, columns=["key", "seq", "op", "value", "got", "late"])


def fold_stream(commands: DataFrame) -> DataFrame:
    """One output row for each command: the key's value after it (null if absent), a GET's answer, lateness."""
    return commands.groupBy("key").applyInPandasWithState(fold_key, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(commands: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the fold over all available input and write its rows to ``path`` as Parquet; returns them when it is done."""
    query = fold_stream(commands).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return commands.sparkSession.read.schema(OUTPUT).parquet(path)


def fold_into_table(commands: DataFrame, table_path: str, replies_path: str, checkpoint: str, budget_bytes: int | None = None) -> None:
    """Fold all available commands (seq, op, key, value) over the table at ``table_path`` and write what each is
    answered (seq, op, key, got, reply) to ``replies_path``, one folder a micro-batch.

    Micro-batches follow each other; ``seq`` orders the commands within one.  After each, the table is compacted
    as far as is due.  A batch that is run again after a failure finds its number in the table's manifest and
    changes nothing twice; its replies were written before.
    """
    options = {} if budget_bytes is None else {"budget_bytes": budget_bytes}

    def step(batch: DataFrame, number: int) -> None:
        table = KeyedTable(batch.sparkSession, table_path, **options)
        if table.batch >= number:
            return
        before = table.lookup(batch.select("key").distinct()).select(F.lit(-1).cast("bigint").alias("seq"), F.lit("SET").alias("op"), "key", "value")
        log = before.unionByName(batch.select("seq", "op", "key", "value"))
        fold.replies(log).where("seq >= 0").write.mode("overwrite").parquet(f"{replies_path}/batch={number}")
        table.apply(batch, number)
        while table.compact():
            pass

    commands.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
