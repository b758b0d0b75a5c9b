"""Length-prefixed text batches (RESP style): parsing into commands, execution, and replies.

A request is ``*<n>`` and then, for each command, bulk strings of verb, key and, for SET and MOD, value.
Strings are delimited by their byte lengths, so values may be empty or hold line breaks.  The array count
is read and not used.  A command that cannot be read gives one row with an ``error`` and no verb; reading
goes on at the next three-byte verb header, so one bad command never hides the ones after it.  A length of
any number of digits is read; one that no body can hold is too long.

``execute`` goes from requests to framed replies: the commands of all requests are one log, in order of request
and place; what could not be read is answered by its error's text and changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bulk, encoded
from ..plans import fold
from ..schemas import RESP_OUT, VERBS

#: The texts of the errors.
ERRORS = {
    "frame": "-ERR\r\n",
    "no_verb": "-ERR FIND NO CMD\r\n",
    "verb": "-ERR OP\r\n",
    "verb_length": "-ERR OP LEN\r\n",
    "no_key": "-ERR FIND NO KEY\r\n",
    "key_long": "-ERR KEY LEN1\r\n",
    "key_length": "-ERR KEY LEN2\r\n",
    "no_value": "-ERR FIND NO",
    "value_long": "-ERR VALUE LEN1\r\n",
    "value_length": "-ERR VALUE LEN2 \r\n",
}
HEADER = re.compile(rb"\$(\d+)\r\n")
#: Digits of a length that is read as a number; with more, leading zeros aside, it is longer than any body.
DIGITS = 12
NEXT_VERB = re.compile(rb"\$3\r\n(?:SET|GET|MOD|DEL)\r\n")


class Bad(Exception):
    """A command that cannot be read."""


def length(head: re.Match) -> int:
    digits = head[1].lstrip(b"0")
    return int(digits or b"0") if len(digits) <= DIGITS else 1 << 62


def field(body: bytes, at: int, missing: str, long: str, wrong: str) -> tuple[bytes, int]:
    """A bulk string at ``at``, and where the next one starts."""
    head = HEADER.match(body, at)
    if head is None:
        raise Bad(missing)
    end = head.end() + length(head)
    if end > len(body):
        raise Bad(long)
    if body[end : end + 2] != b"\r\n":
        raise Bad(wrong)
    return body[head.end() : end], end + 2


def verb(body: bytes, at: int) -> tuple[str, int]:
    head = HEADER.match(body, at)
    if head is None:
        raise Bad("no_verb")
    if length(head) != 3:
        raise Bad("verb_length")
    word = body[head.end() : head.end() + 3]
    if word.decode("utf-8", "replace") not in VERBS or body[head.end() + 3 : head.end() + 5] != b"\r\n":
        raise Bad("verb")
    return word.decode(), head.end() + 5


def parse(text: str | None) -> list[tuple[str | None, str | None, str | None, str | None]]:
    """(op, key, value, error) of each command of one request."""
    body = (text or "").encode()
    start = re.match(rb"\*\d*\r\n", body)
    if start is None:
        return [(None, None, None, ERRORS["frame"])]
    out, at = [], start.end()
    while at < len(body):
        try:
            op, here = verb(body, at)
            key, here = field(body, here, "no_key", "key_long", "key_length")
            value = None
            if op in ("SET", "MOD"):
                value, here = field(body, here, "no_value", "value_long", "value_length")
            out.append((op, key.decode("utf-8", "replace"), None if value is None else value.decode("utf-8", "replace"), None))
            at = here
        except Bad as why:
            out.append((None, None, None, ERRORS[str(why)]))
            again = NEXT_VERB.search(body, at + 1)
            at = again.start() if again else len(body)
    return out


#: Commands that a parser holds before it puts them out, but for those of one request.
ROWS = 10_000


def table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=RESP_OUT.names)


def read(requests: DataFrame) -> DataFrame:
    """(req_id, idx, op, key, value, error) of ``requests`` (req_id, body), idx counting from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, body in zip(batch.column(0), batch.column(1)):
                rows += [(r.as_py(), k, *c) for k, c in enumerate(parse(body.as_py()), 1)]
                if len(rows) >= ROWS:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    return requests.select("req_id", "body").mapInArrow(run, RESP_OUT)


def command(op, key, value):
    """One command on the wire, as a column."""
    return F.concat(bulk(op), bulk(key), F.when(op.isin("SET", "MOD"), bulk(value)).otherwise(F.lit("")))


def framed(rows: DataFrame) -> DataFrame:
    """(req_id, body): the parts ``c`` of each ``req_id`` in order of ``seq``, with their number before them.

    A body is one value, so a request's parts meet in one row anyway.
    """
    parts = rows.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("seq", "c"))).alias("x"))
    return parts.select("req_id", F.concat(F.lit("*"), F.size("x"), F.lit("\r\n"), F.array_join(F.col("x.c"), "")).alias("body"))


def write(log: DataFrame, per_request: int = 50) -> DataFrame:
    """(req_id, body): requests of ``per_request`` sequence numbers each."""
    return framed(log.select(F.expr(f"seq div {per_request}").alias("req_id"), "seq", command(F.col("op"), F.col("key"), F.col("value")).alias("c")))


def framed_replies(replies: DataFrame, per_request: int = 50) -> DataFrame:
    """(req_id, body): the encoded replies of each request; ``replies`` is (seq, op, key, got)."""
    return framed(replies.select(F.expr(f"seq div {per_request}").alias("req_id"), "seq", encoded(F.col("op"), F.col("got")).alias("c")))


#: Bits of a sequence number that count commands inside a request: a body of 2 GB has fewer (each takes nine
#: bytes at least).
INNER = 28


def order(req_id: Column, idx: Column) -> Column:
    """One number that orders commands by request, then by place."""
    fits = req_id.between(0, (1 << 63 - INNER) - 1) & (idx < 1 << INNER)
    return F.when(fits, F.shiftleft(req_id, INNER) + idx).otherwise(F.raise_error(F.lit("request ids must be from 0 to 2**35 - 1")))


def execute(requests: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(req_id, body): the framed reply to each of ``requests`` (req_id, body), run in order of ``req_id`` on
    the state ``before`` (key, value; none by default).

    A reply starts with the number of commands tried, failed ones included; a request that is no array at all
    is answered by the bare error.
    """
    parsed = read(requests).withColumn("seq", order(F.col("req_id"), F.col("idx")))
    log = parsed.where("op is not null").select("seq", "op", "key", "value")
    if before is not None:
        log = log.unionByName(before.select(F.lit(-1).cast("bigint").alias("seq"), F.lit("SET").alias("op"), "key", "value"))
    done = fold.replies(log).where("seq >= 0").select("seq", encoded(F.col("op"), F.col("got")).alias("c"))
    failed = parsed.where("op is null").select("seq", F.col("error").alias("c"))
    rows = done.unionByName(failed).select(F.expr(f"shiftright(seq, {INNER})").alias("req_id"), "seq", "c")
    unframed = F.col("body") == F.lit(f"*1\r\n{ERRORS['frame']}")
    answered = framed(rows).select("req_id", F.when(unframed, F.lit(ERRORS["frame"])).otherwise(F.col("body")).alias("body"))
    # A frame without any command has an answer too.
    return requests.select("req_id").join(answered, "req_id", "left").select("req_id", F.coalesce("body", F.lit("*0\r\n")).alias("body"))
