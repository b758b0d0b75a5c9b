"""Scalar expressions over commands and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def opcode(op: Column) -> Column:
    """SET 0, GET 1, MOD 2, DEL 3, anything else -1; verbs are case-sensitive."""
    return F.when(op == "SET", 0).when(op == "GET", 1).when(op == "MOD", 2).when(op == "DEL", 3).otherwise(-1)


def tokens(line: Column) -> Column:
    """Space-separated tokens; repeated spaces count once."""
    return F.array_remove(F.split(line, " +"), "")


def unescape(quoted: Column) -> Column:
    """A backslash stands for the character after it."""
    return F.regexp_replace(quoted, r"\\(.)", "$1")


def inline_op(line: Column) -> Column:
    return F.regexp_extract(line, r"^ *(SET|GET|MOD|DEL)(?: |$)", 1)


def inline_key(line: Column) -> Column:
    return F.regexp_extract(line, r"^ *\S+ +(\S+)", 1)


def inline_value(line: Column) -> Column:
    """The third field of SET and MOD: quoted by ' or ", or else the rest of the line."""
    rest = F.regexp_extract(line, r"^ *(?:SET|MOD) +\S+ +(.*)$", 1)
    single = F.regexp_extract(rest, r"^'((?:[^'\\]|\\.)*)'", 1)
    double = F.regexp_extract(rest, r'^"((?:[^"\\]|\\.)*)"', 1)
    return F.when(rest.startswith("'"), unescape(single)).when(rest.startswith('"'), unescape(double)).otherwise(rest)


def inline_tokens(op: Column, key: Column, value: Column) -> Column:
    """2 tokens for GET and DEL, 3 for SET and MOD, 0 for a bad line."""
    two, three = op.isin("GET", "DEL") & (key != ""), op.isin("SET", "MOD") & (key != "") & (value != "")
    return F.when(three, 3).when(two, 2).otherwise(0)


def bulk(value: Column) -> Column:
    """A bulk string: byte length, then the value."""
    return F.concat(F.lit("$"), F.octet_length(value), F.lit("\r\n"), value, F.lit("\r\n"))


def encoded(op: Column, got: Column) -> Column:
    """The reply on the wire."""
    return F.when(op == "GET", bulk(F.coalesce(got, F.lit("NULL")))).otherwise(F.lit("+OK\r\n"))


def legacy(op: Column, got: Column) -> Column:
    """The reply of the older one-line protocol."""
    done = F.when(op == "SET", "SET COMPLETE").when(op == "MOD", "MOD COMPLETE").when(op == "DEL", "DEL COMPLETE")
    return F.when(op == "GET", F.coalesce(got, F.lit("NULL"))).otherwise(F.coalesce(done, F.lit("OPERATE ERROR")))
