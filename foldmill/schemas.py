"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

CMDLOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType(), True),
    ]
)
STATE = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)])
RUN = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("is_deleted", T.BooleanType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("run_seq", T.LongType()),
    ]
)
RESP_IN = T.StructType([T.StructField("req_id", T.LongType()), T.StructField("body", T.StringType())])
RESP_OUT = T.StructType(
    [
        T.StructField("req_id", T.LongType()),
        T.StructField("idx", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
VERBS = ("SET", "GET", "MOD", "DEL")
