"""The two row types: what a server sends, and what is stored."""

from __future__ import annotations

from pyspark.sql import types as T

#: Rows of a live block, rows of a merged block.
BLOCK_ROWS, MERGED_ROWS = 10_000, 100_000
#: The format version that is written; what it lacks of a later one is not known here.
VERSION = 6
PROTOCOL_NUMBERS = {"Unknown": 0, "Http": 1, "Https": 2}

#: A request as JSON. body is a list of bytes or text; tls_fingerprint is a number that may need 39 digits.
ENTRY = T.StructType([
    T.StructField("status", T.IntegerType()), T.StructField("method", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("ip", T.StringType()), T.StructField("port", T.IntegerType()), T.StructField("time", T.LongType()),
    T.StructField("body", T.StringType()), T.StructField("headers", T.StringType()), T.StructField("host", T.StringType()),
    T.StructField("proto", T.StringType()), T.StructField("location", T.StringType()), T.StructField("tls_fingerprint", T.StringType()),
])

_PAIR = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

#: A stored row. ua and referer are of versions up to 2, body from 2, headers and host from 3, proto from 4, location from 5,
#: tls_fp from 6; what a version lacks has its default.
STORED = T.StructType([
    T.StructField("position", T.LongType(), False), T.StructField("status", T.IntegerType()), T.StructField("method", T.StringType()),
    T.StructField("uri", T.StringType()), T.StructField("ua", T.StringType()), T.StructField("referer", T.StringType()),
    T.StructField("ip", T.BinaryType()), T.StructField("ip4", T.LongType()), T.StructField("port", T.IntegerType()),
    T.StructField("time", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("headers", T.ArrayType(_PAIR)),
    T.StructField("host", T.StringType()), T.StructField("proto", T.IntegerType()), T.StructField("location", T.StringType()),
    T.StructField("tls_fp", T.BinaryType()),
])
COLUMNS = tuple(f.name for f in STORED)
