"""Row types of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

PUT, REMOVE, CLEAR = "PUT", "REMOVE", "CLEAR"
OPS = (PUT, REMOVE, CLEAR)  # numbered 0, 1, 2 in binary logs

#: A log record. Keys and values are strings compared by bytes; ``v`` of anything but a PUT is the empty string.
LOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])

#: A decoded binary log record, with its stored checksum.
WAL = T.StructType([T.StructField("op", T.StringType()), T.StructField("k", T.BinaryType()), T.StructField("v", T.BinaryType()), T.StructField("seq", T.LongType()), T.StructField("crc", T.LongType())])

#: An entry of a foreign sorted table file.
TABLE_ENTRY = T.StructType([T.StructField("block_no", T.IntegerType()), T.StructField("k", T.BinaryType()), T.StructField("v", T.BinaryType())])

#: A block of such a file.
BLOCK_INDEX = T.StructType([T.StructField("block_no", T.IntegerType()), T.StructField("last_key", T.BinaryType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType())])
