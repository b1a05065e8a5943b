"""The canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

PROPS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))

LOGS = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("random", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("level", T.StringType()), T.StructField("props", PROPS), T.StructField("msg", T.StringType()),
])

DEVICES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("send_logs", T.BooleanType()), T.StructField("filter_level", T.IntegerType()),
    T.StructField("logs_size", T.LongType()), T.StructField("logs_count", T.LongType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("last_upload_at", T.TimestampType()), T.StructField("send_interval", T.IntegerType()),
])

DEVICE_PROPS = T.StructType([T.StructField(c, T.StringType()) for c in ("device_id", "key", "value")])

SEGMENTS = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("bucket_id", T.IntegerType()), T.StructField("device_id", T.StringType()),
    T.StructField("first_timestamp", T.TimestampType()), T.StructField("last_timestamp", T.TimestampType()), T.StructField("original_size", T.LongType()),
    T.StructField("compressed_size", T.LongType()), T.StructField("logs_count", T.LongType()), T.StructField("created_at", T.TimestampType()),
])

#: In order of rank, from 1; unknown is the highest.
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal", "unknown")
UNKNOWN_DEVICE = "unknown"
DEVICE_KEY = "deviceId"
#: Rows of a full segment.
SEGMENT_ROWS = 300_000
#: Bytes before the first record of a stored segment.
SEGMENT_HEADER = 13
