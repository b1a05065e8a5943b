"""Aggregations over logs, segments and devices. All combine map-side before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.fields import bucket_start, record_bytes


def histogram(df: DataFrame, where: Column | None = None, bucket_secs: int = 60) -> DataFrame:
    """(bucket: epoch second, count), newest bucket first; empty buckets are absent."""
    if where is not None:
        df = df.where(where)
    return df.groupBy(bucket_start(bucket_secs).alias("bucket")).agg(F.count("*").alias("count")).orderBy(F.desc("bucket"))


def segment_totals(segments: DataFrame) -> DataFrame:
    """Number of segments and sums; 0 for an empty table."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return segments.agg(F.count("*").alias("segment_count"), total("original_size"), total("compressed_size"), total("logs_count"))


def segment_averages(segments: DataFrame) -> DataFrame:
    """Averages over segment_totals; null where there is nothing to divide by."""
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return segment_totals(segments).select(
        d("logs_count", "segment_count").alias("logs_per_segment"), d("compressed_size", "segment_count").alias("bytes_per_segment"),
        (100 * d("compressed_size", "original_size")).alias("compression_percent"), d("original_size", "logs_count").alias("bytes_per_log"),
        d("compressed_size", "logs_count").alias("compressed_bytes_per_log"),
    )


def device_rollup(logs: DataFrame) -> DataFrame:
    """Per device: logs_count, logs_size (bytes of the stored records), last_upload_at (latest time)."""
    return logs.groupBy("device_id").agg(F.count("*").alias("logs_count"), F.sum(record_bytes()).alias("logs_size"), F.max("ts").alias("last_upload_at"))


def device_rates(devices: DataFrame) -> DataFrame:
    """devices with logs_per_second (0 without a positive span) and average_log_size (0 without logs)."""
    span = (F.unix_micros("last_upload_at") - F.unix_micros("created_at")).cast("double") / 1_000_000
    rate = F.when(span > 0, F.col("logs_count") / span).otherwise(0.0)
    size = F.when(F.col("logs_count") > 0, F.col("logs_size") / F.col("logs_count")).otherwise(0.0)
    return devices.withColumn("logs_per_second", rate).withColumn("average_log_size", size)


def fleet_totals(devices: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return device_rates(devices).agg(
        F.count("*").alias("devices"), total("logs_count").alias("logs_count"), total("logs_size").alias("logs_size"),
        F.coalesce(F.try_divide(F.sum("logs_size").cast("double"), F.sum("logs_count").cast("double")), F.lit(0.0)).alias("average_log_size"),
        F.coalesce(F.sum("logs_per_second"), F.lit(0.0)).alias("logs_per_second"),
    )


#: What a pivot groups by, and its column.
PIVOTS = {"level": "level", "device": "device_id", "timestamp": "ts", "message": "msg"}


def count_by(df: DataFrame, field: str) -> DataFrame:
    if field not in PIVOTS:
        raise ValueError(f"not a pivot: {field}")
    return df.groupBy(F.col(PIVOTS[field]).alias(field)).agg(F.count("*").alias("count"))


def prop_facets(device_props: DataFrame) -> DataFrame:
    """(key, values, n_values): the distinct values of each key, sorted. Pairs are made distinct before values are gathered. A key's list is one
    row's memory; keys with very many values, such as ids, are for prop_facet_rows."""
    return device_props.select("key", "value").distinct().groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("values"), F.count("*").alias("n_values"))


def prop_facet_rows(device_props: DataFrame) -> DataFrame:
    """(key, value, devices): a row per distinct value of each key with its number of devices; no list, so a key may have any number of values."""
    return device_props.select("device_id", "key", "value").distinct().groupBy("key", "value").agg(F.count("*").alias("devices"))


def template_counts(parsed: DataFrame) -> DataFrame:
    """(template_id, count) of parsed lines."""
    return parsed.groupBy("template_id").agg(F.count("*").alias("count"))


def template_total(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_distinct("template_id").alias("templates"))
