"""Segments as a derived table, queries on it, and the retention and compaction jobs."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.fields import record_bytes, with_device_prop
from siltstone.functions.filters import _equals_any
from siltstone.functions.schema import SEGMENT_HEADER, SEGMENT_ROWS, UNKNOWN_DEVICE
from siltstone.operators.windows import cut_segments_in_blocks


def segment_summary(chunks: DataFrame, by: Iterable[str] = ("device_id", "chunk")) -> DataFrame:
    """Per chunk: first and last time, number of logs, and size with the header."""
    return chunks.groupBy(*by).agg(
        F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp"), F.count("*").alias("logs_count"),
        (F.sum(record_bytes()) + SEGMENT_HEADER).alias("original_size"),
    )


def segment_props(chunks: DataFrame, by: Iterable[str] = ("device_id", "chunk")) -> DataFrame:
    """Distinct (key, value) per chunk, with its levels as properties named level."""
    level = F.struct(F.lit("level").alias("key"), F.col("level").alias("value"))
    pairs = chunks.select(*by, F.explode(F.array_append("props", level)).alias("p"))
    return pairs.select(*by, "p.key", "p.value").distinct()


def segments_with_prop(segments: DataFrame, props: DataFrame, key: str, values: Iterable[str | int], by: Iterable[str] = ("device_id", "chunk")) -> DataFrame:
    """Segments of whose values of a key one equals one of values (as versions or texts)."""
    hits = props.where((F.col("key") == key) & F.coalesce(_equals_any(F.col("value"), values), F.lit(False)))
    return segments.join(hits, list(by), "left_semi")


def segments_overlapping(segments: DataFrame, start: datetime | None = None, end: datetime | None = None, devices: Iterable[str] | None = None, count: int = 100, sort: str | None = None) -> DataFrame:
    """Segments with last > start and first <= end, of the listed devices (an empty list: none); sort: asc or desc by
    first time, else by id."""
    out = segments
    if start is not None:
        out = out.where(F.col("last_timestamp") > F.lit(start))
    if end is not None:
        out = out.where(F.col("first_timestamp") <= F.lit(end))
    if devices is not None:
        out = out.where(F.col("device_id").isin(list(devices)))
    order = {"asc": [F.asc("first_timestamp"), F.asc("id")], "desc": [F.desc("first_timestamp"), F.desc("id")], None: [F.asc("id")]}[sort]
    return out.orderBy(*order).limit(count)


def segment_covers(segments: DataFrame, ts: datetime, devices: Iterable[str] | None = None) -> DataFrame:
    """One row: whether a segment has first <= ts <= last."""
    out = segments if devices is None else segments.where(F.col("device_id").isin(list(devices)))
    inside = (F.col("first_timestamp") <= F.lit(ts)) & (F.col("last_timestamp") >= F.lit(ts))
    return out.agg((F.count(F.when(inside, 1)) > 0).alias("covered"))


def previous_segment_end(segments: DataFrame, ts: datetime, devices: Iterable[str] | None = None) -> DataFrame:
    """One row: the greatest last time at or before ts, or null."""
    out = segments if devices is None else segments.where(F.col("device_id").isin(list(devices)))
    return out.where(F.col("last_timestamp") <= F.lit(ts)).agg(F.max("last_timestamp").alias("previous_end"))


def retention_split(segments: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """(dropped, kept): the n segments with the earliest first time, ties by id, and the others."""
    dropped = segments.orderBy("first_timestamp", "id").limit(n)
    return dropped, segments.join(dropped.select("id"), "id", "left_anti")


def retain_logs(logs: DataFrame, dropped: DataFrame, by: Iterable[str] = ("device_id", "chunk")) -> DataFrame:
    """Logs of no dropped segment."""
    return logs.join(dropped, list(by), "left_anti")


def compact(chunks: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """Chunks of devices with two or more that are below `size`, cut anew into full ones. chunks: logs with chunk. Rewritten
    logs get new chunk numbers after the device's largest; others keep theirs. No log is lost."""
    sizes = chunks.groupBy("device_id", "chunk").agg(F.count("*").alias("_n"))
    device = Window.partitionBy("device_id")
    small = F.col("_n") < size
    marked = sizes.select(
        "device_id", "chunk", (small & (F.count(F.when(small, 1)).over(device) >= 2)).alias("_small"), (F.max("chunk").over(device) + 1).alias("_next"),
    )
    rows = chunks.join(marked, ["device_id", "chunk"])
    again = cut_segments_in_blocks(rows.where("_small").drop("chunk"), size)  # a device may be larger than a task
    again = again.withColumn("chunk", F.col("chunk") + F.col("_next"))
    return rows.where(~F.col("_small")).unionByName(again).select(chunks.columns)


def assign_orphans(chunks: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """Logs of segments without a device (device_id null) regrouped by the device that each log names; logs that name none
    go to the unknown device and get the property. Logs of other segments aren't in the result."""
    orphans = chunks.where(F.col("device_id").isNull()).withColumn("props", with_device_prop("props"))
    named = F.coalesce(F.get(F.filter("props", lambda p: p["key"] == "deviceId"), F.lit(0))["value"], F.lit(UNKNOWN_DEVICE))
    # all that name no device are one device, so it is cut in blocks
    return cut_segments_in_blocks(orphans.withColumn("device_id", named).drop("chunk"), size)
