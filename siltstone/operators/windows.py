"""Window operators; each is partitioned by device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from siltstone.functions.fields import log_id
from siltstone.functions.schema import SEGMENT_ROWS


def cut_segments(df: DataFrame, size: int = SEGMENT_ROWS, device: str = "device_id") -> DataFrame:
    """Adds chunk: 0, 1, ... for each device's consecutive runs of at most `size` logs in time order."""
    order = Window.partitionBy(device).orderBy("ts", log_id())
    return df.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / F.lit(size)).cast("int"))


def number_in_blocks(df: DataFrame, device: str, block: Column, order: list[Column], out: str) -> DataFrame:
    """Adds out: 0, 1, ... in each device's order. block ascends with order; rows are numbered within a device and block, and shifted by the
    counts of the blocks before, so that no task has to hold a device."""
    blocks = df.withColumn("_block", block)
    starts = blocks.groupBy(F.col(device).alias("_device"), F.col("_block").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_device").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_device", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = blocks.withColumn("_row", F.row_number().over(Window.partitionBy(device, "_block").orderBy(*order)))
    rows = rows.join(starts, rows[device].eqNullSafe(starts["_device"]) & (rows["_block"] == starts["_of"]))
    return rows.withColumn(out, F.col("_start") + F.col("_row") - 1).drop("_block", "_row", "_start", "_device", "_of")


def cut_segments_in_blocks(df: DataFrame, size: int = SEGMENT_ROWS, block_secs: int = 86_400, device: str = "device_id") -> DataFrame:
    """cut_segments for devices too large for one task, numbered in blocks of time. The result is the same."""
    block = F.floor(F.unix_seconds("ts") / F.lit(block_secs))
    rows = number_in_blocks(df, device, block, [F.col("ts"), log_id()], "_number")
    return rows.withColumn("chunk", F.floor(F.col("_number") / F.lit(size)).cast("int")).drop("_number")


def sequence_windows(
    df: DataFrame, w: int = 10, target: int = 1, value: str = "template_id", device: str = "device_id", order: tuple[str, ...] = ("ts", "id"),
    block: Column | None = None, block_rows: int = 100_000,
) -> DataFrame:
    """(device, pos, x, y): each full window of w values with the `target` values after it, in time order.

    Rows are numbered block by block, and windows are made over stretches of block_rows rows, each with the first rows of the next, so that no task has to hold a
    device. block: a column that ascends with order; by default the day of the first of order, if that is a time. Only where it is none, and no block is
    given, a device is one task. The result is the same.
    """
    ahead = w + target - 1
    if block is None and isinstance(df.schema[order[0]].dataType, (TimestampType, TimestampNTZType, DateType)):
        block = F.to_date(order[0])
    if block is None:
        frame = Window.partitionBy(device).orderBy(*order)
        rows = df.select(device, (F.row_number().over(frame) - 1).alias("_number"), F.collect_list(value).over(frame.rowsBetween(0, ahead)).alias("_all"))
    else:
        step = max(block_rows, ahead + 1)
        rows = number_in_blocks(df, device, block, [F.col(c) for c in order], "_number").select(device, "_number", value)
        own = F.floor(F.col("_number") / F.lit(step))
        also = F.when((F.col("_number") % step < ahead) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
        rows = rows.withColumn("_stretch", F.explode(also))
        frame = Window.partitionBy(device, "_stretch").orderBy("_number").rowsBetween(0, ahead)
        rows = rows.select(device, "_number", "_stretch", F.collect_list(value).over(frame).alias("_all")).where(F.floor(F.col("_number") / F.lit(step)) == F.col("_stretch"))
    rows = rows.where(F.size("_all") == w + target)
    return rows.select(device, (F.col("_number") + 1).cast("int").alias("pos"), F.slice("_all", 1, w).alias("x"), F.slice("_all", w + 1, target).alias("y"))
