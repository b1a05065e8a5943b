"""Helpers that the training-data operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.scratch import BROADCAST_BYTES, if_small, materialize, shared_dir

__all__ = ["BROADCAST_BYTES", "give_back", "if_small", "materialize", "number_within", "semi_by_ids", "shared_dir", "shuffle_partitions", "table", "tokenizer_file"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def semi_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (stored and distinct). ids is broadcast if its bytes allow it; else both sides are shuffled."""
    return df.join(if_small(ids), key, "left_semi")


def number_within(df: DataFrame, group: str, by: list[Column], out: str) -> DataFrame:
    """Adds out: 0, 1, 2, ... without gaps in each group. A group is cut into hash blocks that are numbered
    apart and shifted by the sizes of the blocks before, so no group has to fit one task. df is read twice:
    pass a stored one."""
    n = shuffle_partitions(df.sparkSession)
    rows = df.withColumn("_block", F.pmod(F.xxhash64(*by), F.lit(n)))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(group, "_block").agg(F.count("*").alias("_n"))
        .select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(group, "_block").orderBy(*by)
    return (
        rows.withColumn("_row", F.row_number().over(inside).cast("long"))
        .join(starts, [group, "_block"])
        .withColumn(out, F.col("_start") + F.col("_row") - 1)
        .drop("_block", "_row", "_start")
    )


def give_back() -> None:
    """Returns to the system what earlier tasks of this Python worker have freed: workers serve stage after stage, and allocators keep what they once had."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; SILTSTONE_TOKENIZERS names another folder."""
    if folder := os.environ.get("SILTSTONE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
