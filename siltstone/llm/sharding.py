"""Weighted rendezvous sharding.

Every record draws one pseudo-random score per shard from its key and the shard's number; the smallest
``-ln(u) / weight`` wins. The winner depends on the key and the shards alone, so a further shard only takes
records for itself and moves nothing between the old ones. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, number_within, table

SHARDS = 24
_UNIT = 1 << 53


def _score(key: Column, shard: int, weight: float) -> Column:
    u = (F.pmod(F.xxhash64(key, F.lit(shard)), F.lit(_UNIT)) + F.lit(0.5)) / F.lit(float(_UNIT))
    return -F.log(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the winning shard. weights: one positive number per shard; a shard of weight 2 takes twice the
    records of one of weight 1. A null key is a key like any other (all null keys meet in one shard)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one per shard")
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scores = [F.struct(_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*scores))["shard"]


def shard_records(df: DataFrame, key: str, weights: list[float], size: Column, slot_by: list[str]) -> DataFrame:
    """Adds size, shard, and slot (gapless from 0 in each shard, in an order fixed by the columns slot_by).

    df's columns are carried as they are, so select only what is wanted: wide columns would be stored and
    shuffled. Repeated rows get the same shard and different slots. An empty df gives no rows. A hot key is
    hot in its shard too, which the law demands; numbering is done in hash blocks all the same.
    """
    placed = df.withColumn("size", size).withColumn("shard", rendezvous(F.col(key), weights).cast("int"))
    return number_within(materialize(placed, "sharding"), "shard", [F.col(c) for c in slot_by], "slot")


def op7_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(F.col("doc_id"), [1.0] * (SHARDS + 1)).cast("int").alias("grown_shard"),
    )
    out = shard_records(narrow, "doc_id", [1.0] * SHARDS, F.col("_size"), ["doc_id", "text_crc32", "_size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
