"""A small table beside stored logs that says which files can hold a property with a value.

For every file and property key it has one bitmap of 32,768 bits, in which each value of the key sets a bit. Its size doesn't depend on how many
values there are; with very many of them the bitmap is full and leaves out nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.fields import semver, version_of

BITS = 32_768


def _canonical(value: Column) -> Column:
    """Equal for values that field_in may take for equal: versions by their three numbers, other texts as they are."""
    v = semver(value)
    return F.coalesce(F.concat(F.lit("v"), *[F.concat(v[p].cast("string"), F.lit("/")) for p in ("major", "minor", "patch")]), F.concat(F.lit("t"), value))


def _canonical_text(value: str | int) -> str:
    parts = version_of(str(value))
    return f"t{value}" if parts is None else "v" + "".join(f"{n}/" for n in parts)


def _bit(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(BITS))


def file_properties(spark: SparkSession, path: str) -> DataFrame:
    """(file, day, key, bits) of the table at path. Each task keeps the distinct bits of its files, by hash; only these are moved, and sorted for the bitmaps, so memory
    grows with the values of a file and not with its rows."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), "day", F.explode("props").alias("p"))
    bits = rows.select("file", "day", F.col("p.key").alias("key"), _bit(_canonical(F.col("p.value"))).alias("bit")).distinct()
    return bits.groupBy("file", "day", "key").agg(F.bitmap_construct_agg("bit").alias("bits"))


def write_properties(spark: SparkSession, path: str, index: str, mode: str = "overwrite") -> None:
    """Stores file_properties of path, and a row without a key for every file, so that files without properties are known too."""
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), "day").distinct()
    rows = file_properties(spark, path).unionByName(files.select("file", "day", F.lit("").alias("key"), F.lit(None).cast("binary").alias("bits")))
    rows.write.mode(mode).option("compression", "zstd").parquet(index)


def files_without(index: DataFrame, props: Mapping[str, Iterable[str | int]]) -> set[str]:
    """Files of the index that, for some of props, have no log whose property has one of the values. A file's name is held on the driver, as it is for any scan."""
    holds = []
    for key, values in props.items():
        bits = [_bit(F.lit(_canonical_text(v))) for v in values]
        byte = lambda b: F.conv(F.hex(F.substring("bits", (F.floor(b / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = [F.getbit(byte(b), (b % 8).cast("int")) == 1 for b in bits]
        holds.append(F.coalesce(F.bool_or((F.col("key") == key) & reduce(or_, hit)), F.lit(False)) if hit else F.lit(False))
    kept = index.groupBy("file").agg(reduce(and_, holds, F.lit(True)).alias("may"))
    return {r["file"] for r in kept.where("not may").select("file").collect()}
