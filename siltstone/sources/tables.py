"""A small stored table whose versions are swapped whole, with a ledger of the batches that are in it.

folder/data/N is version N, folder/ledger/version=N one row (batch) that is written when the version is complete: what isn't in the ledger isn't there. A batch
that comes again finds itself in the ledger and changes nothing; a version that a crash left half-written is written anew. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.schema import DEVICES

#: Versions that stay, for readers of the one before.
KEPT = 2


def _state(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Newest version and its batch; -1 where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return -1, -1
    row = spark.read.schema("batch long, version int").parquet(f"{folder}/ledger").agg(F.max(F.struct("version", "batch")).alias("x")).first()["x"]
    return (-1, -1) if row is None else (row["version"], row["batch"])


def _put(spark: SparkSession, folder: str, version: int, batch: int, rows: DataFrame) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/data/{version}")
    spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/version={version}")
    for part in (f"data/{version - KEPT}", f"ledger/version={version - KEPT}"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def create_table(rows: DataFrame, folder: str) -> None:
    """The table's first version, or a new one with other rows; no batch is in it."""
    spark = rows.sparkSession
    _put(spark, folder, _state(spark, folder)[0] + 1, -1, rows)


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version; without one an empty table of devices."""
    version, _ = _state(spark, folder)
    return spark.createDataFrame([], DEVICES) if version < 0 else spark.read.parquet(f"{folder}/data/{version}")


def merge_once(spark: SparkSession, folder: str, batch: int, update: Callable[[DataFrame], DataFrame]) -> bool:
    """Puts update(the table) in the table's place unless the batch, or a later one, is in it already; whether it did. Batches are numbered upwards."""
    version, last = _state(spark, folder)
    if batch <= last:
        return False
    _put(spark, folder, version + 1, batch, update(read_table(spark, folder)))
    return True
