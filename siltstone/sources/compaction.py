"""Compaction of stored logs by files.

Files of a day with too few rows are read, and only these; their rows are written anew in full files, which take their place. Other files aren't touched. The new
files are written aside, then the list of the old ones; from then on the job only goes forward: if it is broken off, the next call moves what isn't moved
and deletes what isn't deleted. Broken off before, it leaves the table as it was. While files are exchanged, readers may see rows twice, never none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.fields import log_id
from siltstone.functions.schema import SEGMENT_ROWS
from siltstone.operators.windows import number_in_blocks
from siltstone.sources import small_files
from siltstone.sources.batches import opens
from siltstone.sources.scratch import materialize

#: Folder of a running job, below the table; readers leave it out for its name.
ASIDE = "_compaction"
#: Rows that are dealt to a task together, where files are small.
LOT_ROWS = 20_000


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """(day, file, rows): from the files' footers, no column is read."""
    if opens(path):
        return small_files.file_counts(small_files.listed(spark, path)).select("day", "file", "rows")
    return spark.read.parquet(path).groupBy("day", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Ends what a job that was broken off has begun, or takes it back."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    system = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{path}/{ASIDE}"
    if system.exists(folder(f"{aside}/old/_SUCCESS")):
        old = spark.read.schema("file string").parquet(f"{aside}/old")
        if opens(path):
            if system.exists(folder(f"{aside}/new")):
                small_files.move_to_days(small_files.listed(spark, f"{aside}/new"), path)
            small_files.delete(small_files.dealt(old, old.count()))
            system.delete(folder(aside), True)
            return
        uri = spark._jvm.java.net.URI
        for found in system.globStatus(folder(f"{aside}/new/day=*/*.parquet")) or []:
            source = found.getPath()
            target = folder(f"{path}/{source.getParent().getName()}/{source.getName()}")
            system.mkdirs(target.getParent())
            if not system.rename(source, target):
                raise OSError(f"{source.toString()} can't be moved")
        for r in old.collect():  # names of the small files
            system.delete(folder(uri(r["file"])), False)
    system.delete(folder(aside), True)


def compact_files(spark: SparkSession, path: str, rows: int = SEGMENT_ROWS) -> int:
    """Days with two or more files of fewer than `rows` rows get these rewritten as files of `rows` rows, by device and time inside, and one with what is left over;
    the number of files that were replaced. A device or day larger than a task is numbered in blocks. One job at a time."""
    finish_compaction(spark, path)
    small = file_rows(spark, path).where(F.col("rows") < rows).groupBy("day").agg(F.collect_list("file").alias("files")).where(F.size("files") > 1)
    chosen = materialize(small.select("day", F.explode("files").alias("file")), "small-files")
    names = [r["file"] for r in chosen.select("file").collect()]  # names, as any scan holds them
    if not names:
        return 0
    aside, schema = f"{path}/{ASIDE}", small_files.table_schema(spark, path)
    if opens(path):
        # small files are opened once: their rows are read twice to be numbered
        small_files.read_files(small_files.dealt(chosen, len(names)), schema).write.parquet(f"{aside}/rows")
        logs = spark.read.schema(schema).parquet(f"{aside}/rows")
    else:
        uri = spark._jvm.java.net.URI
        logs = spark.read.option("basePath", path).parquet(*[uri(x).getPath() if x.startswith("file:") else x for x in names])
    order = [F.col("device_id"), F.col("ts"), log_id()]
    numbered = number_in_blocks(logs, "day", F.struct("device_id", F.date_trunc("hour", "ts").alias("hour")), order, "_number")
    if small_files.few_rows(path, rows):
        # a task gets whole files' rows, many files at a time, so only a day's last file ends early
        lots = numbered.withColumn("_lot", F.floor(F.col("_number") / F.lit(rows * max(1, LOT_ROWS // rows))))
        small_files.write_by_day(lots.repartition("day", "_lot").sortWithinPartitions("day", "_number").select(*schema.names), f"{aside}/new", rows)
    else:
        # a task may hold several files' rows: the number is a folder while they are written, so that none ends within another's rows
        numbered = numbered.withColumn("_file", F.floor(F.col("_number") / F.lit(rows)))
        dealt = numbered.repartition("day", "_file").sortWithinPartitions("day", "_file", "device_id", "ts")
        dealt.select(*schema.names, "_file").write.partitionBy("day", "_file").option("compression", "zstd").parquet(f"{aside}/made")
    _flatten(spark, aside)
    spark.createDataFrame([(x,) for x in names], "file string").write.parquet(f"{aside}/old")
    finish_compaction(spark, path)
    return len(names)


def _flatten(spark: SparkSession, aside: str) -> None:
    """made/day=D/_file=N/part becomes new/day=D/N-part."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    system = folder(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(folder(f"{aside}/made/day=*/_file=*/*.parquet")) or []:
        source = found.getPath()
        number, day = source.getParent().getName().removeprefix("_file="), source.getParent().getParent().getName()
        system.mkdirs(folder(f"{aside}/new/{day}"))
        if not system.rename(source, folder(f"{aside}/new/{day}/{number}-{source.getName()}")):
            raise OSError(f"{source.toString()} can't be moved")
