"""Files of few rows: work that doesn't grow with one process, task or folder a file."""

from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from siltstone.functions.fields import device_id
from siltstone.sources import compaction as C
from siltstone.sources import logs as S
from siltstone.sources import small_files as M
from tests.test_fields import AT, logs


def tasks_of(spark, group, do):
    """Tasks of all jobs that do starts."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        do()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    seen = sc.statusTracker()
    stages = {i for j in seen.getJobIdsForGroup(group) for i in seen.getJobInfo(j).stageIds}
    return sum(info.numTasks for i in stages if (info := seen.getStageInfo(i)) is not None)


def table(spark, n):
    rows = logs(spark, *[(AT + timedelta(minutes=i), "info", [("deviceId", "abc"[i % 3])], f"m{i}") for i in range(n)])
    return rows.withColumn("device_id", device_id())


def same(spark, path, df):
    columns = ["random", "ts", "level", "props", "msg", "device_id", "day"]
    got = S.read_logs(spark, path).select(columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, df.withColumn("day", F.to_date("ts")).select(columns).collect()))


def test_tasks_of_a_compaction_are_fewer_than_its_files(spark, tmp_path):
    path, df = str(tmp_path / "some logs"), table(spark, 400)
    S.write_logs(df, path, rows=1)
    assert tasks_of(spark, "compaction", lambda: C.compact_files(spark, path, 20)) < 300
    assert len(list(Path(path).rglob("*.parquet"))) == 20
    same(spark, path, df)
    assert not [p for p in Path(path).rglob("*") if p.is_file() and p.suffix != ".parquet"]


def test_columns_that_files_lack(spark, tmp_path):
    """Files of Spark's writer, some without a column and with times of 96 bits."""
    path, df = str(tmp_path / "logs"), table(spark, 5).withColumn("day", F.to_date("ts"))
    before = spark.conf.get("spark.sql.parquet.outputTimestampType")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    try:
        df.drop("msg").write.partitionBy("day").parquet(path)
    finally:
        spark.conf.set("spark.sql.parquet.outputTimestampType", before)
    got = M.read_files(M.listed(spark, path), df.schema)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.withColumn("msg", F.lit(None).cast("string")).collect()))
    assert got.first()["day"] == date(2024, 5, 15)


def test_small_files_are_written_by_tasks(spark, tmp_path):
    """No checksum files of Hadoop's: each of them, and each file, would cost a process. Logs without a time have a folder too."""
    path, df = str(tmp_path / "logs"), table(spark, 200)
    df = df.unionByName(df.limit(3).withColumn("ts", F.lit(None).cast("timestamp")))
    S.write_logs(df, path, rows=7, buckets_per_device=2)
    same(spark, path, df)
    counts = [r["rows"] for r in C.file_rows(spark, path).collect()]
    assert max(counts) == 7 and sum(counts) == 203 and len(counts) < 60
    assert not [p for p in Path(path).rglob(".*")]


def test_property_bits_are_reduced_by_hash_before_any_sort(spark, tmp_path):
    """A sort of all properties would hold every row of a task's files."""
    from siltstone.sources.skipping import file_properties

    path = str(tmp_path / "logs")
    S.write_logs(table(spark, 50), path)
    bits = file_properties(spark, path)
    plan = bits._jdf.queryExecution().sparkPlan().toString()
    first = [line for line in plan.splitlines() if "Aggregate" in line or "Generate" in line]
    assert "HashAggregate" in first[first.index(next(x for x in first if "Generate" in x)) - 1]
    held = spark.read.parquet(path).select(F.col("_metadata.file_path"), "device_id").distinct().count()
    assert {(r["key"], r["n"]) for r in bits.groupBy("key").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()} == {("deviceId", held)}


def test_files_are_counted_without_a_scan(spark, tmp_path):
    path = str(tmp_path / "logs")
    S.write_logs(table(spark, 50), path, rows=8)
    counts = C.file_rows(spark, path)
    assert "Format: Parquet" not in counts._jdf.queryExecution().toString() and "parquet" not in counts._jdf.queryExecution().sparkPlan().toString().lower().split("location")[0]
    plain = spark.read.parquet(path).groupBy("day", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, plain.collect()))


def test_tasks_list_days(spark, tmp_path):
    """No scan with a task for every 32 files; names are those of _metadata.file_path, whatever the folder is called, and hidden files aren't there."""
    path = str(tmp_path / "some [x] ä% logs")
    df = table(spark, 50)
    S.write_logs(df.unionByName(df.limit(3).withColumn("ts", F.lit(None).cast("timestamp"))), path, rows=1)
    shown = path.replace("[", "\\[").replace("]", "\\]")
    plain = sorted(map(repr, spark.read.parquet(shown).select(F.col("_metadata.file_path").alias("file"), "day").distinct().collect()))
    for hidden in (".hidden.parquet", "_part.parquet", "note.txt"):
        (Path(path) / "day=2024-05-15" / hidden).write_bytes(b"none")
    assert sorted(map(repr, M.listed(spark, shown).collect())) == plain and len(plain) == 53


def test_listing_has_few_tasks(spark, tmp_path):
    path = str(tmp_path / "logs")
    S.write_logs(table(spark, 700), path, rows=1)
    assert "binaryFile" not in M.listed(spark, path)._jdf.queryExecution().toString()
    assert M.table_schema(spark, path) == spark.read.parquet(path).schema
    small = M.read_files(M.listed(spark, path).coalesce(1), M.table_schema(spark, path))
    assert tasks_of(spark, "counting", lambda: C.file_rows(spark, path).collect()) < 700 // 32 + M.LIST_TASKS * 4
    # rows of many files pass on together
    sizes = small.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), small.schema)
    assert sizes.count() == 1
