"""Reading and writing logs: Parquet, JSON lines, text lines, and the events table as logs."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.fields import device_id, log_id
from siltstone.functions.schema import DEVICE_KEY, LOGS, PROPS, SEGMENT_ROWS
from siltstone.sources.small_files import few_rows, write_by_day


def canonical(df: DataFrame) -> DataFrame:
    """The columns of logs with their types, and device_id. Missing props are an empty list."""
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOGS])
    out = out.withColumn("props", F.coalesce("props", F.array().cast(PROPS)))
    if "device_id" in df.columns:
        return out.withColumn("device_id", F.coalesce(df["device_id"].cast("string"), device_id("props")))
    return out.withColumn("device_id", device_id("props"))


def read_logs(spark: SparkSession, path: str, without: Iterable[str] = ()) -> DataFrame:
    """Stored logs. A stored device_id column is used as it is, so filters on it reach the scan. without: files, as _metadata.file_path names them, that
    are left out when the scan is planned."""
    df = spark.read.parquet(path)
    if out := sorted(without):
        df = df.where(~F.col("_metadata.file_path").isin(out))
    out = [F.col(f.name).cast(f.dataType).alias(f.name) for f in LOGS]
    return df.select(*out, F.col("device_id") if "device_id" in df.columns else device_id("props").alias("device_id"), *(["day"] if "day" in df.columns else []))


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """The days that a table has folders for, the oldest first. Folders are listed; no file is opened."""
    folders = spark._jvm.org.apache.hadoop.fs.Path
    system = folders(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(folders(f"{path.rstrip('/')}/{{day=*,*/day=*}}")) or []
    names = {x.getPath().getName().removeprefix("day=") for x in found}
    return sorted(date.fromisoformat(n) for n in names if n[:1].isdigit())


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the shape of logs. Every tenth user names no device; every seventh event repeats key k."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, user = F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    kind = F.col("event_type")
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    n = k.cast("int")
    device = F.when(F.col("user_id") % 10 != 0, F.array(pair(DEVICE_KEY, user))).otherwise(F.array().cast(PROPS))
    version = F.concat(F.lit("1."), (n % 12).cast("string"), F.lit("."), (n % 7).cast("string"))
    again = F.when(F.col("event_id") % 7 == 0, F.array(pair("k", F.lit("dup")))).otherwise(F.array().cast(PROPS))
    return e.select(
        F.lit(1).alias("version"), F.col("event_id").alias("random"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "view", "debug").when(kind.isin("click", "signup"), "info").when(kind == "purchase", "warn").when(kind == "error", "error").otherwise("unknown").alias("level"),
        F.concat(device, F.array(pair("k", k), pair("version", version)), again).alias("props"),
        F.concat(kind, F.lit(" user "), user, F.lit(" k "), k).alias("msg"),
        F.when(F.col("user_id") % 10 != 0, user).otherwise("unknown").alias("device_id"),
    )


def drop_bad_clocks(df: DataFrame, now: datetime) -> DataFrame:
    """Keeps years from last year to ten years ahead, as a range on ts so that it reaches the scan."""
    low, high = datetime(now.year - 1, 1, 1), datetime(now.year + 11, 1, 1)
    return df.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))


def write_logs(df: DataFrame, path: str, mode: str = "append", rows: int = SEGMENT_ROWS, buckets_per_device: int | None = None) -> None:
    """Parquet by day, grouped by device and sorted by time inside, with at most `rows` rows a file. The rows are rebalanced by their measured
    bytes: a device with very many logs of a day is split over tasks of the advisory size, small ones share a task.
    buckets_per_device spreads every device over that many tasks instead. Files of few rows are written by tasks themselves."""
    days = df.withColumn("day", F.to_date("ts"))
    if buckets_per_device is None:
        dealt = days.hint("rebalance", F.col("day"), F.col("device_id"))
    else:
        dealt = days.repartition("day", "device_id", F.pmod(F.xxhash64("ts", "random"), F.lit(buckets_per_device)))
    dealt = dealt.sortWithinPartitions("day", "device_id", "ts")
    if mode == "append" and few_rows(path, rows):
        write_by_day(dealt, path, rows)
    else:
        dealt.write.mode(mode).partitionBy("day").option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)


def json_line() -> Column:
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.to_json(F.struct(log_id().cast("string").alias("id"), "version", ts.alias("timestamp"), "level", "msg", "props"))


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(json_line().alias("value"))


def text_line(millis: bool = True) -> Column:
    """Time, level in capitals, properties and message on one line; CR and LF become blanks."""
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS" if millis else "yyyy-MM-dd HH:mm:ss")
    props = F.array_join(F.transform("props", lambda p: F.concat(F.lit(" "), p["key"], F.lit("="), p["value"])), "")
    flat = F.translate(F.concat(at, F.lit(" "), F.upper("level"), props), "\r\n", "  ")
    msg = F.trim(F.translate("msg", "\r\n", "  "))
    return F.concat(flat, F.when(F.coalesce(msg, F.lit("")) != "", F.concat(F.lit(" "), msg)).otherwise(""))


def to_text_lines(df: DataFrame, millis: bool = True) -> DataFrame:
    return df.select(text_line(millis).alias("value"))


_JSON = "id string, version int, timestamp timestamp, level string, msg string, message string, props array<struct<key:string,value:string>>"


def from_json_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Logs from exported JSON texts; msg or message; missing props are empty. Lines without a readable time are no logs: unreadable_json_lines has them."""
    rows = lines.select(F.from_json(value, _JSON).alias("x")).where("x.timestamp is not null").select("x.*")
    return canonical(rows.select(
        "version", F.pmod(F.col("id").try_cast("decimal(38,0)"), F.lit(2**32)).cast("long").alias("random"), F.col("timestamp").alias("ts"),
        "level", "props", F.coalesce("msg", "message").alias("msg"),
    ))


def unreadable_json_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines, with their columns, that from_json_lines leaves out, and why: 'no json', or 'no time' where the time is missing or none. Blank lines are no lines."""
    text = F.col(value)
    bad = lines.where(text.isNotNull() & (F.trim(text) != "") & F.from_json(value, _JSON)["timestamp"].isNull())
    return bad.withColumn("reason", F.when(F.try_parse_json(value).isNull(), "no json").otherwise("no time"))


def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    return from_json_lines(spark.read.text(path))


def read_json_logs_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(logs, lines that are none, with their reason and file)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return from_json_lines(lines), unreadable_json_lines(lines)


def write_templates_csv(parsed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """TemplateID;Text for each line, in folders of part files."""
    parsed.select(F.col("template_id").alias("TemplateID"), F.col("text").alias("Text")).write.mode(mode).option("sep", ";").option("header", True).csv(path)
