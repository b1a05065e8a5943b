"""Newest-first search, over a DataFrame at once or over a stored table day by day."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.fields import log_id
from siltstone.functions.filters import all_of, field_in
from siltstone.sources.logs import read_logs, stored_days
from siltstone.sources.scratch import materialize
from siltstone.sources.skipping import files_without

COUNT = 200
#: How far ahead of now a search looks if it is given no end: logs of clocks further ahead aren't found.
AHEAD = timedelta(days=200)


def _end(end: datetime | None) -> datetime:
    return datetime.now(timezone.utc) + AHEAD if end is None else end


def search(df: DataFrame, where: Column | None = None, count: int = COUNT, end: datetime | None = None) -> DataFrame:
    """The newest `count` logs that pass, up to and with `end` (None: AHEAD of now); ties in time by id. Each task keeps its own newest rows,
    so only count rows a task are moved."""
    if where is not None:
        df = df.where(where)
    return df.where(F.col("ts") <= F.lit(_end(end))).withColumn("id", log_id()).orderBy(F.desc("ts"), F.desc("id")).limit(count)


def _past(after_ts: datetime, after_id: int) -> Column:
    at, own = F.lit(after_ts), F.lit(str(after_id)).cast("decimal(38,0)")
    return (F.col("ts") <= at) & ((F.col("ts") < at) | (log_id() < own))


def search_page(df: DataFrame, where: Column | None, count: int, after_ts: datetime, after_id: int) -> DataFrame:
    """The page after the row (after_ts, after_id) of the page before."""
    past = _past(after_ts, after_id)
    return search(df, past if where is None else where & past, count, after_ts)


def search_stored(
    spark: SparkSession, path: str, where: Column | None = None, count: int = COUNT, end: datetime | None = None, after_id: int | None = None,
    props: Mapping[str, Iterable[str | int]] | None = None, index: str | None = None,
) -> DataFrame:
    """The rows of search over the table stored at path in folders by day, without reading what can't be among them.

    The newest day up to `end` is searched first, then two days before it, then four, and so on, until count rows are found or no day is left;
    days before that aren't opened. Each step is a job whose result, at most count rows, is stored. after_id: with end, the row after which a page starts.
    props: only logs whose property has one of the values, as field_in tests it. With an index (file_properties, stored by write_properties) a step also
    leaves out the files that, by the index, hold no such log; files that the index doesn't know are read.
    """
    props = {k: list(v) for k, v in (props or {}).items()}
    last = _end(end)
    tests = [field_in(k, v) for k, v in props.items()] + ([where] if where is not None else []) + ([_past(last, after_id)] if after_id is not None else [])
    days = [d for d in reversed(stored_days(spark, path)) if d <= (last.astimezone(timezone.utc) if last.tzinfo else last).date()]
    known = spark.read.parquet(index) if index and props else None
    logs, found, at, width = read_logs(spark, path), [], 0, 1
    while at < len(days) and count > 0:
        some = days[at : at + width]
        inside = F.col("day").between(F.lit(some[-1]), F.lit(some[0]))
        part = logs if known is None else read_logs(spark, path, files_without(known.where(inside), props))
        part = materialize(search(part.where(inside), all_of(*tests), count, last), "page")
        found.append(part)
        count, at, width = count - part.count(), at + width, 2 * width
    pages = reduce(DataFrame.unionByName, found) if found else search(logs.where("false"))
    return pages.orderBy(F.desc("ts"), F.desc("id"))


def dedupe_by_id(df: DataFrame) -> DataFrame:
    """One row per id. Of rows that repeat an id the one that stays is the least in all its columns, so it doesn't depend on their order."""
    rows = df.withColumn("id", log_id())
    least = rows.groupBy("id").agg(F.min(F.struct(*df.columns)).alias("_row"))
    return least.select("_row.*", "id")


def dedupe_stream(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first log of each id that arrives. The id holds the time, so repeats have equal times: state is dropped once the newest log is `delay` ahead,
    and so are logs that come later than that."""
    return stream.withColumn("id", log_id()).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def recent_and_archive(recent: DataFrame, archive: DataFrame, where: Column | None = None, count: int = COUNT) -> DataFrame:
    return search(recent.unionByName(archive), where, count)


def search_with_stats(df: DataFrame, where: Column, count: int = COUNT) -> tuple[DataFrame, Observation]:
    """A search, and an Observation with examined and matched once it has run; no second pass over the data."""
    seen = Observation("search")
    observed = df.observe(seen, F.count(F.lit(1)).alias("examined"), F.count(F.when(where, 1)).alias("matched"))
    return search(observed, where, count), seen
