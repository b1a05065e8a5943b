"""Search over stored days and files: what isn't opened, and that nothing is lost."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from siltstone.functions import filters as X
from siltstone.functions.fields import device_id
from siltstone.operators import search as Q
from siltstone.sources import logs as S
from siltstone.sources.skipping import files_without, write_properties
from tests.test_fields import AT, logs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def days(spark):
    """30 days of 40 logs."""
    rows = [(START + timedelta(days=d, minutes=7 * i), "error" if i % 4 == 0 else "info", [("k", str(i)), ("v", f"1.{d}")] + [("deviceId", "a")] * (i % 2), f"day {d} log {i}") for d in range(30) for i in range(40)]
    return logs(spark, *rows).withColumn("device_id", device_id()).cache()


@pytest.fixture
def table(days, tmp_path):
    path = str(tmp_path / "logs")
    S.write_logs(days, path)
    return path


def spoil(path, keep):
    """Makes the files of all folders unreadable but those of the days `keep` and of the first, where Spark finds the schema."""
    from pathlib import Path

    for p in Path(path).rglob("*.parquet"):
        if p.parent.name not in {f"day=2024-01-{d:02d}" for d in [1, *keep]}:
            p.write_bytes(b"no parquet")
            (p.parent / f".{p.name}.crc").unlink(missing_ok=True)


def same(a, b):
    assert [r.asDict() for r in a.select("id", "ts", "msg").collect()] == [r.asDict() for r in b.select("id", "ts", "msg").collect()]


@pytest.mark.parametrize("where, count, end", [
    (None, 25, None), ("error", 25, None), ("error", 1_000, None), ("day 3 ", 5, None), ("nowhere", 5, None), (None, 0, None), (None, 55, START + timedelta(days=9, hours=2)), ("error", 7, START - timedelta(days=1)),
])
def test_stored_equals_plain(spark, days, table, where, count, end):
    test = None if where is None else X.msg_like(where) if where != "error" else X.level_cmp(">=", "error")
    same(Q.search_stored(spark, table, test, count, end), Q.search(days, test, count, end))


def test_older_days_are_not_opened(spark, days, table):
    spoil(table, keep=[30])
    assert Q.search_stored(spark, table, None, 40).count() == 40
    spoil(table, keep=[30])  # three days at most: of the newest, and of two more
    with pytest.raises(Exception):
        Q.search_stored(spark, table, None, 41).count()


def test_second_step(spark, days, table):
    spoil(table, keep=[30, 29, 28])
    same(Q.search_stored(spark, table, X.level_cmp("=", "error"), 30), Q.search(days, X.level_cmp("=", "error"), 30))


def test_pages(spark, days, table):
    where, seen, end, last = X.level_cmp("=", "error"), [], None, None
    for _ in range(5):
        page = Q.search_stored(spark, table, where, 70, end, last).collect()
        seen += [r["id"] for r in page]
        if page:
            end, last = page[-1]["ts"].replace(tzinfo=timezone.utc), int(page[-1]["id"])
    assert seen == [r["id"] for r in Q.search(days, where, 1_000).collect()] and len(seen) == 300


def test_default_end(spark):
    now = datetime.now(timezone.utc)
    df = logs(spark, (now + timedelta(days=199), "info", [], "soon"), (now + timedelta(days=201), "info", [], "far"))
    assert [r["msg"] for r in Q.search(df).collect()] == ["soon"]
    assert [r["msg"] for r in Q.search(df, end=now + timedelta(days=300)).collect()] == ["far", "soon"]


@pytest.mark.parametrize("test", [
    lambda day: X.ts_cmp(">=", START + timedelta(days=27), day), lambda day: X.time_range(START + timedelta(days=27), None, day),
    lambda day: X.any_of(X.ts_cmp(">", START + timedelta(days=27, hours=1), day), X.all_of(X.ts_cmp("=", START + timedelta(days=28), day), X.msg_like("log"))),
    lambda day: X.all_of(X.ts_cmp("!=", START + timedelta(days=28), day), X.ts_cmp(">", START + timedelta(days=28), day)),
])
def test_filters_prune_days(spark, days, table, test):
    spoil(table, keep=[28, 29, 30])
    got = S.read_logs(spark, table).where(test("day"))
    assert got.count() == days.where(test(None)).count() > 0
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [((day" in got._jdf.queryExecution().executedPlan().toString()


def test_stored_days(spark, table, tmp_path):
    assert [d.day for d in S.stored_days(spark, table)] == list(range(1, 31))
    assert S.stored_days(spark, str(tmp_path / "none")) == []


def test_files_are_chosen_by_properties(spark, days, tmp_path):
    path, index = str(tmp_path / "logs"), str(tmp_path / "index")
    S.write_logs(days, path)
    write_properties(spark, path, index)
    known = spark.read.parquet(index)
    for props, only in (({"v": ["1.7.0"]}, {8}), ({"v": ["+1.7.0-x"]}, {8}), ({"v": [17]}, set()), ({"v": ["1.3", "1.4"], "k": [3]}, {4, 5}), ({"none": ["1"]}, set()), ({"v": []}, set()), ({}, set(range(1, 31)))):
        out = files_without(known, props)
        assert set(range(1, 31)) - {int(f.split("day=2024-01-")[1][:2]) for f in out} == only
        assert S.read_logs(spark, path, out).count() == 40 * len(only)
        test = X.all_of(*[X.field_in(k, v) for k, v in props.items()])
        same(Q.search_stored(spark, path, None, 30, props=props, index=index), Q.search(days, test, 30))
    spoil(path, keep=[8])
    assert Q.search_stored(spark, path, None, 50, props={"v": ["1.7"]}, index=index).count() == 40


def test_unknown_files_are_read(spark, days, tmp_path):
    path, index = str(tmp_path / "logs"), str(tmp_path / "index")
    S.write_logs(days.where("msg like 'day 1%'"), path)
    write_properties(spark, path, index)
    S.write_logs(logs(spark, (START + timedelta(days=3), "info", [("v", "1.11")], "later"), (START + timedelta(days=5), "info", [], "bare")).withColumn("device_id", device_id()), path)
    got = Q.search_stored(spark, path, None, 100, props={"v": ["1.11"]}, index=index).collect()
    assert len(got) == 41 and got[-1]["msg"] == "later"


def test_dedupe_keeps_the_least(spark, tmp_path):
    df = logs(spark, (AT, "info", [], "b"), (AT, "info", [], "c")).withColumn("random", F.lit(5).cast("long"))
    for rows in (df.repartition(2), df.orderBy(F.desc("msg")), df.unionByName(df)):
        assert [r["msg"] for r in Q.dedupe_by_id(rows).collect()] == ["b"]
    df.unionByName(df).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    Q.dedupe_stream(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 1
