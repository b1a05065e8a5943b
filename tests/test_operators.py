from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from siltstone.functions.fields import device_id
from siltstone.functions.filters import level_cmp, msg_like
from siltstone.functions.schema import DEVICE_PROPS, DEVICES
from siltstone.operators import aggregates as A
from siltstone.operators import devices as J
from siltstone.operators import search as Q
from siltstone.operators import segments as C
from siltstone.operators import windows as W
from tests.test_fields import AT, logs

H = timedelta(hours=1)


def table(spark, *rows):
    return logs(spark, *rows).withColumn("device_id", device_id())


def dev(name):
    return [("deviceId", name)] if name else []


def test_search_order_and_pages(spark):
    df = table(spark, (AT - 12 * H, "info", dev("a"), "b"), (AT - 36 * H, "info", dev("b"), "c"), (AT - 6 * H, "info", dev("a"), "a"), (AT - 6 * H, "info", dev("a"), "tie"))
    out = Q.search(df).collect()
    assert [r["msg"] for r in out] == ["tie", "a", "b", "c"]
    page = Q.search(df, None, 2).collect()[-1]
    assert [r["msg"] for r in Q.search_page(df, None, 2, page["ts"], int(page["id"])).collect()] == ["b", "c"]
    assert [r["msg"] for r in Q.search(df, msg_like("A"), 5, AT).collect()] == ["a"]
    assert [r["msg"] for r in Q.search(df, end=AT - 12 * H).collect()] == ["b", "c"]
    plan = Q.search(df)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_union_dedupe_stats(spark):
    fresh, stored = table(spark, (AT, "info", [], "fresh")), table(spark, (AT - 30 * H, "warn", [], "stored"))
    assert [r["msg"] for r in Q.recent_and_archive(fresh, stored).collect()] == ["fresh", "stored"]
    assert Q.dedupe_by_id(fresh.unionByName(fresh)).count() == 1
    out, seen = Q.search_with_stats(fresh.unionByName(stored), level_cmp(">", "info"))
    assert [r["msg"] for r in out.collect()] == ["stored"]
    assert seen.get == {"examined": 2, "matched": 1}


def test_histogram(spark):
    df = table(spark, *[(AT + timedelta(seconds=s), "info", [], "") for s in (0, 10, 70)])
    assert [r["count"] for r in A.histogram(df).collect()] == [1, 2]
    assert A.histogram(df, level_cmp(">", "info")).count() == 0


def test_empty_totals(spark):
    empty = spark.createDataFrame([], "original_size long, compressed_size long, logs_count long")
    assert tuple(A.segment_totals(empty).first()) == (0, 0, 0, 0)
    assert set(A.segment_averages(empty).first()) == {None}
    assert tuple(A.fleet_totals(spark.createDataFrame([], DEVICES)).first()) == (0, 0, 0, 0.0, 0.0)


def test_device_rates(spark):
    rows = [("a", True, 3, 100, 10, AT, AT + 10 * timedelta(seconds=1), 60), ("b", True, 3, 0, 0, AT, AT, 60), ("c", True, 3, 5, 5, AT, None, 60)]
    out = {r["id"]: (r["logs_per_second"], r["average_log_size"]) for r in A.device_rates(spark.createDataFrame(rows, DEVICES)).collect()}
    assert out == {"a": (1.0, 10.0), "b": (0.0, 0.0), "c": (0.0, 1.0)}


def test_cut_and_blocks(spark):
    rows = [(AT + k * H, "info", dev(d), f"{d}{k}") for d in ("a", "b", None) for k in range(11)]
    df = table(spark, *rows)
    cut = W.cut_segments(df, 5)
    sizes = sorted((r["device_id"], r["count"]) for r in cut.groupBy("device_id", "chunk").count().collect())
    assert sizes == sorted((d, n) for d in ("a", "b", "unknown") for n in (5, 5, 1))
    blocks = W.cut_segments_in_blocks(df, 5, 3600 * 4)
    assert cut.select("msg", "chunk").exceptAll(blocks.select("msg", "chunk")).count() == 0
    assert blocks.count() == 33


def test_sequences(spark):
    df = spark.createDataFrame([("d", i, i, i * 10) for i in range(6)] + [("e", 0, 0, 1)], "device_id string, ts int, id int, template_id int")
    out = W.sequence_windows(df, 3, 1).orderBy("pos").collect()
    assert [(r["device_id"], r["x"], r["y"]) for r in out] == [("d", [0, 10, 20], [30]), ("d", [10, 20, 30], [40]), ("d", [20, 30, 40], [50])]


def test_large_device(spark):
    """A device with nine in ten rows: blocks give what one task would."""
    rows = [(AT + timedelta(minutes=7 * k), "info", dev("big" if k % 10 else "small"), f"m{k}") for k in range(600)]
    df = table(spark, *rows)
    lines = df.withColumn("template_id", F.col("random").cast("int")).withColumn("id", F.col("random"))
    whole = W.sequence_windows(lines, 5, 2)
    blocks = W.sequence_windows(lines, 5, 2, block=F.to_date("ts"), block_rows=20)
    assert whole.count() == 540 - 6 + 60 - 6 and whole.exceptAll(blocks).count() == 0 and blocks.exceptAll(whole).count() == 0
    parts = df.withColumn("chunk", F.col("random").cast("int"))
    out = C.compact(parts, 50).groupBy("device_id", "chunk").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("device_id", "a").collect()
    assert [r["n"] for r in out] == [50] * 10 + [40, 50, 10]
    assert all(x["b"] < y["a"] for x, y in zip(out, out[1:], strict=False) if x["device_id"] == y["device_id"])


def test_segments(spark):
    df = table(spark, *[(AT + k * H, "info" if k else "warn", dev("a"), "m") for k in range(4)])
    cut = W.cut_segments(df, 2)
    summary = C.segment_summary(cut).orderBy("chunk").collect()
    assert [(r["chunk"], r["logs_count"], r["original_size"]) for r in summary] == [(0, 2, 2 * 32 + 13), (1, 2, 2 * 32 + 13)]
    props = C.segment_props(cut)
    assert {(r["chunk"], r["key"], r["value"]) for r in props.collect()} == {(0, "deviceId", "a"), (0, "level", "warn"), (0, "level", "info"), (1, "deviceId", "a"), (1, "level", "info")}
    hit = C.segments_with_prop(C.segment_summary(cut), props, "level", ["warn"]).collect()
    assert [r["chunk"] for r in hit] == [0]


def test_segment_queries(spark):
    shape = "id int, device_id string, first_timestamp timestamp, last_timestamp timestamp"
    s = spark.createDataFrame([(1, "dev1", AT - 2 * H, AT - H), (2, "dev2", AT - 6 * H, AT - 5 * H)], shape)
    assert [r["id"] for r in C.segments_overlapping(s, AT - 1.5 * H, AT).collect()] == [1]
    assert [r["id"] for r in C.segments_overlapping(s, sort="asc").collect()] == [2, 1]
    assert C.segments_overlapping(s, devices=[]).count() == 0
    assert C.segments_overlapping(s, start=AT - H).count() == 0
    assert C.segment_covers(s, AT - 1.5 * H).first()[0] is True
    assert C.segment_covers(s, AT - 1.5 * H, ["dev2"]).first()[0] is False
    assert C.previous_segment_end(s, AT, ["dev2"]).first()[0] == (AT - 5 * H).replace(tzinfo=None)
    assert C.previous_segment_end(s, AT - 9 * H).first()[0] is None
    dropped, kept = C.retention_split(s, 1)
    assert [r["id"] for r in dropped.collect()] == [2] and [r["id"] for r in kept.collect()] == [1]


def test_compact(spark):
    small = [(AT - k * H, "info", dev("a"), f"m{k}") for k in range(3)]
    df = table(spark, *small).withColumn("chunk", F.col("random").cast("int"))
    out = C.compact(df, 10)
    assert out.count() == 3 and out.select("chunk").distinct().count() == 1
    alone = df.where("chunk = 0")
    assert C.compact(alone, 10).first()["chunk"] == 0


def test_orphans(spark):
    rows = [(AT + timedelta(minutes=k), "info", dev(f"dev{k % 4}") if k % 5 else [], f"m{k}") for k in range(40)]
    df = table(spark, *rows).withColumn("device_id", F.lit(None).cast("string")).withColumn("chunk", F.lit(1))
    out = C.assign_orphans(df, 7)
    assert out.count() == 40 and out.select("msg").distinct().count() == 40
    assert out.where("device_id = 'unknown'").count() == 8
    assert out.where("size(props) = 0").count() == 0


def devices(spark):
    return spark.createDataFrame([("a", False, 3, 10, 1, AT, None, 60), ("b", True, 5, 0, 0, AT, AT, 60)], DEVICES)


def props(spark):
    return spark.createDataFrame([("a", "os", "linux"), ("a", "app", "x"), ("b", "os", "linux")], DEVICE_PROPS)


def test_devices(spark):
    d, p = devices(spark), props(spark)
    out = {r["id"]: [(x["key"], x["value"]) for x in r["props"]] for r in J.devices_with_props(d, p.where("device_id = 'a'")).collect()}
    assert out == {"a": [("app", "x"), ("os", "linux")], "b": []}
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(J.filter_devices(d, p, wanted={"os": ["linux", "mac"], "app": ["x"]})) == ["a"]
    assert ids(J.filter_devices(d, p, send_logs=True, levels=["error"])) == ["b"]
    assert ids(J.devices_matching_all(d, p, [("os", "linux")])) == ["a", "b"]
    assert ids(J.devices_matching_all(d, p, [("os", "linux"), ("app", "x"), ("app", "x")])) == ["a"]
    assert ids(J.devices_matching_all(d, p, [])) == ["a", "b"]


def test_device_updates(spark):
    d, p = devices(spark), props(spark)
    batch = spark.createDataFrame([("a", 4, 40, AT), ("new", 1, 7, AT)], "device_id string, logs_count long, logs_size long, last_upload_at timestamp")
    out = {r["id"]: r for r in J.upsert_device_stats(d, batch, AT).collect()}
    assert (out["a"]["logs_count"], out["a"]["logs_size"], out["b"]["logs_count"]) == (5, 50, 0)
    assert (out["new"]["send_logs"], out["new"]["filter_level"], out["new"]["send_interval"]) == (False, 3, 60)
    changes = spark.createDataFrame([("a", True, 1, 5), ("z", False, 2, 9)], "id string, send_logs boolean, filter_level int, send_interval int")
    out = {r["id"]: r for r in J.update_device_settings(d, changes, AT).collect()}
    assert (out["a"]["send_logs"], out["a"]["send_interval"], out["z"]["logs_count"], out["b"]["send_interval"]) == (True, 5, 0, 60)
    new = spark.createDataFrame([("a", "os", "mac"), ("a", "os", "mac")], DEVICE_PROPS)
    ids = spark.createDataFrame([("a",), ("b",)], "device_id string")
    assert [tuple(r) for r in J.replace_device_props(p, new, ids).collect()] == [("a", "os", "mac")]
    out = {r["id"]: r["send_interval"] for r in J.apply_settings_where(d, p, [("app", "x")], True, 1, 7).collect()}
    assert out == {"a": 7, "b": 60}
    seen = spark.createDataFrame([("b",), ("c",), ("c",)], "device_id string")
    out = {r["id"]: r["send_interval"] for r in J.register_devices(d, seen, AT).collect()}
    assert out == {"a": 60, "b": 60, "c": 500}


def test_facets_and_pivots(spark):
    out = {r["key"]: (r["values"], r["n_values"]) for r in A.prop_facets(props(spark)).collect()}
    assert out == {"os": (["linux"], 1), "app": (["x"], 1)}
    assert {tuple(r) for r in A.prop_facet_rows(props(spark).union(props(spark))).collect()} == {("os", "linux", 2), ("app", "x", 1)}
    df = table(spark, (AT, "info", [], "m"), (AT, "info", [], "n"))
    assert [tuple(r) for r in A.count_by(df, "level").collect()] == [("info", 2)]
    assert A.template_total(spark.createDataFrame([(1,), (1,), (2,)], "template_id int")).first()[0] == 2


def test_timezone_of_tests(spark):
    assert datetime(2024, 5, 15, tzinfo=timezone.utc) == AT
