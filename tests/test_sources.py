import struct
import time
from datetime import datetime, timezone

import pytest
import zstandard
from pyspark.sql import functions as F

from siltstone.functions.schema import DEVICES, PROPS
from siltstone.sources import batches as B
from siltstone.sources import logs as S
from siltstone.streaming import streams as T
from tests.test_fields import AT, logs
from tests.test_operators import dev, table

ROWS = [(AT, "info", [("deviceId", "a"), ("k", "é")], "one"), (AT, "unknown", [], ""), (AT, "fatal", [("k", "v"), ("k", "w")], "line\nbreak")]


def micros(ts):
    return int(ts.timestamp() * 1_000_000)


def encode(rows):
    return b"".join(B.encode_record(1, micros(t), i, lv, p, m) for i, (t, lv, p, m) in enumerate(rows))


def test_records():
    data = encode(ROWS)
    rows, skipped = B.decode_records(data)
    assert skipped == 0 and [(r[2], r[3], r[4], r[5]) for r in rows] == [(micros(t), lv, p, m) for t, lv, p, m in ROWS]
    rows, skipped = B.decode_records(data[:-1])
    assert len(rows) == 2
    bad = bytearray(data)
    bad[14] = 99  # the level of the first record
    rows, skipped = B.decode_records(bytes(bad))
    assert skipped > 0 and all(r[5] != "one" for r in rows)
    assert B.decode_records(b"") == ([], 0)
    assert B.decode_records(struct.pack("<HqIBB", 1, 2**62, 1, 1, 0))[0] == []


def test_decode_files(spark, tmp_path):
    (tmp_path / "a.ready").write_bytes(encode(ROWS))
    (tmp_path / "b.ready").write_bytes(b"")
    out = B.decode_batches(spark, str(tmp_path))
    assert sorted(r["msg"] for r in out.collect()) == ["", "line\nbreak", "one"]
    assert {(r["records"], r["skipped"]) for r in B.skipped_bytes(spark, str(tmp_path)).collect()} == {(3, 0)}  # empty files are left out


def test_encode_round_trip(spark):
    df = logs(spark, *ROWS)
    back = B.decode_contents(B.encode_batches(df, 2)).drop("path")
    assert back.exceptAll(df.select(back.columns)).count() == 0 and back.count() == 3


def test_import_segments(spark, tmp_path):
    packed = zstandard.ZstdCompressor().compress(b"elevenbytes" + b"\x00\x01" + encode(ROWS))
    (tmp_path / "1.log").write_bytes(packed)
    (tmp_path / "2.log").write_bytes(zstandard.ZstdCompressor().compress(b"elevenbytes" + b"\x00\x02" + encode(ROWS)))
    (tmp_path / "3.log").write_bytes(b"")
    rows, segments, props = B.import_segments(spark, str(tmp_path), b"elevenbytes")
    assert rows.count() == 3
    one = segments.collect()
    assert [(r["logs_count"], r["compressed_size"], r["original_size"]) for r in one] == [(3, len(packed), len(encode(ROWS)) + 13)]
    assert ("level", "fatal") in {(r["key"], r["value"]) for r in props.collect()}
    assert B.import_segments(spark, str(tmp_path), b"otherelevenb"[:11])[0].count() == 0
    files = B.pack_segments(B.encode_batches(logs(spark, *ROWS)), b"elevenbytes")
    assert B.decode_segments(files).count() == 3
    with pytest.raises(ValueError):
        B.pack_segments(files, b"short")


def test_text_and_json(spark, tmp_path):
    at = datetime(2026, 3, 31, 1, 29, 21, 657081, tzinfo=timezone.utc)
    df = logs(spark, (at, "error", [("id", "id-123")], "line one\nline two"), (at, "info", [], " "), (at, "info", [], None))
    assert [r[0] for r in S.to_text_lines(df, False).collect()] == ["2026-03-31 01:29:21 ERROR id=id-123 line one line two", "2026-03-31 01:29:21 INFO", "2026-03-31 01:29:21 INFO"]
    assert S.to_text_lines(df).first()[0].startswith("2026-03-31 01:29:21.657 ERROR")
    S.to_json_lines(df).write.text(str(tmp_path / "json"))
    back = S.read_json_logs(spark, str(tmp_path / "json"))
    assert {(r["random"], r["ts"], r["msg"]) for r in back.collect()} == {(r["random"], r["ts"], r["msg"]) for r in df.collect()}
    other = spark.createDataFrame([('{"id":"5","timestamp":"2024-01-01T00:00:00Z","level":"info","message":"hi"}',), ("nonsense",)], "value string")
    row = S.from_json_lines(other).collect()
    assert [(r["msg"], r["props"], r["device_id"], r["random"]) for r in row] == [("hi", [], "unknown", 5)]


def test_unreadable_lines(spark, tmp_path):
    lines = ['{"id":"5","timestamp":"2024-01-01T00:00:00Z","level":"info","message":"hi"}', "nonsense", '{"id":"6","timestamp":"soon"}', '{"id":"7"}', "[1]", "", "  ", '{"id":"8","timestamp":"2024-01-01T00:0']
    (tmp_path / "a.json").write_text("\n".join(lines))
    good, bad = S.read_json_logs_checked(spark, str(tmp_path))
    assert [r["msg"] for r in good.collect()] == ["hi"]
    assert sorted((r["reason"], r["value"]) for r in bad.collect()) == sorted([("no json", lines[1]), ("no time", lines[2]), ("no time", lines[3]), ("no time", lines[4]), ("no json", lines[7])])
    assert {r["file"].rsplit("/", 1)[1] for r in bad.collect()} == {"a.json"}


def test_write_read(spark, tmp_path):
    df = table(spark, *[(AT, "info", dev("a"), f"m{i}") for i in range(7)], (AT, "warn", [], "x"))
    S.write_logs(df, str(tmp_path / "logs"), rows=3)
    assert len(list((tmp_path / "logs").rglob("*.parquet"))) == 3
    assert S.read_logs(spark, str(tmp_path / "logs")).count() == 8
    S.write_logs(df, str(tmp_path / "more"), rows=3, buckets_per_device=4)
    assert S.read_logs(spark, str(tmp_path / "more")).count() == 8


def test_hot_device_is_split(spark, tmp_path):
    hot = spark.range(0, 40_000, 1, 8).select(
        F.lit(1).alias("version"), F.col("id").alias("random"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"), F.lit("info").alias("level"),
        F.array().cast(PROPS).alias("props"), F.sha2(F.col("id").cast("string"), 256).alias("msg"), F.lit("hot").alias("device_id"),
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "256k")
    try:
        S.write_logs(hot, str(tmp_path / "hot"))
    finally:
        spark.conf.unset(size)
    assert len(list((tmp_path / "hot").rglob("*.parquet"))) > 2
    back = S.read_logs(spark, str(tmp_path / "hot"))
    assert back.select("random").distinct().count() == back.count() == 40_000


def test_bad_clocks(spark):
    rows = [(datetime(y, 6, 1, tzinfo=timezone.utc), "info", [], str(y)) for y in (1970, 2022, 2023, 2034, 2035)]
    out = S.drop_bad_clocks(logs(spark, *rows), datetime(2024, 2, 1))
    assert [r["msg"] for r in out.collect()] == ["2023", "2034"]


def test_templates_csv(spark, tmp_path):
    parsed = spark.createDataFrame([(1, "user *"), (2, "a;b")], "template_id int, text string")
    S.write_templates_csv(parsed.coalesce(1), str(tmp_path / "csv"))
    lines = [x for p in (tmp_path / "csv").glob("*.csv") for x in p.read_text().splitlines()]
    assert lines == ["TemplateID;Text", "1;user *", '2;"a;b"']


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def drain(df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    df = table(spark, (AT, "info", dev("a"), "x"), (AT, "error", dev("a"), "y"), (AT, "error", [], "z"))
    path = str(tmp_path / "in")
    df.write.parquet(path)
    assert sorted(r["msg"] for r in drain(T.tail(stream(spark, path), F.col("level") == "error"), "tail", "append").collect()) == ["y", "z"]
    counts = drain(T.stream_histogram(stream(spark, path), 60), "histogram", "complete").collect()
    assert [(r["bucket"], r["count"]) for r in counts] == [(int(AT.timestamp()), 3)]
    stats = {r["device_id"]: r["logs_count"] for r in drain(T.stream_device_stats(stream(spark, path)), "stats", "complete").collect()}
    assert stats == {"a": 2, "unknown": 1}


def test_late_logs_are_dropped(spark, tmp_path):
    path = tmp_path / "in"
    df = table(spark, (AT, "info", [], "new"))
    df.write.parquet(str(path))
    late = table(spark, (datetime(2024, 1, 1, tzinfo=timezone.utc), "info", [], "late"))
    first = stream(spark, str(path))
    query = T.stream_histogram(first, 60, "1 minute").writeStream.format("memory").queryName("late").outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
    query.trigger(availableNow=True).start().awaitTermination()
    late.write.mode("append").parquet(str(path))
    again = T.stream_histogram(stream(spark, str(path)), 60, "1 minute").writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update")
    again.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema("bucket long, count long").parquet(str(tmp_path / "out")).count() == 0


@pytest.fixture
def spool(tmp_path):
    folder = tmp_path / "spool"
    folder.mkdir()
    return folder


def ingest(spark, spool, **limits):
    """One start over what is there; then the rows stored so far and the statistics."""
    root = spool.parent
    T.ingest_with_flush(spark, str(spool), str(root / "logs"), str(root / "state"), stats=str(root / "stats"), **limits).awaitTermination()
    stored = spark.read.schema(B.ROW + ", device_id string").option("recursiveFileLookup", True).parquet(str(root / "logs")) if (root / "logs").exists() else None
    shape = "uploader string, reason string, files long, logs_count long, logs_size long, skipped long"
    sums = spark.read.schema(shape).option("recursiveFileLookup", True).parquet(str(root / "stats")) if (root / "stats").exists() else None
    return (stored.count() if stored else 0), sorted((r["uploader"], r["reason"], r["files"], r["logs_count"], r["logs_size"]) for r in sums.collect()) if sums else []


def test_flush_by_rows(spark, spool):
    size = len(encode(ROWS))
    for name in ("a-1.ready", "a-2.ready", "b-1.ready", "none.ready", "c-1.part"):
        (spool / name).write_bytes(encode(ROWS))
    assert ingest(spark, spool, rows=6) == (6, [("a", "rows", 2, 6, 2 * size)])  # b and the file of no uploader wait
    (spool / "b-2.ready").write_bytes(encode(ROWS) + b"\xff" * 20)  # noise after the records
    (spool / "none2.ready").write_bytes(encode(ROWS))
    rows, sums = ingest(spark, spool, rows=6)
    assert rows == 18 and sums == [("a", "rows", 2, 6, 2 * size), ("b", "rows", 2, 6, 2 * size)]
    assert ingest(spark, spool, rows=6)[0] == 18


def test_flush_by_bytes(spark, spool):
    size = len(encode(ROWS))
    for i in range(5):
        (spool / f"a-{i}.ready").write_bytes(encode(ROWS))
    assert ingest(spark, spool, size=2 * size) == (12, [("a", "bytes", 4, 12, 4 * size)])


def test_flush_by_time_after_a_restart(spark, spool):
    (spool / "a-1.ready").write_bytes(encode(ROWS))
    assert ingest(spark, spool, seconds=2)[0] in (0, 3)
    time.sleep(3)
    (spool / "b-1.ready").write_bytes(encode(ROWS[:1]))  # the new start goes on with what waited
    rows, sums = ingest(spark, spool, seconds=2)
    assert rows >= 3 and sums[0][:4] == ("a", "time", 1, 3)
    time.sleep(3)
    (spool / "c-1.ready").write_bytes(encode(ROWS[:2]))
    rows, sums = ingest(spark, spool, seconds=0)
    assert rows >= 4 and [s[:4] for s in sums[:2]] == [("a", "time", 1, 3), ("b", "time", 1, 1)]


def test_spool_names(spark, spool):
    for name in ("a-1.ready", "b-x-2.ready", "none.ready", "c-1.part"):
        (spool / name).write_bytes(encode(ROWS))
    files = drain(T.stream_spool(spark, str(spool)).select("file_name", "uploader", "length"), "spool", "append")
    assert {(r["file_name"], r["uploader"]) for r in files.collect()} == {("a-1.ready", "a"), ("b-x-2.ready", "b"), ("none.ready", None)}


def test_device_stats_are_stored_once(spark, tmp_path):
    from siltstone.sources.tables import create_table, merge_once, read_table

    folder, source = str(tmp_path / "devices"), str(tmp_path / "in")
    now = datetime(2024, 6, 1)
    create_table(spark.createDataFrame([("a", True, 2, 10, 1, now, None, 30)], DEVICES), folder)
    df = table(spark, (AT, "info", dev("a"), "x"), (AT, "error", [], "z"))
    df.write.parquet(source)
    run = lambda: T.store_device_stats(stream(spark, source), folder, str(tmp_path / "state"), now).awaitTermination()
    run()
    df.where("msg = 'x'").write.mode("append").parquet(source)
    run()
    run()
    got = {r["id"]: (r["logs_count"], r["send_interval"]) for r in read_table(spark, folder).collect()}
    assert got == {"a": (3, 30), "unknown": (1, 60)}
    twice = lambda old: old.unionByName(old)
    assert not merge_once(spark, folder, 1, twice) and read_table(spark, folder).count() == 2  # batch 1 is in it
    assert merge_once(spark, folder, 2, twice) and read_table(spark, folder).count() == 4
    (tmp_path / "devices" / "data" / "9").mkdir()  # a version that isn't in the ledger isn't there
    assert read_table(spark, folder).count() == 4


def by_hand(data):
    """Records read one after the other, plainly."""
    rows, at, skipped = [], 0, 0
    while at + 16 <= len(data):
        version, ts, number, level, count = struct.unpack_from("<HqIBB", data, at)
        if level > 6 or not -62135596800_000000 <= ts <= 253402300799_999999:
            at, skipped = at + 1, skipped + 1
            continue
        pos, texts = at + 16, []
        for _ in range(2 * count):
            if pos >= len(data):
                return rows, skipped
            texts.append(data[pos + 1 : pos + 1 + data[pos]])
            pos += 1 + data[pos]
        if pos + 4 > len(data) or pos + 4 + struct.unpack_from("<I", data, pos)[0] > len(data):
            return rows, skipped
        at = pos + 4 + struct.unpack_from("<I", data, pos)[0]
        plain = [t.decode("utf-8", "replace") for t in [*texts, data[pos + 4 : at]]]
        rows.append((version, number, ts, ["unknown", "trace", "debug", "info", "warn", "error", "fatal"][level], list(zip(plain[:-1:2], plain[1:-1:2], strict=True)), plain[-1]))
    return rows, skipped


def test_steps_of_a_file(monkeypatch):
    """Records that steps cut, of all lengths and with noise, as if the file were read at once."""
    import random

    rnd = random.Random(3)
    data = b""
    for i in range(300):
        props = [("k" * rnd.randint(0, 30), "é" * rnd.randint(0, 20)) for _ in range(rnd.randint(0, 5))]
        data += (b"\x63" * rnd.randint(1, 40) if i % 17 == 5 else b"") + B.encode_record(1, micros(AT) + i, i, "info", props, "m" * rnd.randint(0, 400))
    whole = B.decode_records(data)
    assert whole == by_hand(data) and len(whole[0]) > 250
    assert all(B.decode_records(x) == by_hand(x) for x in (data[:-3], data[7:], bytes(rnd.randrange(256) for _ in range(5_000)), bytes(rnd.randrange(7) for _ in range(5_000))))
    monkeypatch.setattr(B, "STEP", 64)
    monkeypatch.setattr(B, "BATCH_ROWS", 7)
    assert B.decode_records(data) == whole
    counts = list(B.read_records(B._reader(data), False, len(data)))
    assert (sum(c[1] for c in counts), sum(c[3] for c in counts)) == (len(whole[0]), whole[1]) and all(c[0] is None for c in counts)
    assert sum(c[2] + c[3] for c in counts) <= len(data)
    packed = zstandard.ZstdCompressor().compress(b"elevenbytes\x00\x01" + data)
    assert B.strip_segment(packed, b"elevenbytes") == data
    assert data.startswith(B.strip_segment(packed[: len(packed) // 2], b"elevenbytes"))
    assert B.strip_segment(b"no zstd") == b""
    # a length far beyond the end isn't waited for, and invalid UTF-8 is replaced
    head = struct.pack("<HqIBB", 1, 0, 1, 1, 0)
    assert B.decode_records(head + struct.pack("<I", 2**31) + b"x" * 200)[0] == []
    assert B.decode_records(head + struct.pack("<I", 3) + b"a\xffb")[0][0][5] == "a\ufffdb"
    two = struct.pack("<HqIBB", 1, 0, 1, 1, 1) + b"\x01\xc3\x01\xa9" + struct.pack("<I", 0)  # a character cut between key and value
    assert B.decode_records(two)[0][0][4] == [("\ufffd", "\ufffd")]


def test_files_of_bytes(spark, tmp_path):
    rows = [(f"f{i // 3}.ready", bytes([i]) * 5) for i in range(12)] + [("empty.ready", b"")]
    B.write_files(spark.createDataFrame(rows, "path string, content binary").coalesce(1), str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {**{f"f{k}.ready": b"".join(bytes([i]) * 5 for i in range(3 * k, 3 * k + 3)) for k in range(4)}, "empty.ready": b""}
    bad = spark.createDataFrame([("a.ready", b"x"), ("sub/none.ready", b"x")], "path string, content binary").coalesce(1)
    with pytest.raises(Exception):
        B.write_files(bad, str(tmp_path / "bad"))
    assert list((tmp_path / "bad").iterdir()) == []
