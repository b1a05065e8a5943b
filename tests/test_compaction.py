"""Compaction of files: what is rewritten, what isn't, and jobs that are broken off."""

from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.functions.fields import device_id
from siltstone.sources import compaction as C
from siltstone.sources import logs as S
from tests.test_fields import AT, logs


@pytest.fixture
def table(spark, tmp_path):
    """Two days: one of many small files and a large one, one of a single small file."""
    rows = [(AT + timedelta(minutes=i), "info", [("deviceId", "abc"[i % 3])], f"m{i}") for i in range(95)] + [(AT + timedelta(days=1), "info", [], "alone")]
    df = logs(spark, *rows).withColumn("device_id", device_id())
    path = str(tmp_path / "logs")
    S.write_logs(df.where("random < 40").coalesce(1), path, rows=40)
    S.write_logs(df.where("random >= 40"), path, rows=4, buckets_per_device=2)
    return path, df


def files(path):
    return {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("*.parquet")}


def same(spark, path, df):
    got = S.read_logs(spark, path).select("random", "msg", "device_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, df.select("random", "msg", "device_id").collect()))


def test_only_small_files_are_rewritten(spark, table):
    path, df = table
    before = files(path)
    large = {r["file"] for r in C.file_rows(spark, path).where("rows >= 20").collect()}
    assert len(large) == 1 and len(before) > 15
    assert C.compact_files(spark, path, 20) == len(before) - 2
    same(spark, path, df)
    after = files(path)
    stay = {p for p in before if any(x.endswith(str(p)) for x in large) or "day=2024-05-16" in str(p)}
    assert all(after[p] == before[p] for p in stay)
    counts = sorted(r["rows"] for r in C.file_rows(spark, path).collect())
    assert counts == [1, 15, 20, 20, 40]
    assert C.compact_files(spark, path, 20) == 0 and files(path) == after
    assert not (Path(path) / C.ASIDE).exists()
    one = next(p for p in after if p not in before)
    inside = [(r["device_id"], r["ts"]) for r in spark.read.parquet(str(one)).collect()]
    assert inside == sorted(inside)


@pytest.mark.parametrize("after", ["old", "new", "made"])
def test_broken_off(spark, table, monkeypatch, after):
    """After the list of old files, after the new files, or while they are written."""
    path, df = table
    real, calls = C.finish_compaction, []
    with monkeypatch.context() as m:
        if after == "old":
            m.setattr(C, "finish_compaction", lambda s, p: calls.append(1) or (real(s, p) if len(calls) == 1 else 1 / 0))
        elif after == "new":
            m.setattr(spark.__class__, "createDataFrame", lambda *a, **b: 1 / 0)
        else:
            m.setattr(C, "_flatten", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            C.compact_files(spark, path, 20)
    same(spark, path, df)  # readers see the old files
    if after == "old":  # one of the new files was moved already
        source = next((Path(path) / C.ASIDE / "new").rglob("*.parquet"))
        source.rename(Path(path) / source.parent.name / source.name)
        C.finish_compaction(spark, path)
        assert sorted(r["rows"] for r in C.file_rows(spark, path).collect()) == [1, 15, 20, 20, 40]
    else:
        assert C.compact_files(spark, path, 20) > 10
    same(spark, path, df)
    assert not (Path(path) / C.ASIDE).exists() and F is not None
