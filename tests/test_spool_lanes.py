"""Streams beside each other over one drop folder: every file is of one of them."""

from collections import Counter
from pathlib import Path

import pytest

from siltstone.plans import catalog
from siltstone.sources import batches as B
from siltstone.streaming import streams as T
from tests.test_small_files import table


@pytest.mark.parametrize("back", [0, 2])
def test_lanes_part_all_names(spark, tmp_path, back):
    names = ["a.ready", "7.ready", "ab.ready", "x7.ready", "77.ready", "abc.ready", "4ab.ready", "u-0001-1.ready", "u-0009_1.ready", "]2-^.ready", "ä5ö-.ready", "a.b.ready", "a b{,}.ready", "u1-00000-00015-1.ready"]
    for name in (*names, "u-0001-1.part", "u-0002-1.ready.part"):
        (tmp_path / name).write_bytes(b"x")
    found = Counter()
    for lane in T.spool_lanes(back):
        files = spark.read.format("binaryFile").option("pathGlobFilter", lane).load(str(tmp_path)).select("path").collect()
        found.update(Path(r["path"].replace("file:", "")).name for r in files)
    assert found == Counter(names)


def test_query_reads_its_files_in_lanes_of_five(spark, tmp_path, monkeypatch):
    """Digits take about the same number of files each, no batch has more than five, and each file comes once."""
    seen, real = [], T.stream_spool

    def spy(s, folder, max_files, names):
        seen.append((folder, max_files, names))
        return real(s, folder, max_files, names)

    monkeypatch.setattr(catalog.T, "stream_spool", spy)
    kept = []
    lanes = catalog._drain_lanes
    monkeypatch.setattr(catalog, "_drain_lanes", lambda *a: kept.append(lanes(*a)) or kept[-1])
    catalog.s4(spark, "/root/testdata/sf0.001").collect()
    assert [x[1:] for x in seen] == [(5, names) for names in T.spool_lanes(2)]
    files = sorted(p.name for p in Path(seen[0][0]).glob("*.ready"))
    assert files and sorted(r["file_name"] for r in kept[0].select("file_name").collect()) == files


def test_lanes_without_files(spark, tmp_path):
    df = table(spark, 12)
    B.write_files(B.encode_batches(df.coalesce(1), 4, ending="-1.ready"), str(tmp_path / "spool"))
    got = catalog._drain_lanes([B.count_contents(T.stream_spool(spark, str(tmp_path / "spool"), 1, names)) for names in T.spool_lanes(2)], "spool")
    assert sorted((r["file_name"], r["records"]) for r in got.collect()) == [(f"00000-{k:05d}-1.ready", 4) for k in range(3)]
