"""The ingest keeps what waits in few tasks, whatever the session's shuffle partitions."""

from siltstone.sources import batches as B
from siltstone.sources import logs as S
from siltstone.streaming import streams as T
from tests.test_small_files import table


def test_state_tasks(spark, tmp_path):
    df = table(spark, 30)
    B.write_files(B.encode_batches(df.coalesce(1), 4, ending=".ready"), str(tmp_path / "spool"))
    before = spark.conf.get(T.SHUFFLE_PARTITIONS)
    spark.conf.set(T.SHUFFLE_PARTITIONS, "60")
    try:
        query = T.ingest_with_flush(spark, str(tmp_path / "spool"), str(tmp_path / "logs"), str(tmp_path / "state"), seconds=0)
        query.awaitTermination()
        assert spark.conf.get(T.SHUFFLE_PARTITIONS) == "60"
    finally:
        spark.conf.set(T.SHUFFLE_PARTITIONS, before)
    found = [o["numShufflePartitions"] for p in query.recentProgress for o in p["stateOperators"]]
    assert found and max(found) <= T.STATE_TASKS
    got = S.read_logs(spark, str(tmp_path / "logs")).select("random", "msg").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, df.select("random", "msg").collect()))
