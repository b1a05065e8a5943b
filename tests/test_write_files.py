"""What a task that writes files of bytes holds doesn't depend on how many they are."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter

from siltstone.sources import batches as B


def test_contents_pass_a_few_megabytes_at_a_time(spark, tmp_path):
    def probe(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([str(batch.nbytes).encode()] * len(batch), pa.binary())], ["path", "content"])

    files = spark.range(0, 40, 1, 1).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.repeat(F.lit("x"), 1 << 20).cast("binary").alias("content"))
    before = spark.conf.get(B.BATCH_BYTES, None)
    B.write_files(files.mapInArrow(probe, "path string, content binary"), str(tmp_path / "out"))
    sizes = [int(p.read_bytes()) for p in (tmp_path / "out").iterdir()]
    assert len(sizes) == 40 and max(sizes) < 2 * B.WRITE_BYTES
    assert spark.conf.get(B.BATCH_BYTES, None) == before


def test_the_sink_takes_arrow_batches():
    assert issubclass(B.FilesWriter, DataSourceArrowWriter)
