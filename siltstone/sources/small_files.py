"""Parquet files of few rows, written, counted and read by tasks themselves.

Spark's own writer and reader spend tens of milliseconds on each file (on a local or mounted folder without Hadoop's native library two processes a file, which set its
rights), whatever it holds. Where Python opens the store itself, tasks write a file in a few milliseconds, and read its footer or rows in less.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, WriterCommitMessage
from pyspark.sql.types import StructType

from siltstone.sources.batches import FilesWriter, opens

#: Files of fewer rows are small.
SMALL_ROWS = 10_000
#: Files that a task deals with, when it reads, moves or deletes them.
TASK_FILES = 500
#: Tasks a core that listed files are dealt to.
LIST_TASKS = 4
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def few_rows(path: str, rows: int) -> bool:
    """Whether files of so many rows at path are dealt with here."""
    return rows < SMALL_ROWS and opens(path)


@dataclass
class WrittenParts(WriterCommitMessage):
    """How many files a task wrote, by folder; their names follow from it."""

    stem: str
    counts: Counter = field(default_factory=Counter)

    @property
    def names(self) -> Iterator[tuple[str, str]]:
        for folder, n in self.counts.items():
            for i in range(n):
                yield f"{folder}/.{self.stem}.c{i:06d}.parquet", f"{folder}/{self.stem}.c{i:06d}.parquet"


class DayFilesWriter(FilesWriter):
    """Rows that come sorted by day go into day folders, in files of `rows` rows and one with a day's rest a task. Files show when all tasks have ended, as FilesWriter says."""

    def __init__(self, path: str, rows: int):
        super().__init__(path)
        self.rows = rows

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenParts:
        from uuid import uuid4

        import pyarrow.parquet as pq
        from pyspark import TaskContext

        system, root = self._system()
        out = WrittenParts(f"part-{TaskContext.get().partitionId():05d}-{uuid4().hex}")
        held: list[pa.RecordBatch] = []
        day = None

        def put() -> None:
            folder = f"day={_NO_DAY if day is None else day}"
            if held:
                if folder not in out.counts:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                name = f"{folder}/.{out.stem}.c{out.counts[folder]:06d}.parquet"
                out.counts[folder] += 1
                with system.open_output_stream(f"{root}/{name}") as stream:
                    pq.write_table(pa.Table.from_batches(held), stream, compression="zstd", store_schema=False)
                held.clear()

        try:
            for batch in batches:
                at, days = 0, batch.column("day")
                plain = batch.drop_columns(["day"])
                for run in pa.compute.run_end_encode(days).run_ends.to_pylist() if len(days) else []:
                    if days[at].as_py() != day:
                        put()
                        day = days[at].as_py()
                    while at < run:
                        part = plain.slice(at, min(run - at, self.rows - sum(map(len, held))))
                        held.append(part)
                        at += len(part)
                        if sum(map(len, held)) >= self.rows:
                            put()
            put()
        except BaseException:
            for part, _ in out.names:
                if system.get_file_info(f"{root}/{part}").is_file:
                    system.delete_file(f"{root}/{part}")
            raise
        return out


class DayFiles(DataSource):
    """Sink for rows with a day: Parquet files of few rows in folders by day."""

    @classmethod
    def name(cls) -> str:
        return "small_files_by_day"

    def writer(self, schema: StructType, overwrite: bool) -> DayFilesWriter:
        return DayFilesWriter(self.options["path"], int(self.options["rows"]))


def write_by_day(df: DataFrame, path: str, rows: int) -> None:
    """Adds rows, which are sorted by day in each task, as files of `rows` rows in folders by day. A task's last file of a day may have fewer."""
    df.sparkSession.dataSource.register(DayFiles)
    df.write.format("small_files_by_day").option("rows", rows).mode("append").save(path)


def _local(file: str) -> str:
    """A file's name, as _metadata.file_path holds it, for Python."""
    return re.sub(r"^file:/*", "/", unquote(file)) if file.startswith("file:") else re.sub(r"^s3a:", "s3:", unquote(file))


def _system(file: str):
    from pyarrow import fs

    name = _local(file)
    return (fs.LocalFileSystem(), name) if name.startswith("/") else fs.FileSystem.from_uri(name)


def _checksum(name: str) -> str:
    """Where Hadoop keeps the checksums of a local file."""
    folder, base = name.rsplit("/", 1)
    return f"{folder}/.{base}.crc"


def _named(path: str) -> str:
    """A path, as Hadoop qualifies it, in the way of _metadata.file_path."""
    scheme, rest = path.split(":", 1)
    rest = re.sub(r"[^\w/.!~*'():@&=+$,;-]", lambda m: quote(m[0]), rest)
    return f"file:/{rest.lstrip('/')}" if scheme == "file" else f"{scheme}:{rest}"


def _day_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders day=D of a table, qualified and in order; none if another key or something that is no day divides it, or Python can't open it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    system = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = {x.getPath().getName(): x.getPath().toString() for x in system.globStatus(folder(f"{path.rstrip('/')}/day=*")) or []}
    plain = all(re.fullmatch(rf"day=(\d{{4}}-\d\d-\d\d|{_NO_DAY})", x) for x in found) and [*found] != [f"day={_NO_DAY}"]
    return [found[x] for x in sorted(found)] if plain and all(map(opens, found.values())) else []


def table_schema(spark: SparkSession, path: str) -> StructType:
    """What spark.read.parquet says, which looks at the first file by name: only the first day is listed."""
    days = _day_folders(spark, path)
    return (spark.read.option("basePath", path).parquet(days[0]) if days else spark.read.parquet(path)).schema


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, day where folders name one) of the Parquet files at path; none is opened. Tasks list the folders of the days: Spark's scan would start a task for every 32 files."""
    days = _day_folders(spark, path)
    if not days:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        return found.select(F.col("_metadata.file_path").alias("file"), *(["day"] if "day" in found.columns else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for at in (i for batch in batches for i in batch.column("id").to_pylist()):
            folder, value = _named(days[at]), days[at].rsplit("=", 1)[1]
            system, name = _system(folder)
            found = [x.path[len(name) :] for x in system.get_file_info(fs.FileSelector(name, recursive=True)) if x.is_file and x.path.endswith(".parquet")]
            shown = [x for x in found if not any(part.startswith(".") or part.startswith("_") and "=" not in part for part in x.split("/"))]
            day = pa.scalar(None if value == _NO_DAY else date.fromisoformat(value), pa.date32())
            yield pa.RecordBatch.from_arrays([pa.array([folder + _named(f"x:{x}")[2:] for x in shown], pa.string()), pa.repeat(day, len(shown))], ["file", "day"])

    tasks = LIST_TASKS * spark.sparkContext.defaultParallelism
    return spark.range(0, len(days), 1, min(len(days), tasks)).mapInArrow(run, "file string, day date").repartition(tasks)


def file_counts(files: DataFrame) -> DataFrame:
    """files with rows, from the footers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for file in batch.column("file").to_pylist():
                system, name = _system(file)
                with system.open_input_file(name) as stream:
                    rows.append(pq.read_metadata(stream).num_rows)
            yield batch.append_column("rows", pa.array(rows, pa.int64()))

    return files.mapInArrow(run, StructType([*files.schema, *StructType().add("rows", "long")]))


def dealt(files: DataFrame, n: int) -> DataFrame:
    """n files, dealt to tasks of about TASK_FILES."""
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_FILES)))


def read_files(files: DataFrame, schema: StructType) -> DataFrame:
    """Rows of the Parquet files (file, day), with the columns of schema, day among them; columns that a file lacks are null. They pass on
    SMALL_ROWS at a time, as a batch costs more than a file's rows; a task holds no more, and one file's batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        held: list[pa.RecordBatch] = []

        def put() -> Iterator[pa.RecordBatch]:
            yield from pa.Table.from_batches(held, shape).combine_chunks().to_batches()
            held.clear()

        for batch in batches:
            for file, day in zip(batch.column("file").to_pylist(), batch.column("day"), strict=True):
                system, name = _system(file)
                with system.open_input_file(name) as stream:
                    source = pq.ParquetFile(stream, coerce_int96_timestamp_unit="us")
                    has = set(source.schema_arrow.names)
                    for part in source.iter_batches(SMALL_ROWS, use_threads=False):
                        columns = [pa.repeat(day, len(part)) if f.name == "day" else part.column(f.name).cast(f.type) if f.name in has else pa.nulls(len(part), f.type) for f in shape]
                        held.append(pa.RecordBatch.from_arrays(columns, schema=shape))
                        if sum(map(len, held)) >= SMALL_ROWS:
                            yield from put()
        yield from put()

    return files.select("file", "day").mapInArrow(run, schema)


def _each(files: DataFrame, do: Callable[[object, str], None]) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                do(*_system(file))
            yield batch.slice(0, 0)

    files.select("file").mapInArrow(run, "file string").collect()  # no row comes back


def move_to_days(files: DataFrame, path: str) -> None:
    """Moves files day=D/name from elsewhere in the same store to path/day=D/name; those that are moved already are left."""
    root = _local(path if ":" in path else f"file:{path}").rstrip("/")

    def do(system, name: str) -> None:
        from pyarrow import fs

        target = (root if root.startswith("/") else fs.FileSystem.from_uri(root)[1]) + "/" + "/".join(name.rsplit("/", 2)[1:])
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        for a, b in (((_checksum(name), _checksum(target)),) if isinstance(system, fs.LocalFileSystem) else ()) + ((name, target),):
            if system.get_file_info(a).is_file:
                system.move(a, b)

    _each(files, do)


def delete(files: DataFrame) -> None:
    """Deletes files, with their checksums; those that are gone already are left."""

    def do(system, name: str) -> None:
        from pyarrow import fs

        for x in (name, _checksum(name)) if isinstance(system, fs.LocalFileSystem) else (name,):
            if system.get_file_info(x).is_file:
                system.delete_file(x)

    _each(files, do)
