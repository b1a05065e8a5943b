"""Structured Streaming: live tail, histogram, device statistics, and ingest of a drop folder."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from siltstone.functions.fields import record_bytes
from siltstone.operators.devices import upsert_device_stats
from siltstone.sources.batches import count_contents, decode_contents, log_files, opens, with_content
from siltstone.sources.logs import canonical, write_logs
from siltstone.sources.small_files import TASK_FILES
from siltstone.sources.tables import merge_once

#: An uploader's files are written once they have so many rows or bytes, or the oldest has waited so long.
FLUSH_ROWS, FLUSH_BYTES, FLUSH_SECONDS = 3_000_000, 512 << 20, 300
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
WAITING = "path string, length long, records long, record_bytes long, skipped long"
FLUSH = f"uploader string, reason string, {WAITING}"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
#: Tasks that keep the uploaders' waiting files. They hold names and numbers only, and each starts a store and a worker in every batch, so few do.
STATE_TASKS = 16
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail(stream: DataFrame, where: Column) -> DataFrame:
    """Each arriving log that passes; stateless, no replay, nothing dropped."""
    return stream.where(where)


def stream_histogram(stream: DataFrame, seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """(bucket: epoch second, count) of arriving logs; logs later than `delay` behind the newest are dropped, so state ends."""
    counts = stream.withWatermark("ts", delay).groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("count"))
    return counts.select(F.unix_seconds("window.start").alias("bucket"), "count")


def stream_device_stats(stream: DataFrame) -> DataFrame:
    """Running logs_count, logs_size and last_upload_at per device (update or complete mode)."""
    return stream.groupBy("device_id").agg(F.count("*").alias("logs_count"), F.sum(record_bytes()).alias("logs_size"), F.max("ts").alias("last_upload_at"))


def store_device_stats(stream: DataFrame, devices: str, checkpoint: str, now: datetime | None = None) -> StreamingQuery:
    """Adds the logs of each batch to the table of devices at the folder `devices`, as upsert_device_stats does, over all that is there. A batch that is tried
    again, after a crash or by another query of the same checkpoint, is added once. now: created_at of devices that are new."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rolled = stream_device_stats(batch)
        merge_once(batch.sparkSession, devices, batch_id, lambda old: upsert_device_stats(old, rolled, now or datetime.now()))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spool_lanes(back: int) -> list[str]:
    """Patterns of names that part the finished files of a drop folder: each file is of one of them. Five go by the digit that has `back` characters between it and the
    ending, the last takes names without one. Batches of few files leave the cores idle while a stream keeps its logs; a stream for each pattern, with a checkpoint
    of its own, takes as many files a batch as one alone, and they run beside each other."""
    digits = [f"*[{i}{i + 1}]{'?' * back}.ready" for i in range(0, 10, 2)]
    return [*digits, "{" + ",".join([f"*[^0-9]{'?' * back}", *["?" * n for n in range(1, back + 1)]]) + "}.ready"]


def stream_spool(spark: SparkSession, folder: str, max_files: int = 1000, names: str = "*.ready") -> DataFrame:
    """Finished files (*.ready, or those of one of spool_lanes) of a drop folder, each once: path, length, content (null where tasks open the file themselves), file name, and uploader: the name up
    to its first '-', null for a name without one."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", names).option("maxFilesPerTrigger", max_files).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    uploader = F.when(F.contains(name, F.lit("-")), F.split(name, "-")[0])
    return with_content(files, folder).select("path", "length", "content", name.alias("file_name"), uploader.alias("uploader"))


def spool_logs(files: DataFrame) -> DataFrame:
    return canonical(decode_contents(files))


class FlushFiles(StatefulProcessor):
    """Keeps, for an uploader, the names and sizes of the files that wait, never their rows. They leave together, in the order in which they came, once
    their rows or bytes reach a limit, or when the time since the first of them has passed."""

    def __init__(self, rows: int, size: int, seconds: float):
        self.limits, self.wait = (rows, size), int(1000 * seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getListState("files", WAITING)
        self.total = handle.getValueState("total", "records long, length long, due long")

    def _leave(self, key: tuple, files: list[tuple], reason: str) -> Iterator[Row]:
        for f in files:
            yield Row(uploader=key[0], reason=reason, path=f[0], length=f[1], records=f[2], record_bytes=f[3], skipped=f[4])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        records, length, due = self.total.get() or (0, 0, 0)
        new: list[tuple] = []
        for row in sorted(rows, key=lambda r: r["path"]):
            new.append((row["path"], row["length"], row["records"], row["record_bytes"], row["skipped"]))
            records, length = records + row["records"], length + row["length"]
            full = "rows" if records >= self.limits[0] else "bytes" if length >= self.limits[1] else None
            if full:
                yield from self._leave(key, [*self.files.get(), *new], full)
                self._forget(due)
                new, records, length, due = [], 0, 0, 0
        if new:
            now = timerValues.getCurrentProcessingTimeInMs()
            if (due or now + self.wait) <= now:
                yield from self._leave(key, [*self.files.get(), *new], "time")
                self._forget(due)
                return
            if not due:
                due = now + self.wait
                self.handle.registerTimer(due)
            self.files.appendList(new)
            self.total.update((records, length, due))

    def _forget(self, due: int) -> None:
        if due:
            self.handle.deleteTimer(due)
        self.files.clear()
        self.total.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._leave(key, list(self.files.get()), "time")
        self._forget(0)

    def close(self) -> None:
        pass


def flushed_files(files: DataFrame, rows: int = FLUSH_ROWS, size: int = FLUSH_BYTES, seconds: float = FLUSH_SECONDS) -> DataFrame:
    """FLUSH: files of stream_spool as they leave, with their records and why they do (rows, bytes or time). Each file is read once for its number of records; of
    what waits only names and numbers are kept. Files of no uploader are one group. Needs a state store of RocksDB (STATE_STORE)."""
    counted = count_contents(files.drop("file_name"))
    return counted.groupBy("uploader").transformWithState(FlushFiles(rows, size, seconds), FLUSH, "Append", "ProcessingTime")


def ingest_with_flush(
    spark: SparkSession, folder: str, path: str, checkpoint: str, seconds: float = FLUSH_SECONDS, rows: int = FLUSH_ROWS, size: int = FLUSH_BYTES, every: str | None = None,
    max_files: int = 1000, stats: str | None = None, state_tasks: int = STATE_TASKS,
) -> StreamingQuery:
    """Ingests a drop folder into a logs table. An uploader's files are written when they have `rows` rows or `size` bytes, or after `seconds`.
    every: how often to look for files ('10 seconds'); None: what is there now, then stop. What isn't due by then waits for a later start that finds new files,
    and with seconds=0 nothing waits. The checkpoint makes a restart go on where it was; a batch that is tried again writes to its own folder again, so no log is stored twice or lost.
    stats: folder for the uploads of each batch: uploader, files, logs_count, logs_size (bytes of the records), skipped, reason. Files of no uploader are ingested
    and have no statistics. state_tasks: tasks that keep what waits, if the session has more shuffle partitions; a checkpoint keeps the number of its first start."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        # the list of files is stored and read by the caller's session, as streams run without adaptive plans
        left = f"{checkpoint}/left/batch={batch_id}"
        batch.write.mode("overwrite").parquet(left)
        files = spark.read.schema(FLUSH).parquet(left)
        n = files.count()
        if not n:
            return
        if opens(folder):  # tasks open the files by their names
            due = files.select("path", F.lit(None).cast("binary").alias("content")).repartition(max(spark.sparkContext.defaultParallelism, n // TASK_FILES))
        else:
            due = log_files(spark, [r["path"] for r in files.select("path").collect()])  # names, as the stream's own log holds them
        write_logs(spool_logs(due), f"{path}/batch={batch_id}", mode="overwrite")
        if stats:
            sums = files.where("uploader is not null").groupBy("uploader", "reason").agg(F.count("*").alias("files"), F.sum("records").alias("logs_count"), F.sum("record_bytes").alias("logs_size"), F.sum("skipped").alias("skipped"))
            sums.write.mode("overwrite").parquet(f"{stats}/batch={batch_id}")

    writer = flushed_files(stream_spool(spark, folder, max_files), rows, size, seconds).writeStream.outputMode("append").foreachBatch(flush).option("checkpointLocation", checkpoint)
    tasks = min(state_tasks, int(spark.conf.get(SHUFFLE_PARTITIONS)))
    settings = {STATE_STORE: ROCKSDB, SHUFFLE_PARTITIONS: str(tasks)} | ({EMPTY_BATCHES: "false"} if every is None else {})  # with timers there is always one more batch without data
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:  # the stream takes the settings when it starts
        return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
