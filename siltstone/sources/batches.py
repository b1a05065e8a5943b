"""Files of binary log records and zstd-compressed stored chunks.

A record, little-endian: u16 version, i64 microseconds, u32 random, u8 level, u8 number of properties, for each u8
length and key, u8 length and value; u32 length and message.

Files are opened where they are decoded and read step by step, so a task holds a few megabytes of a file, whatever its size. Where Python can't open a
file (a store that only Spark reads), Spark reads it as one value, of at most 2 GB.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from siltstone.functions.fields import device_id
from siltstone.functions.schema import LEVELS, SEGMENT_HEADER
from siltstone.operators.segments import segment_props, segment_summary
from siltstone.sources.scratch import materialize

_HEAD = struct.Struct("<HqIBB")
_HEADS = np.dtype([("version", "<u2"), ("micros", "<i8"), ("random", "<u4"), ("level", "u1"), ("props", "u1")])
_LENGTH = struct.Struct("<I")
#: Micros that a timestamp can hold.
_LOW, _HIGH = -62135596800_000000, 253402300799_999999
#: Rows that a decoding task passes on at a time, and bytes that it reads at a time.
BATCH_ROWS, STEP = 20_000, 8 << 20
ROW = "version int, random long, ts timestamp, level string, props array<struct<key:string,value:string>>, msg string"
#: Bytes that pass between the steps of a task that writes files, and the setting that bounds them.
WRITE_BYTES, BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Schemes of paths that Python opens itself.
OPENED = ("", "file", "s3", "s3a", "gs", "hdfs")
_NAMES = np.array(["unknown", *LEVELS[:6]], object)


def encode_record(version: int, micros: int, random: int, level: str, props: list[tuple[str, str]], msg: str) -> bytes:
    """A record; keys and values of up to 255 bytes, up to 255 of them."""
    code = LEVELS.index(level) + 1 if level in LEVELS[:6] else 0
    parts = [_HEAD.pack(version, micros, random, code, len(props))]
    for text in (x for p in props for x in p):
        data = text.encode()
        parts += [bytes([len(data)]), data]
    data = msg.encode()
    return b"".join([*parts, _LENGTH.pack(len(data)), data])


@dataclass
class Records:
    """Pieces of records as they lie in a file: heads, keys and values by turns, messages."""

    heads: list[bytes] = field(default_factory=list)
    texts: list[bytes] = field(default_factory=list)
    messages: list[bytes] = field(default_factory=list)

    def table(self, path: str) -> pa.RecordBatch:
        """Rows of ROW, and the path."""
        heads = np.frombuffer(b"".join(self.heads), _HEADS)
        ends = np.concatenate([[0], np.cumsum(heads["props"], dtype=np.int32)]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([_strings(self.texts[::2]), _strings(self.texts[1::2])], ["key", "value"])
        columns = [
            pa.array(heads["version"].astype(np.int32)), pa.array(heads["random"].astype(np.int64)), pa.array(heads["micros"].astype(np.int64)).cast(pa.timestamp("us", "UTC")), pa.array(_NAMES[heads["level"]], pa.string()),
            pa.ListArray.from_arrays(pa.array(ends), pairs), _strings(self.messages), pa.repeat(pa.scalar(path, pa.string()), len(heads)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["version", "random", "ts", "level", "props", "msg", "path"])


def _strings(pieces: list[bytes]) -> pa.Array:
    """Texts of the pieces, in one buffer; bytes that are no UTF-8 become replacement characters."""
    ends = np.zeros(len(pieces) + 1, np.int32)
    ends[1:] = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    out = pa.StringArray.from_buffers(len(pieces), pa.py_buffer(ends), pa.py_buffer(b"".join(pieces)))
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in pieces], pa.string())
    return out


def take_records(data: bytes, at: int, out: Records | None) -> tuple[int, int, int, int]:
    """Reads records from `at` on until the data ends or out is full: (records, bytes skipped, where the next begins, bytes that it needs to be whole).
    After a bad time or level reading resumes one byte on. Without out the records are only counted."""
    count, skipped, n = 0, 0, len(data)
    head, length = _HEAD.unpack_from, _LENGTH.unpack_from
    texts = [] if out is None else out.texts
    while at + 16 <= n and count < BATCH_ROWS:
        _, micros, _, level, props = head(data, at)
        if level > 6 or not _LOW <= micros <= _HIGH:
            at, skipped = at + 1, skipped + 1
            continue
        pos, known = at + 16, len(texts)
        try:
            if out is None:
                for _ in range(2 * props):
                    pos += 1 + data[pos]
            else:
                for _ in range(2 * props):
                    end = pos + 1 + data[pos]
                    texts.append(data[pos + 1 : end])
                    pos = end
            end = pos + 4 + length(data, pos)[0]
        except (IndexError, struct.error):
            end = max(pos, n) + 1
        if end > n:
            del texts[known:]
            return count, skipped, at, end - at
        if out is not None:
            out.heads.append(data[at : at + 16])
            out.messages.append(data[pos + 4 : end])
        at, count = end, count + 1
    return count, skipped, at, 16


def read_records(read: Callable[[int], bytes], rows: bool = True, size: int | None = None) -> Iterator[tuple[Records | None, int, int, int]]:
    """(records, how many, their bytes, bytes skipped), step by step until the bytes that read(n) gives end. A record that is cut off by the end is left out. size: of all
    bytes, if it is known: a record that would end beyond it isn't waited for."""
    data, at, left = b"", 0, size
    while True:
        out = Records() if rows else None
        count, skipped, end, need = take_records(data, at, out)
        if count or skipped:
            yield out, count, end - at - skipped, skipped
        at = end
        if at + need <= len(data):
            continue
        data, at = data[at:], 0
        if left is not None and need - len(data) > left:  # it ends within this record
            return
        more = read(max(STEP, need - len(data)))
        if not more:
            return
        data = data + more
        if left is not None:
            left -= len(more)


def _reader(data: bytes) -> Callable[[int], bytes]:
    at = 0

    def read(n: int) -> bytes:
        nonlocal at
        part = data[at : at + n]
        at += len(part)
        return part

    return read


def decode_records(data: bytes) -> tuple[list[tuple], int]:
    """All rows of the data, with times in microseconds, and the bytes skipped."""
    rows, skipped = [], 0
    for found, _, _, bad in read_records(_reader(data), True, len(data)):
        skipped += bad
        t = found.table("") if found.heads else None
        if t is not None:
            values = [t.column(c).to_pylist() for c in ("version", "random", "level", "props", "msg")]
            micros = t.column("ts").cast(pa.int64()).to_pylist()
            rows += [(v, r, m, lv, [(p["key"], p["value"]) for p in ps], s) for m, (v, r, lv, ps, s) in zip(micros, zip(*values, strict=True), strict=True)]
    return rows, skipped


def _opened(path: str) -> tuple[pa.NativeFile, int]:
    """A file as a stream, and its size."""
    from pyarrow import fs

    path = re.sub(r"^s3a:", "s3:", re.sub(r"^file:/*", "/", path))
    system, name = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    return system.open_input_stream(name, buffer_size=1 << 20), system.get_file_info(name).size


def _source(path: str, content: bytes | None) -> tuple[Callable[[int], bytes], int]:
    if content is not None:
        return _reader(content), len(content)
    stream, size = _opened(path)
    return stream.read, size


def opens(path: str) -> bool:
    """Whether Python opens files of such a path itself."""
    return (path.split(":", 1)[0] if ":" in path else "") in OPENED


def log_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, modificationTime, content) of the files at path, or of the named ones; content is null where Python opens them itself, and then isn't
    read. Spark deals the files to tasks by their sizes."""
    if isinstance(path, str):
        return with_content(spark.read.format("binaryFile").load(path), path)
    return with_content(spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in path]), path[0])


def with_content(files: DataFrame, path: str) -> DataFrame:
    """files of the format binaryFile, with content only where Python can't open path."""
    content = F.lit(None).cast("binary") if opens(path) else F.col("content")
    return files.select("path", "length", "modificationTime", content.alias("content"))


def decode_contents(files: DataFrame, content: str = "content", name: str = "path") -> DataFrame:
    """Rows of ROW, with the name column of their file, from a binary column; where it is null, from the file of that name. One file is one row of files.
    A task holds a few megabytes of a file that it opens itself, and BATCH_ROWS of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column("_name").to_pylist(), batch.column("_data"), strict=True):
                read, size = _source(where, data.as_py())
                for found, count, _, _ in read_records(read, True, size):
                    if count:
                        yield found.table(where)

    return files.select(F.col(name).alias("_name"), F.col(content).alias("_data")).mapInArrow(run, f"{ROW}, path string")


def _counts(path: str, content: bytes | None) -> list[int]:
    read, size = _source(path, content)
    return [sum(x) for x in zip((0, 0, 0), *[found[1:] for found in read_records(read, False, size)], strict=True)]


def count_contents(files: DataFrame) -> DataFrame:
    """The columns of files (path, content and others) but content, with records, record_bytes and skipped: what reading each file finds and leaves out."""
    others = [c for c in files.columns if c != "content"]
    shape = StructType([files.schema[c] for c in others]).add("records", "long").add("record_bytes", "long").add("skipped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_counts(p, c.as_py()) for p, c in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *[pa.array([f[i] for f in found], pa.int64()) for i in range(3)]], [*others, "records", "record_bytes", "skipped"])

    return files.mapInArrow(run, shape)


def decode_batches(spark: SparkSession, path: str) -> DataFrame:
    """Logs from files of binary records, with the path of their file."""
    return decode_contents(log_files(spark, path))


def skipped_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, records, skipped) per file: what reading it found and left out."""
    return count_contents(log_files(spark, path)).select("path", "records", "skipped")


def encode_batches(logs: DataFrame, rows: int = 10_000, uploader: Column | None = None, ending: str = ".ready") -> DataFrame:
    """(path, content): each task packs its logs, in the order it has them, into batches of up to `rows` records. uploader: of a log; it comes before the first
    - of the names, and a batch is of one uploader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            owners = np.array(whole.column("uploader").to_pylist(), object)
            cuts = [0, *(np.flatnonzero(owners[1:] != owners[:-1]) + 1).tolist(), len(owners)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                for at in range(first, last, rows):
                    part = whole.slice(at, min(rows, last - at))
                    columns = [part.column(c).to_pylist() for c in ("version", "micros", "random", "level", "keys", "values", "msg")]
                    data = b"".join(encode_record(v, m, r, lv, list(zip(ks, vs, strict=True)), s) for v, m, r, lv, ks, vs, s in zip(*columns, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([f"{owners[at]}{task:05d}-{k:05d}{ending}"]), pa.array([data], pa.binary())], ["path", "content"])
                    k += 1

    text = lambda part: F.transform("props", lambda p: p[part])
    owner = F.lit("") if uploader is None else F.concat(uploader, F.lit("-"))
    return logs.select("version", F.unix_micros("ts").alias("micros"), "random", "level", text("key").alias("keys"), text("value").alias("values"), "msg", owner.alias("uploader")).mapInArrow(run, "path string, content binary")


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    """Each task writes under names that begin with a dot; they get their own when all tasks have ended, so a reader of finished files never sees half of
    one, and what a failed attempt wrote is taken away."""

    def __init__(self, path: str):
        self.path = path

    def _system(self):
        from pyarrow import fs

        path = re.sub(r"^s3a:", "s3:", re.sub(r"^file:/*", "/", self.path))
        return (fs.LocalFileSystem(), path.rstrip("/")) if path.startswith("/") else fs.FileSystem.from_uri(path.rstrip("/"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, folder = self._system()
        system.create_dir(folder, recursive=True)
        names, out = [], None
        try:
            for path, content in ((p, c) for batch in batches for p, c in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True)):
                if not names or path != names[-1][1]:
                    if out is not None:
                        out.close()
                    names.append((f".{path}.{TaskContext.get().taskAttemptId()}", path))
                    out = system.open_output_stream(f"{folder}/{names[-1][0]}")
                out.write(content.as_buffer())  # as it lies in the batch
            if out is not None:
                out.close()
        except BaseException:
            for part, _ in names:
                system.delete_file(f"{folder}/{part}")
            raise
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = self._system()
        for part, name in (x for m in messages if m is not None for x in m.names):
            system.move(f"{folder}/{part}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = self._system()
        for part, _ in (x for m in messages if m is not None for x in m.names):
            system.delete_file(f"{folder}/{part}")


class Files(DataSource):
    """Sink for (path string, content binary): every row is a file of that name in the folder; rows of a name that follow each other in a task are one file."""

    @classmethod
    def name(cls) -> str:
        return "files_of_bytes"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Writes (path, content) as files of a folder. Contents pass between the steps of a task WRITE_BYTES at a time, or one by one where they are larger, so
    that its memory doesn't depend on how many files it writes."""
    spark = files.sparkSession
    spark.dataSource.register(Files)
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(WRITE_BYTES))
    try:
        files.select("path", "content").write.format("files_of_bytes").mode("append").save(path)
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def pack_segments(files: DataFrame, magic: bytes, level: int = 9) -> DataFrame:
    """(path, content): binary batches as stored chunks; magic is 11 bytes."""
    if len(magic) != SEGMENT_HEADER - 2:
        raise ValueError("magic must be 11 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for i, content in enumerate(batch.column("content")):
                packed = zstandard.ZstdCompressor(level).compress(magic + b"\x00\x01" + content.as_py())
                yield pa.RecordBatch.from_arrays([batch.column("path").slice(i, 1), pa.array([packed], pa.binary())], ["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")


class Expanded:
    """Plain bytes of a zstd stream, read step by step; they end where it is damaged."""

    def __init__(self, read: Callable[[int], bytes]):
        import zstandard

        self.source, self.data, self.ended = read, b"", False
        self.stream = zstandard.ZstdDecompressor().decompressobj()
        self.error = zstandard.ZstdError

    def read(self, n: int) -> bytes:
        while len(self.data) < n and not self.ended:
            packed = self.source(STEP // 64)
            try:
                self.data += self.stream.decompress(packed) if packed else b""
            except self.error:
                packed = b""
            self.ended = not packed or self.stream.eof
        out, self.data = self.data[:n], self.data[n:]
        return out


def _past_header(read: Callable[[int], bytes], magic: bytes | None) -> Callable[[int], bytes] | None:
    """What reads the records of a stored chunk: zstd-compressed, 11 bytes of magic and a big-endian version 1 before them. None if it isn't one."""
    plain = Expanded(read)
    header = plain.read(SEGMENT_HEADER)
    known = magic is None or header[: SEGMENT_HEADER - 2] == magic
    return plain.read if known and header[SEGMENT_HEADER - 2 :] == b"\x00\x01" else None


def strip_segment(data: bytes, magic: bytes | None = None) -> bytes:
    """Plain records of a stored chunk. A chunk that isn't one gives no bytes. magic: what the first 11 bytes must be; None takes any."""
    read = _past_header(_reader(data), magic)
    return b"".join(iter(lambda: read(STEP), b"")) if read else b""


def decode_segments(files: DataFrame, magic: bytes | None = None) -> DataFrame:
    """Rows of ROW, with their file's path, from stored chunks (path, content; where content is null, the file of that path). Chunks are expanded step by step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if read := _past_header(_source(where, data.as_py())[0], magic):
                    for found, count, _, _ in read_records(read):
                        if count:
                            yield found.table(where)

    return files.select("path", "content").mapInArrow(run, f"{ROW}, path string")


def import_segments(spark: SparkSession, path: str, magic: bytes | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(logs, segments, segment props) of a folder of stored chunks: one segments row per non-empty file."""
    return import_segment_files(log_files(spark, path), magic)


def import_segment_files(files: DataFrame, magic: bytes | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of files (path, content, length). The decoded logs are stored, so each file is decoded once."""
    logs = materialize(decode_segments(files, magic).withColumn("device_id", device_id("props")), "imported")
    sizes = files.select("path", F.col("length").alias("compressed_size"))
    segments = segment_summary(logs, ["path"]).join(sizes, "path")
    return logs, segments, segment_props(logs, ["path"])
