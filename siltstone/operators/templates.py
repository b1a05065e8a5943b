"""Mining of message templates.

Lines are clustered in order: a line joins the most similar template that has its number of tokens and its first
token, if their similarity is above a threshold; positions that differ become wildcards. State never crosses
(number of tokens, first token), so each such group is mined apart and exactly as if all lines went through one loop.

Within a group the order is part of the result, but few lines change a template. So the lines are cut, in order, into blocks, by as many tasks as they need,
and each block is reduced to its distinct lines and the numbers of these in order. A group's blocks are then replayed one after the other: where none of a
block's distinct lines changes a template, these are all that is looked at; else the block's numbers are walked. What a block's lines belong to goes back to
the block, and tasks of all blocks write out the lines. A hot group costs one task its distinct lines, not its lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from siltstone.sources.scratch import if_small, materialize

# Separators and wildcards of the command line and of the library, and the threshold.
CLI_SEPARATORS = (" ", ":", ",", ";")
CLI_WILDCARD = r"(^[0-9]+$)|(^\d{4}-\d{2}-\d{2}$)|(^\d{2}:\d{2}:\d{2},\d{3}$)|(^/\d{1,3}.\d{1,3}.\d{1,3}.\d{1,3}:\d+$)"
SEPARATORS = (" ",)
WILDCARD = r"^\d+$"
THRESHOLD = 0.3
STAR = "*"
#: Lines of a group whose template is remembered.
REMEMBERED = 50_000
#: Lines and characters of a block at most; one line may be longer.
BLOCK_LINES, BLOCK_CHARS = 20_000, 4 << 20


class Group:
    """Templates of one (number of tokens, first token). Lines that are equal join the same template as long as no template
    changes in between, so their answer is remembered until one does."""

    def __init__(self, threshold: float, separator: str):
        self.threshold, self.separator = threshold, separator
        self.templates: list[list[str]] = []
        self.texts: list[str] = []
        self.known: dict[str, int] = {}

    def find(self, line: str) -> tuple[int, list[str] | None]:
        """Index of the template that the line, its tokens with the separator between, joins or founds, and what the template becomes, if it changes."""
        if (at := self.known.get(line)) is not None:
            return at, None
        tokens = line.split(self.separator)
        best, at = 0, -1
        for i, template in enumerate(self.templates):
            equal = sum(map(str.__eq__, tokens, template))
            if equal > best:
                best, at = equal, i
        if at < 0 or best / len(tokens) <= self.threshold:
            return len(self.templates), tokens
        merged = [a if a == b else STAR for a, b in zip(self.templates[at], tokens, strict=True)]
        if merged != self.templates[at]:
            return at, merged
        self.remember(line, at)
        return at, None

    def remember(self, line: str, at: int) -> None:
        if len(self.known) < REMEMBERED:
            self.known[line] = at

    def learn(self, line: str) -> tuple[int, bool]:
        """Index of the line's template, which now is what the line made of it, and whether it changed."""
        at, becomes = self.find(line)
        if becomes is None:
            return at, False
        if at == len(self.templates):
            self.templates.append(becomes)
            self.texts.append("")
        self.templates[at], self.texts[at] = becomes, self.separator.join(becomes)
        self.known.clear()
        self.remember(line, at)  # the same line again is at least as like this template as before, and no more like any other
        return at, True

    def replay(self, lines: list[str], numbers: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray, list[str], list[tuple[int, int]]]:
        """A block of lines, as its distinct lines and their numbers in order: (whether the next two are of each line or of each distinct line only, template's
        index, place of its text just after the line, texts, (index, line) of the templates that it founds)."""
        found = [self.find(line) for line in lines]
        if all(becomes is None for _, becomes in found):
            owner = np.array([at for at, _ in found], np.int32)
            used, place = np.unique(owner, return_inverse=True)
            return False, owner, place.astype(np.int32), [self.texts[i] for i in used], []
        owner, place, texts, last, founded = np.empty(len(numbers), np.int32), np.empty(len(numbers), np.int32), [], {}, []
        for row, d in enumerate(numbers.tolist()):
            known = len(self.templates)
            at, changed = self.learn(lines[d])
            if at == known:
                founded.append((at, row))
            if changed or at not in last:
                last[at] = len(texts)
                texts.append(self.texts[at])
            owner[row], place[row] = at, last[at]
        return True, owner, place, texts, founded


def tokens_of(msg: Column, separators: tuple[str, ...], wildcard: str) -> Column:
    """Tokens between single separator characters; those that match the wildcard become *."""
    for s in separators:
        if len(s) != 1:
            raise ValueError("a separator is one character")
    one = "[" + "".join(re.escape(s) for s in separators) + "]"
    return F.transform(F.split(msg, one, -1), lambda t: F.when(t.rlike(f"(?U){wildcard}"), STAR).otherwise(t))


def _cut(columns: list[str]):
    """Cuts a task's sorted lines into blocks, one row each: its group, its place (part, seq), its distinct lines, their numbers, and the columns as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, key, size = TaskContext.get().partitionId(), 0, [], None, [0, 0]

        def block() -> pa.RecordBatch:
            nonlocal seq
            t = pa.Table.from_batches(held).combine_chunks()
            index: dict[str, int] = {}
            numbers = np.fromiter((index.setdefault(x, len(index)) for x in t.column("_t").to_pylist()), "<i4", t.num_rows)
            own = [t.column(c).combine_chunks() for c in columns]
            own = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own]
            row = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.string()), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([list(index)], pa.list_(pa.string())), pa.array([numbers.tobytes()], pa.binary())]
            seq += 1
            return pa.RecordBatch.from_arrays([*row, *[pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in own]], ["_n", "_first", "_part", "_seq", "_lines", "_numbers", *columns])

        for batch in batches:
            groups = list(zip(batch.column("_n").to_pylist(), batch.column("_first").to_pylist(), strict=True))
            lengths, at = batch.column("_length").to_numpy(), 0
            while at < len(groups):
                if held and (groups[at] != key or size[0] >= BLOCK_LINES or size[1] >= BLOCK_CHARS):
                    yield block()
                    held.clear()
                    size[:] = [0, 0]
                key, end, chars = groups[at], at, size[1]
                while end < len(groups) and groups[end] == key and size[0] + end - at < BLOCK_LINES and chars < BLOCK_CHARS:
                    chars += int(lengths[end])
                    end += 1
                held.append(batch.slice(at, end - at).select(["_t", *columns]))
                size[:] = [size[0] + end - at, chars]
                at = end
        if held:
            yield block()

    return run


def _replay(threshold: float, separator: str):
    """Replays the blocks of groups, which come in order, pass after pass."""
    found = pa.list_(pa.struct([("index", pa.int32()), ("row", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, Group(threshold, separator)
        for batch in batches:
            for n, first, p, part, seq, lines, numbers in zip(*[batch.column(c) for c in ("_n", "_first", "_pass", "_part", "_seq", "_lines", "_numbers")], strict=True):
                if (n.as_py(), first.as_py()) != key:
                    key, group = (n.as_py(), first.as_py()), Group(threshold, separator)
                each, owner, place, texts, founded = group.replay(lines.as_py(), np.frombuffer(numbers.as_py(), "<i4"))
                row = [pa.array([p.as_py()], pa.int32()), pa.array([part.as_py()], pa.int32()), pa.array([seq.as_py()], pa.int32()), pa.array([each]), pa.array([owner.tobytes()], pa.binary()), pa.array([place.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*row, pa.array([texts], pa.list_(pa.string())), pa.array([[{"index": i, "row": r} for i, r in founded]], found)], ["_pass", "_part", "_seq", "_each", "_owner", "_place", "_texts", "_founded"])

    return run


def _spread(columns: list[str]):
    """The lines of blocks, with the index and the text of their templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda c, i=i: batch.column(c)[i]
                numbers, owner, place = (np.frombuffer(value(c).as_py(), "<i4") for c in ("_numbers", "_owner", "_place"))
                if not value("_each").as_py():
                    owner, place = owner[numbers], place[numbers]
                n = len(numbers)
                names = [pa.repeat(pa.scalar(value("_n").as_py(), pa.int32()), n), pa.repeat(pa.scalar(value("_first").as_py(), pa.string()), n)]
                yield pa.RecordBatch.from_arrays([*[value(c).values for c in columns], *names, pa.array(owner), value("_texts").values.take(pa.array(place))], [*columns, "_n", "_first", "_index", "_text"])

    return run


def _mine(df: DataFrame, order: list[str], msg: str, separators: tuple[str, ...], wildcard: str, threshold: float, passes: int, carry: tuple[str, ...] = (), with_tokens: bool = False) -> DataFrame:
    columns = [*order, *carry]
    rows = df.select(*columns, tokens_of(F.coalesce(F.col(msg), F.lit("")), separators, wildcard).alias("_t"))
    rows = rows.withColumn("_n", F.size("_t")).withColumn("_first", F.get("_t", F.lit(0)))
    # no token holds a separator, so the line in one text is its tokens, and is cheaper to pass to Python and to remember
    rows = rows.withColumn("_t", F.array_join("_t", separators[0])).withColumn("_length", F.length("_t"))
    own = [df.schema[c] for c in columns]
    shape = StructType([*StructType.fromDDL("_n int, _first string, _part int, _seq int, _lines array<string>, _numbers binary"), *[StructField(f.name, ArrayType(f.dataType)) for f in own]])
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # numbers of tasks are given, as otherwise lines that take few bytes would all be one task's
    ranged = rows.repartitionByRange(tasks, "_n", "_first", *order).sortWithinPartitions("_n", "_first", *order)
    blocks = materialize(ranged.mapInArrow(_cut(columns), shape), "blocks")
    every = blocks.select("_n", "_first", "_part", "_seq", "_lines", "_numbers").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    every = every.repartition("_n", "_first").sortWithinPartitions("_n", "_first", "_pass", "_part", "_seq")
    replayed = materialize(every.mapInArrow(_replay(threshold, separators[0]), "_pass int, _part int, _seq int, _each boolean, _owner binary, _place binary, _texts array<string>, _founded array<struct<index:int,row:int>>"), "replayed")
    place = ["_part", "_seq"]
    founders = replayed.where(F.size("_founded") > 0).select("_pass", *place, F.explode("_founded").alias("_f")).join(blocks.select(*place, "_n", "_first", *order), place)
    founders = founders.select("_n", "_first", F.col("_f.index").alias("_index"), "_pass", *[F.get(F.col(c), F.col("_f.row")).alias(f"_by_{c}") for c in order])
    ids = materialize(_dense_ids(founders, ["_pass", *[f"_by_{c}" for c in order]], ["_n", "_first", "_index"]), "ids")
    last = replayed.where(F.col("_pass") == passes - 1).drop("_pass", "_founded")
    lines = blocks.drop("_lines").join(last, place).mapInArrow(_spread(columns), StructType([*own, *StructType.fromDDL("_n int, _first string, _index int, _text string")]))
    tokens = F.split("_text", f"[{re.escape(separators[0])}]", -1)
    text = F.col("_text") if separators[0] == " " else F.array_join(tokens, " ")
    return lines.join(if_small(ids), ["_n", "_first", "_index"]).select(*columns, "template_id", text.alias("text"), *([tokens.alias("tokens")] if with_tokens else []))


def _dense_ids(founders: DataFrame, keys: list[str], named: list[str]) -> DataFrame:
    """named, and template_id from 1 in the order of keys. Founders are range-partitioned and numbered inside their partition, then
    shifted by the counts of the partitions before, so no task sees all of them."""
    ranged = materialize(founders.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "founders")
    ranged = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    before = Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_c"), F.min(F.struct(*keys)).alias("_low"))
    shifts = parts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    return ranged.join(shifts, "_part").select(*named, (F.col("_shift") + F.col("_row")).cast("int").alias("template_id"))


def mine_templates(
    df: DataFrame, order: list[str], msg: str = "msg", separators: tuple[str, ...] = SEPARATORS, wildcard: str = WILDCARD, threshold: float = THRESHOLD, carry: tuple[str, ...] = (), with_tokens: bool = False,
) -> DataFrame:
    """(*order, *carry, template_id, text): each line's template, and the template's text just after the line. order: columns that
    order all lines; ids are 1, 2, ... in order of the founding lines; order must be unique. carry: further columns of the lines. with_tokens adds the text's
    tokens, which the text alone doesn't give where tokens hold blanks."""
    return _mine(df, order, msg, separators, wildcard, threshold, 1, carry, with_tokens)


def assign_templates(
    df: DataFrame, order: list[str], msg: str = "msg", separators: tuple[str, ...] = CLI_SEPARATORS, wildcard: str = CLI_WILDCARD, threshold: float = THRESHOLD, carry: tuple[str, ...] = (), with_tokens: bool = False,
) -> DataFrame:
    """As mine_templates after a first pass over all lines: every line is parsed a second time with the trained templates."""
    return _mine(df, order, msg, separators, wildcard, threshold, 2, carry, with_tokens)


def templates(parsed: DataFrame, order: list[str]) -> DataFrame:
    """(template_id, tokens) after the last line; parsed has tokens."""
    return parsed.groupBy("template_id").agg(F.max_by("tokens", F.struct(*order)).alias("tokens"))
