"""Row-level expressions over the columns of logs. All stay inside the JVM except message fragments."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.schema import DEVICE_KEY, LEVELS, UNKNOWN_DEVICE

TIME_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
_U64 = str(2**64 - 1)
VERSION_PARTS = ("major", "minor", "patch")
#: Major may have a plus sign; minor and patch end at their first - or +; parts after the third don't matter.
_VERSION = r"(\+?[0-9]+)(?:\.([0-9]+)(?:[-+][^.]*)?(?:\.([0-9]+)(?:[-+][^.]*)?(?:\..*)?)?)?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_id(ts: Column | str = "ts", random: Column | str = "random") -> Column:
    """Milliseconds times 2**32 plus the random part, as decimal(38,0)."""
    return (F.unix_millis(_col(ts)).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + _col(random)).cast("decimal(38,0)")


def log_id_hex(ts: Column | str = "ts", random: Column | str = "random") -> Column:
    """The id as 32 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.concat(F.hex(F.unix_millis(_col(ts))), F.lpad(F.hex(_col(random)), 8, "0")), 32, "0"))


def level_rank(level: Column | str = "level") -> Column:
    """1 (trace) to 6 (fatal); anything else 7."""
    level = _col(level)
    return reduce(lambda c, x: c.when(level == x[1], F.lit(x[0])), enumerate(LEVELS[1:6], 2), F.when(level == LEVELS[0], F.lit(1))).otherwise(F.lit(7))


def level_parse(text: Column | str) -> Column:
    """The level that a text names: all lower or all upper case; anything else, null too, is unknown."""
    text = _col(text)
    names = [*LEVELS[:6], *[x.upper() for x in LEVELS[:6]]]
    return F.coalesce(F.when(text.isin(names), F.lower(text)), F.lit("unknown"))


def level_from_number(number: Column | str) -> Column:
    """1 to 6, else unknown."""
    return F.coalesce(F.get(F.array(*map(F.lit, LEVELS[:6])), _col(number).cast("int") - 1), F.lit("unknown"))


def rank_of(operand: str | int) -> int:
    """Rank of a level given as text or number; unrecognised ones rank as unknown."""
    if isinstance(operand, int):
        return operand if 1 <= operand <= 6 else 7
    name = operand.lower() if operand in (operand.lower(), operand.upper()) else ""
    return LEVELS.index(name) + 1 if name in LEVELS[:6] else 7


def prop(key: str, props: Column | str = "props") -> Column:
    """Value of the first property with that key, else null."""
    return F.get(F.filter(_col(props), lambda p: p["key"] == key), F.lit(0))["value"]


def prop_values(key: str, props: Column | str = "props") -> Column:
    """All values of a key, in order."""
    return F.transform(F.filter(_col(props), lambda p: p["key"] == key), lambda p: p["value"])


def device_id(props: Column | str = "props") -> Column:
    return F.coalesce(prop(DEVICE_KEY, props), F.lit(UNKNOWN_DEVICE))


def with_device_prop(props: Column | str = "props") -> Column:
    """props, with an unknown device appended where none is named."""
    props = _col(props)
    unknown = F.struct(F.lit(DEVICE_KEY).alias("key"), F.lit(UNKNOWN_DEVICE).alias("value"))
    return F.when(F.exists(props, lambda p: p["key"] == DEVICE_KEY), props).otherwise(F.array_append(props, unknown))


def ts_part(part: str, minutes_west: int = 0, ts: Column | str = "ts") -> Column:
    """A part of the time at a fixed offset, given in minutes west of UTC. Session zone: UTC."""
    if part not in TIME_PARTS:
        raise ValueError(f"no such part of a time: {part}")
    return TIME_PARTS[part](_col(ts) - F.make_dt_interval(mins=F.lit(minutes_west)))


def version_of(text: str) -> tuple[int, int, int] | None:
    """semver of a text that is known when a query is built."""
    parts = re.fullmatch(_VERSION, text, re.S)
    if not parts:
        return None
    numbers = [int(x.lstrip("+")) if x else 0 for x in parts.groups()]
    return tuple(numbers) if max(numbers) < 2**64 else None


def semver(text: Column | str) -> Column:
    """struct(major, minor, patch), or null if the text is no version."""
    text = _col(text)
    part = lambda i: F.regexp_extract(text, rf"(?s)\A(?:{_VERSION})\z", i)
    # minor and patch may be missing; a text that isn't a version has no major, and one that is too long is no decimal
    texts = [part(1), *[F.concat(F.lit("0"), part(i)) for i in (2, 3)]]
    numbers = F.struct(*[c.try_cast("decimal(20,0)").alias(a) for c, a in zip(texts, VERSION_PARTS, strict=True)])
    most = F.lit(_U64).cast("decimal(20,0)")
    sound = lambda v: reduce(lambda a, b: a & b, [F.coalesce(v[a] <= most, F.lit(False)) for a in VERSION_PARTS])
    return once(numbers, lambda v: F.when(sound(v), v))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row however often it is used; filters share no subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bucket_start(seconds: int, ts: Column | str = "ts") -> Column:
    """Epoch second of the bucket; the remainder is truncated, so before 1970 buckets start late."""
    at = F.unix_seconds(_col(ts))
    return at - at % F.lit(seconds)


def record_bytes(props: Column | str = "props", msg: Column | str = "msg") -> Column:
    """Bytes of a stored entry: 20, 2 for each property with its key and value, and the message."""
    each = lambda n, p: n + 2 + F.octet_length(p["key"]) + F.octet_length(p["value"])
    return (F.lit(20) + F.aggregate(_col(props), F.lit(0), each) + F.octet_length(_col(msg))).cast("long")


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _kind(piece: str) -> str:
    """What a closed piece of a message is, by its first visible character and whether it parses."""
    text = piece.strip()
    try:
        if text[:1] == "{":
            json.loads(text, parse_constant=_no_constant)
            return "json"
        if text[:1] == "<":
            ElementTree.fromstring(text)
            return "xml"
    except (ValueError, ElementTree.ParseError):
        pass
    return "text"


class _Closed(Exception):
    """The outermost element has ended."""


#: A tag, with quoted values.
_TAG = re.compile(rb"<(?:[^\x22'>]|\x22[^\x22]*\x22|'[^']*')*>")


def _xml_end(msg: str, start: int, limit: int) -> int | None:
    """Where the XML document that begins at start ends, if one does before limit. It is read once, step by step, up to the end of its outermost element."""
    while start < limit and msg[start].isspace():
        start += 1
    if msg[start : start + 1] != "<" or start >= limit:
        return None
    parser, depth, fed, data, begun, at = expat.ParserCreate(namespace_separator="}"), 0, start, b"", 0, 0

    def opened(*_: object) -> None:
        nonlocal depth, begun
        depth, begun = depth + 1, parser.CurrentByteIndex

    def closed(*_: object) -> None:
        nonlocal depth, at
        depth, at = depth - 1, parser.CurrentByteIndex  # of the end tag, or behind a tag that is both
        if not depth:
            raise _Closed

    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    try:
        size = 64
        while fed < limit:
            part = msg[fed : min(limit, fed + size)].encode()
            data, fed, size = data + part, fed + size, 2 * size
            parser.Parse(part, False)
        parser.Parse(b"", True)
    except _Closed:
        tag = _TAG.match(data, begun)
        last = at if tag and tag.end() == at and tag[0].endswith(b"/>") else data.find(b">", at) + 1
        end = start + len(data[:last].decode())
        return end if _kind(msg[start:end]) == "xml" else None
    except expat.ExpatError:
        return None
    return None


def split_message(msg: str) -> list[tuple[str, str]]:
    """(kind, text) of a message's fragments in order; together they are the message.

    A brace that opens the outermost block ends the text before it, and one that closes it ends a fragment: json if it parses, text
    otherwise. Outside blocks, a fragment whose first visible character is '<' ends at the first '>' up to which it is well-formed XML.
    What is left at the end is a fragment too. Braces that close nothing count, so they shift what is outermost after them. Every character is read a few times
    at most, however many marks there are."""
    out: list[tuple[str, str]] = []
    marks = [m.start() for m in re.finditer("[{}]", msg)]
    start, depth = 0, 0

    def cut(end: int, kind: str | None = None) -> None:
        nonlocal start
        out.append((kind or _kind(msg[start:end]), msg[start:end]))
        start = end

    for i in [*marks, len(msg)]:
        while depth == 0 and (end := _xml_end(msg, start, i)) is not None:
            cut(end, "xml")
        if i == len(msg):
            break
        if msg[i] == "{":
            depth += 1
            if depth == 1 and i > start:
                cut(i, "text")
        else:
            depth -= 1
            if depth == 0:
                cut(i + 1)
    if start < len(msg):
        cut(len(msg))
    return out


def msg_fragments(df: DataFrame, key: str, msg: str = "msg") -> DataFrame:
    """(key, pos, kind, fragment, parsed variant): one row per fragment of each message; parsed is null but for JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *f) for k, m in zip(batch[key], batch["_m"], strict=True) for i, f in enumerate(split_message(m or ""))]
            yield pd.DataFrame(rows, columns=[key, "pos", "kind", "fragment"])

    kind = df.schema[key].dataType.simpleString()
    parts = df.select(key, F.col(msg).alias("_m")).mapInPandas(run, f"{key} {kind}, pos int, kind string, fragment string")
    return parts.withColumn("parsed", F.when(F.col("kind") == "json", F.try_parse_json("fragment")))
