"""Predicates over logs (columns ts, level, msg, props, device_id).

Each gives a non-null boolean column. A property that a log lacks makes every test false, negative ones too; only
not_exists is true then. A test that makes no sense raises ValueError when it is built.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.fields import VERSION_PARTS, level_rank, once, prop, prop_values, rank_of, semver, ts_part, version_of
from siltstone.functions.patterns import java_pattern

OPERATORS = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
RESERVED = ("timestamp", "level", "msg")


def _op(op: str):
    if op not in OPERATORS:
        raise ValueError(f"no such comparison: {op}")
    return OPERATORS[op]


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _text(name: str) -> Column:
    if name in ("timestamp", "level"):
        raise ValueError(f"{name} is no text")
    return F.col("msg") if name == "msg" else prop(name)


def _compare(value: Column, op: str, text: str) -> Column:
    """Versions if both sides are versions, else bytes."""
    if not isinstance(text, str):
        raise ValueError("a text is compared with a text")
    if version_of(text) is None:
        return _op(op)(value, F.lit(text))
    return once(value, lambda v: _by_version(v, semver(v), op, text))


def _by_version(value: Column, version: Column, op: str, text: str) -> Column:
    """version: semver of value, null where that is no version; then, and if the text is none, bytes are compared."""
    plain, parts = _op(op)(value, F.lit(text)), version_of(text)
    if parts is None:
        return plain
    other = F.struct(*[F.lit(str(n)).cast("decimal(20,0)").alias(p) for n, p in zip(parts, VERSION_PARTS, strict=True)])
    return F.coalesce(_op(op)(version, other), plain)


def level_cmp(op: str, level: str | int) -> Column:
    if isinstance(level, datetime):
        raise ValueError("a level isn't compared with a time")
    return _sure(_op(op)(level_rank(), F.lit(rank_of(level))))


def level_in(levels: Iterable[str | int]) -> Column:
    return _sure(level_rank().isin([rank_of(x) for x in levels]))


def level_not_in(levels: Iterable[str | int]) -> Column:
    return ~level_in(levels)


def msg_like(text: str) -> Column:
    """Substring, whatever the case."""
    return _sure(F.contains(F.lower("msg"), F.lower(F.lit(text))))


def msg_not_like(text: str) -> Column:
    return _sure(~F.contains(F.lower("msg"), F.lower(F.lit(text))))


def _search(pattern: str) -> str:
    """The pattern (patterns.py says in which dialect) as Java's; ValueError if it is none."""
    from pyspark import SparkContext

    found = java_pattern(pattern)
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(found)
    except (Py4JJavaError, PySparkException) as e:
        raise ValueError(f"no pattern: {pattern!r}") from e
    return found


def msg_matches(pattern: str) -> Column:
    return _sure(F.col("msg").rlike(_search(pattern)))


def msg_not_matches(pattern: str) -> Column:
    return _sure(~F.col("msg").rlike(_search(pattern)))


def msg_cmp(op: str, text: str) -> Column:
    return _sure(_compare(F.col("msg"), op, text))


def msg_cmp_number(op: str, number: int) -> Column:
    """Compares with the number's digits, as texts."""
    return _sure(_op(op)(F.col("msg"), F.lit(str(number))))


def prop_like(key: str, text: str) -> Column:
    """Substring, case counts."""
    return _sure(F.contains(_text(key), F.lit(text)))


def prop_not_like(key: str, text: str) -> Column:
    return _sure(~F.contains(_text(key), F.lit(text)))


def prop_matches(key: str, pattern: str) -> Column:
    return _sure(_text(key).rlike(_search(pattern)))


def prop_not_matches(key: str, pattern: str) -> Column:
    return _sure(~_text(key).rlike(_search(pattern)))


def prop_cmp(key: str, op: str, text: str) -> Column:
    return _sure(_compare(_text(key), op, text))


def prop_cmp_number(key: str, op: str, number: int) -> Column:
    return _sure(_op(op)(_text(key), F.lit(str(number))))


def _equals_any(value: Column, values: Iterable[str | int]) -> Column:
    values = list(values)
    plain = {str(x) for x in values if not isinstance(x, str) or version_of(x) is None}
    versions = [x for x in values if isinstance(x, str) and version_of(x) is not None]
    equal = lambda v: v.isin(sorted(plain)) if plain else F.lit(False)
    if not versions:
        return equal(value)
    any_of_them = lambda v, s: reduce(operator.or_, [_by_version(v, s, "=", x) for x in versions], equal(v))
    return once(value, lambda v: once(semver(v), lambda s: any_of_them(v, s)))


def field_in(name: str, values: Iterable[str | int]) -> Column:
    if name == "level":
        return level_in(values)
    return _sure(_equals_any(_text(name), values))


def field_not_in(name: str, values: Iterable[str | int]) -> Column:
    if name == "level":
        return level_not_in(values)
    return _sure(_text(name).isNotNull() & ~_equals_any(_text(name), values))


def exists(name: str) -> Column:
    return F.lit(True) if name in RESERVED else _sure(F.exists("props", lambda p: p["key"] == name))


def not_exists(name: str) -> Column:
    return F.lit(False) if name in RESERVED else ~exists(name)


def any_value_in(key: str, values: Iterable[str | int]) -> Column:
    """Whether any of a repeated key's values is one of values."""
    values = list(values)
    return _sure(F.exists(prop_values(key), lambda v: _equals_any(v, values)))


def _of_day(op: str, instant: datetime, day: str | None) -> list[Column]:
    """What a comparison of ts says of the day (UTC) under which a log is stored."""
    if day is None or op == "!=":
        return []
    return [_op({">": ">=", "<": "<="}.get(op, op))(F.col(day), F.to_date(F.lit(instant)))]


def ts_cmp(op: str, instant: datetime, day: str | None = None) -> Column:
    """day: the column of the stored day, if the table has one. The test on it follows from the one on ts and changes no result, but folders of
    other days aren't read then, under and and or alike."""
    if not isinstance(instant, datetime):
        raise ValueError("a time is compared with a time")
    return all_of(_sure(_op(op)(F.col("ts"), F.lit(instant))), *_of_day(op, instant, day))


def ts_part_cmp(part: str, op: str, number: int, minutes_west: int = 0) -> Column:
    if not isinstance(number, int):
        raise ValueError("a part of a time is compared with a number")
    return _sure(_op(op)(ts_part(part, minutes_west), F.lit(number)))


def all_of(*tests: Column) -> Column:
    """All of the tests; without tests the filter is empty, so true."""
    return reduce(operator.and_, tests) if tests else F.lit(True)


def any_of(*tests: Column) -> Column:
    """Any of the tests; without tests the filter is empty, so true."""
    return reduce(operator.or_, tests) if tests else F.lit(True)


def text_search(text: str) -> Column:
    return msg_like(text)


def time_range(start: datetime | None = None, end: datetime | None = None, day: str | None = None) -> Column:
    """Both ends count. day: as in ts_cmp."""
    ends = [(">=", start)] * (start is not None) + [("<=", end)] * (end is not None)
    return all_of(*[ts_cmp(op, at, day) for op, at in ends])


def for_devices(ids: Iterable[str]) -> Column:
    return _sure(F.col("device_id").isin(list(ids)))


def allowed_by_device(logs: DataFrame, devices: DataFrame) -> DataFrame:
    """Logs whose device sends logs and has a minimum level at or below the log's. Logs of unlisted devices go."""
    limits = devices.where("send_logs").select(F.col("id").alias("device_id"), "filter_level")
    return logs.join(limits, "device_id").where(level_rank() >= F.col("filter_level")).select(logs.columns)


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary SQL functions, which Spark inlines: log_prop, log_prop_exists, log_level_rank, log_device, msg_contains."""
    props = "props ARRAY<STRUCT<key STRING, value STRING>>"
    ranks = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(("trace", "debug", "info", "warn", "error", "fatal"), 1))
    for signature, kind, body in (
        (f"log_prop({props}, k STRING)", "STRING", "get(filter(props, p -> p.key = k), 0).value"),
        (f"log_prop_exists({props}, k STRING)", "BOOLEAN", "coalesce(exists(props, p -> p.key = k), false)"),
        ("log_level_rank(level STRING)", "INT", f"CASE level {ranks} ELSE 7 END"),
        (f"log_device({props})", "STRING", "coalesce(get(filter(props, p -> p.key = 'deviceId'), 0).value, 'unknown')"),
        ("msg_contains(msg STRING, x STRING)", "BOOLEAN", "coalesce(contains(lower(msg), lower(x)), false)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
