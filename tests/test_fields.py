import time
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import fields as P
from siltstone.functions.schema import LOGS

UTC = timezone.utc


def logs(spark, *rows):
    """rows: (ts, level, props as a list of pairs, msg)"""
    data = [(1, i, ts, level, [{"key": k, "value": v} for k, v in props], msg) for i, (ts, level, props, msg) in enumerate(rows)]
    return spark.createDataFrame(data, LOGS)


AT = datetime(2024, 5, 15, tzinfo=UTC)


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_ids(spark):
    df = logs(spark, (datetime(2024, 5, 15, 0, 0, 0, 123456, tzinfo=UTC), "info", [], ""))
    ms = int(AT.timestamp() * 1000) + 123
    assert int(one(df, P.log_id())) == ms << 32
    assert one(df, P.log_id_hex()) == f"{ms << 32:032x}"


def test_levels(spark):
    names = ["info", "INFO", "Info", "warning", "fatal", "", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(P.level_parse("t")).collect()] == ["info", "info", "unknown", "unknown", "fatal", "unknown", "unknown"]
    numbers = spark.createDataFrame([(n,) for n in (0, 1, 6, 7)], "n int")
    assert [r[0] for r in numbers.select(P.level_from_number("n")).collect()] == ["unknown", "trace", "fatal", "unknown"]
    assert [r[0] for r in df.select(P.level_rank("t")).collect()] == [3, 7, 7, 7, 6, 7, 7]


def test_props(spark):
    df = logs(spark, (AT, "info", [("service", "auth"), ("x", "1"), ("service", "auth2")], "m"))
    assert one(df, P.prop("service")) == "auth"
    assert one(df, P.prop("nope")) is None
    assert one(df, P.prop_values("service")) == ["auth", "auth2"]
    assert one(df, P.device_id()) == "unknown"
    assert one(df, F.get(P.with_device_prop(), F.lit(3)))["value"] == "unknown"
    named = logs(spark, (AT, "info", [("deviceId", "d1"), ("deviceId", "d2")], "m"))
    assert one(named, P.device_id()) == "d1"
    assert one(named, F.size(P.with_device_prop())) == 2


def test_time_parts(spark):
    df = logs(spark, (AT, "info", [], ""))
    assert [one(df, P.ts_part(p)) for p in P.TIME_PARTS] == [2024, 5, 15, 0, 0, 0]
    assert one(df, P.ts_part("hour", 120)) == 22
    assert one(df, P.ts_part("day", 120)) == 14


def model(text):
    parts = text.split(".")
    cut = lambda s: s.split("-")[0].split("+")[0]
    numbers = [parts[0], *[cut(parts[i]) if len(parts) > i else "0" for i in (1, 2)]]
    out = []
    for i, n in enumerate(numbers):
        if i == 0 and n.startswith("+"):
            n = n[1:]
        if not (n and all(c in "0123456789" for c in n)) or int(n) >= 2**64:
            return None
        out.append(int(n))
    return tuple(out)


def versions(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", P.semver("t").alias("v")).orderBy("i").collect()
    return [None if r["v"] is None else tuple(int(x) for x in r["v"]) for r in rows]


def test_semver_examples(spark):
    texts = ["1.10.0", "1", "1.2", "1.2-rc.3", "1.2.3+b", "1.", " 1.0", "+1.0", "1.+2", "1.2.3.4", "a.b", "", "1.5.x", "1.x.3", "1.2.x", "1..3", "18446744073709551615", "18446744073709551616", "1\n"]
    assert versions(spark, texts) == [model(t) for t in texts]
    assert [P.version_of(t) for t in texts] == [model(t) for t in texts]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("0123456789.-+ ab", max_size=12), min_size=1, max_size=60))
def test_semver_model(spark, texts):
    assert [P.version_of(t) for t in texts] == [model(t) for t in texts]
    assert versions(spark, texts) == [model(t) for t in texts]


def test_sizes_and_buckets(spark):
    df = logs(spark, (datetime(2024, 1, 1, 0, 1, 7, tzinfo=UTC), "info", [("é", "v")], "añb"))
    assert one(df, P.record_bytes()) == 20 + 2 + 2 + 1 + 4
    start = int(datetime(2024, 1, 1, 0, 1, tzinfo=UTC).timestamp())
    assert one(df, P.bucket_start(60)) == start


def test_fragments(spark):
    df = spark.createDataFrame([(1, 'got {"a": {"b": 1}} and {not json} <x><y/></x>'), (2, None), (3, ""), (4, "{{")], "id long, msg string")
    rows = P.msg_fragments(df, "id").select("id", "pos", "kind", "fragment", F.expr("variant_get(parsed, '$.a.b', 'int')").alias("b")).orderBy("id", "pos").collect()
    assert [(r["id"], r["kind"], r["fragment"].strip(), r["b"]) for r in rows] == [
        (1, "text", "got", None), (1, "json", '{"a": {"b": 1}}', 1), (1, "text", "and", None), (1, "text", "{not json}", None), (1, "xml", "<x><y/></x>", None), (4, "text", "{{", None),
    ]


def test_split_message():
    split = P.split_message
    assert split("<a/> tail") == [("xml", "<a/>"), ("text", " tail")]
    assert split("<a/><b/>") == [("xml", "<a/>"), ("xml", "<b/>")]
    assert split("x <a/>") == [("text", "x <a/>")]
    assert split('{"a": NaN}{"a": 1}') == [("text", '{"a": NaN}'), ("json", '{"a": 1}')]
    assert split('} {"a": 1} b') == [("text", '} {"a": 1} b')]  # a brace that closes nothing shifts the rest
    assert split("<a>{x}</a>") == [("text", "<a>"), ("text", "{x}"), ("text", "</a>")]
    for msg in ("", "a{b}{c", "<a><b></a>", " <x> </x> {}"):
        assert "".join(x for _, x in split(msg)) == msg


def split_by_hand(msg):
    """Every > outside blocks parses all that the fragment has so far."""
    out, start, depth = [], 0, 0
    for i, c in enumerate(msg):
        if c == "{":
            depth += 1
            if depth == 1 and i > start:
                out.append(("text", msg[start:i]))
                start = i
        elif c == "}":
            depth -= 1
            if depth == 0:
                out.append((P._kind(msg[start : i + 1]), msg[start : i + 1]))
                start = i + 1
        elif c == ">" and depth == 0 and P._kind(msg[start : i + 1]) == "xml":
            out.append(("xml", msg[start : i + 1]))
            start = i + 1
    return out + ([(P._kind(msg[start:]), msg[start:])] if start < len(msg) else [])


PIECES = ["<a>", "</a>", "<b/>", "<b x='>'/>", '<b y="a>b">', "</b>", "<!-- > -->", "<?xml version='1.0'?>", "<!DOCTYPE a>", "<![CDATA[>]]>", "&amp;", "&nbsp;", "<n:a/>", "<b x='1' x='2'/>", " ", "\n", "é", "x", "{", "}", '{"k": [1]}', ">", "<", "\u00a0", "\x00", "日"]


@settings(max_examples=1_500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_split_model(msg):
    assert P.split_message(msg) == split_by_hand(msg)


@pytest.mark.parametrize("msg", ["<a>" + "<b>x</b>" * 120_000, "<a>" + "<b>x</b>" * 120_000 + "</a>", "<b>x</b>" * 120_000, "<!-- " + "> " * 500_000, "<a b='" + ">" * 900_000, "<a>" + "é>" * 400_000 + "</a>", "{" * 500_000 + "}" * 500_000, "> " * 500_000, "<" * 900_000])
def test_split_is_linear(msg):
    began = time.process_time()
    assert "".join(x for _, x in P.split_message(msg)) == msg
    assert time.process_time() - began < 8
