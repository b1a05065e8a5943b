from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import filters as X
from siltstone.functions.fields import device_id
from tests.test_fields import AT, logs, model

BASE = [("service", "auth"), ("user_id", "123"), ("duration_ms", "150"), ("version", "1.10.0")]


@pytest.fixture(scope="module")
def base(spark):
    return logs(spark, (AT, "info", BASE, 'User login successful "ok"')).withColumn("device_id", device_id()).cache()


def holds(df, test):
    value = df.select(test.alias("x")).first()["x"]
    assert value is not None
    return value


@pytest.mark.parametrize(("test", "expected"), [
    (lambda: X.level_cmp("=", "INFO"), True), (lambda: X.level_cmp(">", 2), True), (lambda: X.level_cmp(">", "Info"), False), (lambda: X.level_in(["info", "debug"]), True),
    (lambda: X.level_not_in(["info"]), False), (lambda: X.msg_like("LOGIN"), True), (lambda: X.msg_not_like("login"), False), (lambda: X.msg_like('"ok"'), True),
    (lambda: X.msg_matches("^User.*success"), True), (lambda: X.msg_not_matches("success"), False), (lambda: X.msg_cmp(">", "A"), True), (lambda: X.prop_like("service", "AUTH"), False),
    (lambda: X.prop_like("service", "aut"), True), (lambda: X.prop_not_like("nope", "x"), False), (lambda: X.prop_not_matches("nope", "x"), False), (lambda: X.prop_cmp("nope", "!=", "x"), False),
    (lambda: X.prop_cmp("version", ">", "1.2.0"), True), (lambda: X.prop_cmp("version", "<", "2.0.0"), True), (lambda: X.prop_cmp("version", "=", "1.10"), True), (lambda: X.prop_cmp_number("duration_ms", ">", 20), False),
    (lambda: X.prop_cmp("duration_ms", ">", "20"), True), (lambda: X.field_in("version", ["1.10"]), True), (lambda: X.field_not_in("nope", ["x"]), False), (lambda: X.field_in("user_id", [123]), True),
    (lambda: X.field_in("level", ["info"]), True), (lambda: X.exists("service"), True), (lambda: X.exists("msg"), True), (lambda: X.not_exists("nope"), True), (lambda: X.not_exists("level"), False),
    (lambda: X.ts_cmp("<", datetime(2024, 5, 16, tzinfo=timezone.utc)), True), (lambda: X.ts_part_cmp("hour", "=", 0), True), (lambda: X.ts_part_cmp("hour", "=", 2, -120), True), (lambda: X.all_of(), True),
    (lambda: X.any_of(), True), (lambda: X.any_of(X.msg_like("zzz"), X.text_search("user")), True), (lambda: X.time_range(end=datetime(2024, 5, 15, tzinfo=timezone.utc)), True), (lambda: X.for_devices(["unknown"]), True),
])
def test_examples(base, test, expected):
    assert holds(base, test()) is expected


def test_unknown_level_passes_fatal(spark):
    assert holds(logs(spark, (AT, "unknown", [], "")), X.level_cmp(">", "fatal"))


def test_any_value(spark):
    df = logs(spark, (AT, "info", [("service", "auth"), ("service", "auth2")], ""))
    assert holds(df, X.any_value_in("service", ["auth2"]))
    assert not holds(df, X.prop_cmp("service", "=", "auth2"))


def test_null_message(spark):
    df = logs(spark, (AT, None, [], None))
    assert not any(holds(df, t) for t in (X.msg_like("a"), X.msg_not_like("a"), X.msg_matches("a"), X.msg_cmp("!=", "a")))


@pytest.mark.parametrize("bad", [
    lambda: X.level_cmp("~", "info"), lambda: X.level_cmp("=", AT), lambda: X.ts_cmp("=", "info"), lambda: X.prop_like("level", "i"), lambda: X.ts_part_cmp("week", "=", 1), lambda: X.ts_part_cmp("hour", "=", "x"), lambda: X.prop_cmp("a", "=", AT),
])
def test_senseless(spark, bad):
    with pytest.raises(ValueError):
        bad()


@settings(max_examples=10, deadline=None)
@given(st.sampled_from(sorted(X.OPERATORS)), st.text("0123456789.-a", max_size=6), st.lists(st.text("0123456789.-a", max_size=6), min_size=1, max_size=30))
def test_compare_model(spark, op, operand, values):
    df = spark.createDataFrame([(i, [{"key": "k", "value": v}]) for i, v in enumerate(values)], "i int, props array<struct<key:string,value:string>>")
    got = [r[1] for r in df.select("i", X.prop_cmp("k", op, operand)).orderBy("i").collect()]

    def expected(v):
        a, b = model(v), model(operand)
        return X.OPERATORS[op](a, b) if a and b else X.OPERATORS[op](v.encode(), operand.encode())

    assert got == [expected(v) for v in values]


def test_allowed_by_device(spark):
    df = logs(spark, (AT, "debug", [("deviceId", "a")], ""), (AT, "warn", [("deviceId", "a")], ""), (AT, "error", [("deviceId", "b")], ""), (AT, "error", [], "")).withColumn("device_id", device_id())
    devices = spark.createDataFrame([("a", True, 3), ("b", False, 1)], "id string, send_logs boolean, filter_level int")
    assert [r["level"] for r in X.allowed_by_device(df, devices).collect()] == ["warn"]


def test_sql_functions(spark, base):
    X.register_sql_functions(spark)
    base.createOrReplaceTempView("sql_logs")
    out = spark.sql("SELECT log_prop(props, 'service') p, log_prop_exists(props, 'nope') e, log_level_rank(level) r, log_device(props) d, msg_contains(msg, 'LOGIN') m FROM sql_logs").first()
    assert tuple(out) == ("auth", False, 3, "unknown", True)
    plan = base.where(X.level_cmp(">=", "warn"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_push_down(spark, tmp_path):
    from siltstone.sources.logs import read_logs, write_logs

    write_logs(logs(spark, (AT, "info", [("deviceId", "a")], "m")).withColumn("device_id", device_id()), str(tmp_path / "logs"))
    out = read_logs(spark, str(tmp_path / "logs")).where(X.all_of(X.for_devices(["a"]), X.ts_cmp("<=", AT))).select("msg")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "device_id" in plan.split("PushedFilters")[1] and "props" not in plan.split("ReadSchema")[1]
    assert out.count() == 1
    assert out.select(F.col("msg")).first()[0] == "m"
