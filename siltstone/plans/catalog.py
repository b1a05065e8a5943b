"""Every registered query on logs, with its SQL twin where SQL can express it.

A query is applied to the logs view of the events table, or to device and segment tables that Spark derives
from it and from customer and nation.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import fields as P
from siltstone.functions import filters as X
from siltstone.operators import aggregates as A
from siltstone.operators import devices as J
from siltstone.operators import search as Q
from siltstone.operators import segments as C
from siltstone.operators import templates as D
from siltstone.operators import windows as W
from siltstone.sources import batches as B
from siltstone.sources import logs as S
from siltstone.sources.compaction import compact_files, file_rows
from siltstone.sources.scratch import materialize, new_folder
from siltstone.sources.skipping import write_properties
from siltstone.sources.tables import create_table, merge_once, read_table
from siltstone.streaming import streams as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Rows of a segment in the queries: small, so that devices have several.
SIZE = 30
NOW = datetime(2024, 2, 1)
MID = datetime(2024, 1, 15, 12, 0, 0)
NOW_SQL, MID_SQL = "TIMESTAMP '2024-02-01 00:00:00'", "TIMESTAMP '2024-01-15 12:00:00'"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return add


def ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz").alias(c)


# -- SQL of the shared tables ------------------------------------------------------------------------------------------

_K = "CAST(regexp_extract(props, '[0-9]+') AS INT)"
LOGS_SQL = f"""logs AS (
  SELECT 1 AS version, event_id AS random, ts, event_type || ' user ' || user_id || ' k ' || {_K} AS msg,
    CASE event_type WHEN 'view' THEN 'debug' WHEN 'click' THEN 'info' WHEN 'signup' THEN 'info' WHEN 'purchase' THEN 'warn' WHEN 'error' THEN 'error' ELSE 'unknown' END AS level,
    list_concat(list_concat(CASE WHEN user_id % 10 <> 0 THEN [{{'key': 'deviceId', 'value': CAST(user_id AS VARCHAR)}}] ELSE [] END,
      [{{'key': 'k', 'value': CAST({_K} AS VARCHAR)}}, {{'key': 'version', 'value': '1.' || ({_K} % 12) || '.' || ({_K} % 7)}}]),
      CASE WHEN event_id % 7 = 0 THEN [{{'key': 'k', 'value': 'dup'}}] ELSE [] END) AS props,
    CASE WHEN user_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) ELSE 'unknown' END AS device_id
  FROM events)"""
ID_SQL = "(CAST(floor(epoch_us(ts) / 1000) AS HUGEINT) * 4294967296 + random)"
RANK_SQL = "CASE level WHEN 'trace' THEN 1 WHEN 'debug' THEN 2 WHEN 'info' THEN 3 WHEN 'warn' THEN 4 WHEN 'error' THEN 5 WHEN 'fatal' THEN 6 ELSE 7 END"
BYTES_SQL = "(20 + coalesce(list_sum(list_transform(props, lambda x: 2 + strlen(x.key) + strlen(x.value))), 0) + strlen(msg))"
CHUNKS_SQL = f"chunks AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY device_id ORDER BY ts, {ID_SQL}) - 1) / {SIZE}) AS INT) AS chunk FROM logs)"
SEGMENTS_SQL = f"""segments AS (
  SELECT CASE WHEN device_id = 'unknown' THEN 0 ELSE CAST(device_id AS BIGINT) END * 100000 + chunk AS id, * FROM (
    SELECT device_id, chunk, min(ts) AS first_timestamp, max(ts) AS last_timestamp, count(*) AS logs_count,
      CAST(sum({BYTES_SQL}) + 13 AS BIGINT) AS original_size, CAST((sum({BYTES_SQL}) + 13) // 3 AS BIGINT) AS compressed_size
    FROM chunks GROUP BY device_id, chunk))"""
PROPS_SQL = "segment_props AS (SELECT DISTINCT device_id, chunk, p.key AS key, p.value AS value FROM (SELECT device_id, chunk, unnest(list_append(props, {'key': 'level', 'value': level})) AS p FROM chunks))"
DEVICES_SQL = f"""devices AS (
  SELECT device_id AS id, length(device_id) % 2 = 0 AS send_logs, CAST(1 + logs_count % 5 AS INT) AS filter_level, logs_size, logs_count, created_at,
    CASE WHEN logs_count % 9 = 0 THEN NULL ELSE last_upload_at END AS last_upload_at, 60 AS send_interval
  FROM (SELECT device_id, count(*) AS logs_count, CAST(sum({BYTES_SQL}) AS BIGINT) AS logs_size, min(ts) AS created_at, max(ts) AS last_upload_at FROM logs GROUP BY device_id)),
device_props AS (
  SELECT d.id AS device_id, 'segment' AS key, c.c_mktsegment AS value FROM devices d JOIN customer c ON d.id = CAST(c.c_custkey AS VARCHAR)
  UNION SELECT d.id, 'nation', n.n_name FROM devices d JOIN customer c ON d.id = CAST(c.c_custkey AS VARCHAR) JOIN nation n ON c.c_nationkey = n.n_nationkey)"""
DEVICE_COLUMNS = "id, send_logs, filter_level, logs_size, logs_count, created_at, last_upload_at, send_interval"


def with_(*tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n"


LOGS, CHUNKS, SEGMENTS, DEVICES = with_(LOGS_SQL), with_(LOGS_SQL, CHUNKS_SQL), with_(LOGS_SQL, CHUNKS_SQL, SEGMENTS_SQL), with_(LOGS_SQL, DEVICES_SQL)


def prop_sql(key: str) -> str:
    return f"list_extract(list_transform(list_filter(props, lambda x: x.key = '{key}'), lambda x: x.value), 1)"


def semver_sql(text: str) -> str:
    parts = f"string_split({text}, '.')"
    tail = lambda i: f"regexp_extract(coalesce({parts}[{i}], '0'), '^[^-+]*')"
    return (
        f"CASE WHEN regexp_full_match({parts}[1], '[+]?[0-9]+') AND regexp_full_match({tail(2)}, '[0-9]+') AND regexp_full_match({tail(3)}, '[0-9]+') "
        f"THEN [CAST(ltrim({parts}[1], '+') AS UBIGINT), CAST({tail(2)} AS UBIGINT), CAST({tail(3)} AS UBIGINT)] END"
    )


def compare_sql(value: str, op: str, text: str) -> str:
    a, b = semver_sql(value), semver_sql(f"'{text}'")
    return f"coalesce(CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN ({a}) {op} ({b}) ELSE {value} {op} '{text}' END, false)"


# -- shared tables in Spark --------------------------------------------------------------------------------------------


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.logs_from_events(spark, sf_dir)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.cut_segments(logs(spark, sf_dir), SIZE)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.segment_summary(chunks(spark, sf_dir))
    number = F.when(F.col("device_id") == "unknown", F.lit(0)).otherwise(F.col("device_id").try_cast("long"))
    return rows.select((number * 100000 + F.col("chunk")).alias("id"), "*", F.floor(F.col("original_size") / 3).alias("compressed_size"))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).groupBy("device_id").agg(F.count("*").alias("logs_count"), F.sum(P.record_bytes()).alias("logs_size"), F.min("ts").alias("created_at"), F.max("ts").alias("last_upload_at"))
    return rows.select(
        F.col("device_id").alias("id"), (F.length("device_id") % 2 == 0).alias("send_logs"), (1 + F.col("logs_count") % 5).cast("int").alias("filter_level"), "logs_size", "logs_count", "created_at",
        F.when(F.col("logs_count") % 9 != 0, F.col("last_upload_at")).alias("last_upload_at"), F.lit(60).alias("send_interval"),
    )


def device_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = logs(spark, sf_dir).select("device_id").distinct()
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("device_id"), "c_mktsegment", "c_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    known = ids.join(customer, "device_id")
    return (
        known.select("device_id", F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value"))
        .union(known.join(nation, "c_nationkey").select("device_id", F.lit("nation").alias("key"), F.col("n_name").alias("value"))).distinct()
    )


def show_devices(df: DataFrame) -> DataFrame:
    return df.select("id", "send_logs", "filter_level", "logs_size", "logs_count", ntz("created_at"), ntz("last_upload_at"), "send_interval")


def show_logs(df: DataFrame) -> DataFrame:
    pairs = F.array_join(F.transform("props", lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")
    return df.select("version", "random", ntz("ts"), "level", pairs.alias("props"), "msg", "device_id")


SHOW_LOGS = "SELECT version, random, ts, level, array_to_string(list_transform(props, lambda x: x.key || '=' || x.value), ',') AS props, msg, device_id FROM logs"


# -- sources and sinks -------------------------------------------------------------------------------------------------


@register("s1_read_logs", LOGS + SHOW_LOGS)
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "logs")
    S.write_logs(logs(spark, sf_dir), path)
    return show_logs(S.read_logs(spark, path))


def _binary_files(spark: SparkSession, sf_dir: str, magic: bytes | None = None) -> str:
    """A folder of files of binary records, or of stored chunks."""
    path = new_folder(spark, "batches")
    files = B.encode_batches(logs(spark, sf_dir).repartition(16), 5_000)
    B.write_files(files if magic is None else B.pack_segments(files, magic), path)
    return path


@register("s2_decode_batches", LOGS + SHOW_LOGS)
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_logs(B.decode_batches(spark, _binary_files(spark, sf_dir)).withColumn("device_id", P.device_id()))


@register("s3_import_segments", LOGS + f"SELECT device_id, count(*) AS logs_count, CAST(sum({BYTES_SQL}) AS BIGINT) AS logs_size, max(ts) AS last_upload_at FROM logs GROUP BY device_id")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.log_files(spark, _binary_files(spark, sf_dir, b"LOGSEGMENTS"))
    stored = B.decode_segments(files, b"LOGSEGMENTS").withColumn("device_id", P.device_id())
    return A.device_rollup(stored).select("device_id", "logs_count", "logs_size", ntz("last_upload_at"))


@register("s3_import_segment_tables", with_(LOGS_SQL, CHUNKS_SQL, PROPS_SQL) + f"""SELECT 'segments' AS part, CAST(count(*) AS VARCHAR) AS key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') || ' ' || strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS value, CAST(sum({BYTES_SQL}) AS BIGINT) AS bytes FROM logs
  UNION ALL SELECT DISTINCT 'props', key, value, 0 FROM segment_props""")
def s3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the segments that an import finds: logs, first and last time and bytes without headers; and all their properties."""
    _, found, props = B.import_segments(spark, _binary_files(spark, sf_dir, b"LOGSEGMENTS"), b"LOGSEGMENTS")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    totals = found.agg(F.sum("logs_count").alias("n"), F.min("first_timestamp").alias("a"), F.max("last_timestamp").alias("b"), F.sum(F.col("original_size") - 13).alias("bytes"))
    totals = totals.select(F.lit("segments").alias("part"), F.col("n").cast("string").alias("key"), F.concat_ws(" ", at("a"), at("b")).alias("value"), "bytes")
    return totals.unionByName(props.select(F.lit("props").alias("part"), "key", "value", F.lit(0).cast("long").alias("bytes")).distinct())


@register("s5_write_logs", LOGS + "SELECT random, ts, msg, device_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM logs")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in two goes, a device's logs of a day spread over three files and more; read back by day."""
    path, rows = new_folder(spark, "logs"), logs(spark, sf_dir)
    S.write_logs(rows.where(F.col("ts") < F.lit(MID)), path, rows=50, buckets_per_device=3)
    S.write_logs(rows.where(F.col("ts") >= F.lit(MID)), path, rows=50, buckets_per_device=3)
    return S.read_logs(spark, path).select("random", ntz("ts"), "msg", "device_id", F.col("day").cast("string").alias("day"))


@register("s8_read_json_logs", LOGS + SHOW_LOGS)
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "json-logs")
    S.to_json_lines(logs(spark, sf_dir)).write.text(path)
    return show_logs(S.read_json_logs(spark, path))


@register("s8_unreadable_json_lines", LOGS + "SELECT reason, count(*) AS lines FROM (SELECT CASE WHEN random % 50 = 0 THEN 'no json' WHEN random % 70 = 0 THEN 'no time' ELSE 'logs' END AS reason FROM logs) GROUP BY reason")
def s8_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines in files some are cut off and some have no time; all are accounted for."""
    path = new_folder(spark, "json-logs")
    line, number = S.json_line(), F.col("random")
    broken = F.when(number % 50 == 0, F.substring(line, 1, 40)).when(number % 70 == 0, F.regexp_replace(line, '"timestamp":"[^"]*"', '"timestamp":"soon"')).otherwise(line)
    logs(spark, sf_dir).select(broken.alias("value")).write.text(path)
    good, bad = S.read_json_logs_checked(spark, path)
    return bad.select("reason").unionByName(good.select(F.lit("logs").alias("reason"))).groupBy("reason").agg(F.count("*").alias("lines"))


@register("s6_json_lines", LOGS + SHOW_LOGS)
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = materialize(S.to_json_lines(logs(spark, sf_dir)), "json")
    return show_logs(S.from_json_lines(lines))


@register("s7_text_lines", LOGS + """SELECT random, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || ' ' || upper(level)
  || array_to_string(list_transform(props, lambda x: ' ' || x.key || '=' || x.value), '') || ' ' || msg AS line FROM logs""")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("random", S.text_line().alias("line"))


@register("s10_drop_bad_clocks", LOGS + "SELECT random, ts FROM (SELECT random, CASE random % 5 WHEN 0 THEN ts - INTERVAL 6 YEAR WHEN 1 THEN ts + INTERVAL 11 YEAR WHEN 2 THEN ts - INTERVAL 1 YEAR ELSE ts END AS ts FROM logs) WHERE year(ts) BETWEEN 2023 AND 2034")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five devices' clocks, one is years behind and one years ahead."""
    wrong = F.when(F.col("random") % 5 == 0, F.col("ts") - F.expr("INTERVAL 6 YEAR")).when(F.col("random") % 5 == 1, F.col("ts") + F.expr("INTERVAL 11 YEAR"))
    rows = logs(spark, sf_dir).withColumn("ts", wrong.when(F.col("random") % 5 == 2, F.col("ts") - F.expr("INTERVAL 1 YEAR")).otherwise(F.col("ts")))
    return S.drop_bad_clocks(rows, NOW).select("random", ntz("ts"))


# -- fields ------------------------------------------------------------------------------------------------------------



def field(name: str, column: Callable[[], Column], sql: str, out: str = "value") -> None:
    @register(name, LOGS + f"SELECT random, {sql} AS {out} FROM logs")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return logs(spark, sf_dir).select("random", column().alias(out))


field("p1_log_id", lambda: P.log_id().cast("string"), f"CAST({ID_SQL} AS VARCHAR)")
field("p2_log_id_hex", P.log_id_hex, f"lpad(lower(to_hex({ID_SQL})), 32, '0')")
field("p3_level_rank", lambda: P.level_rank(), RANK_SQL)
field("p3_level_parse", lambda: P.level_parse(F.when(F.col("random") % 3 == 0, F.upper("level")).when(F.col("random") % 3 == 1, F.initcap("level")).otherwise(F.col("level"))), "CASE WHEN random % 3 = 1 THEN 'unknown' ELSE level END")
field("p4_prop", lambda: P.prop("k"), prop_sql("k"))
field("p5_prop_values", lambda: F.array_join(P.prop_values("k"), ","), "array_to_string(list_transform(list_filter(props, lambda x: x.key = 'k'), lambda x: x.value), ',')")
field("p6_device_id", lambda: P.device_id(), f"coalesce({prop_sql('deviceId')}, 'unknown')")
field(
    "p7_with_device_prop", lambda: F.array_join(F.transform(P.with_device_prop(), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ","),
    f"array_to_string(list_transform(CASE WHEN {prop_sql('deviceId')} IS NULL THEN list_append(props, {{'key': 'deviceId', 'value': 'unknown'}}) ELSE props END, lambda x: x.key || '=' || x.value), ',')",
)
field("p9_semver", lambda: (lambda v: F.concat_ws("/", v["major"].cast("string"), v["minor"].cast("string"), v["patch"].cast("string")))(P.semver(P.prop("version"))), f"array_to_string(list_transform({semver_sql(prop_sql('version'))}, lambda x: CAST(x AS VARCHAR)), '/')")
field("p10_bucket_start", lambda: P.bucket_start(3600), "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) % 3600")
field("p11_record_bytes", lambda: P.record_bytes(), f"CAST({BYTES_SQL} AS BIGINT)")


@register("p8_ts_part", LOGS + "SELECT random, " + ", ".join(f"CAST(date_part('{p}', ts + INTERVAL 330 MINUTE) AS INT) AS {p}_at" for p in P.TIME_PARTS) + " FROM logs")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("random", *[P.ts_part(p, -330).alias(f"{p}_at") for p in P.TIME_PARTS])


_P12 = "SELECT event_id, CAST({} AS INT) AS pos, '{}' AS kind, {} AS fragment FROM events"
_ODD = "event_id % 2 = 1"


@register("p12_msg_fragments", " UNION ALL ".join([
    _P12.format(0, "text", "event_type || ' '"), _P12.format(1, "json", "props"), _P12.format(2, "xml", "'<user id=\"' || user_id || '\"/>'") + " WHERE NOT " + _ODD, _P12.format(3, "text", "' tail '") + " WHERE NOT " + _ODD,
    _P12.format(4, "text", "'{no json ' || event_type || '}'") + " WHERE NOT " + _ODD, _P12.format(2, "text", "' by <user id=\"' || user_id || '\"/>'") + " WHERE " + _ODD,
]))
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that carry the event's JSON; XML right after it, a text and braces without JSON; or XML inside a text."""
    user = F.concat(F.lit('<user id="'), F.col("user_id").cast("string"), F.lit('"/>'))
    tail = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit(" by "), user)).otherwise(F.concat(user, F.lit(" tail {no json "), "event_type", F.lit("}")))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("msg", F.concat("event_type", F.lit(" "), "props", tail))
    return P.msg_fragments(e, "event_id").drop("parsed")


# -- filters -----------------------------------------------------------------------------------------------------------


def condition(name: str, test: Callable[[], Column], sql: str) -> None:
    @register(name, LOGS + f"SELECT random, level, msg, device_id FROM logs WHERE {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return logs(spark, sf_dir).where(test()).select("random", "level", "msg", "device_id")


condition("f1_level_cmp", lambda: X.level_cmp(">=", "warn"), f"{RANK_SQL} >= 4")
condition("f2_level_in", lambda: X.level_in(["info", "error"]), "level IN ('info', 'error')")
condition("f2_level_not_in", lambda: X.level_not_in(["info", 5]), "level NOT IN ('info', 'error')")
condition("f3_msg_like", lambda: X.msg_like("ERROR user 1"), "contains(lower(msg), 'error user 1')")
condition("f4_msg_not_like", lambda: X.msg_not_like("User 1"), "NOT contains(lower(msg), 'user 1')")
condition("f5_msg_matches", lambda: X.msg_matches(r"user \d+ k [0-4]\d?$"), "regexp_matches(msg, 'user [0-9]+ k [0-4][0-9]?$')")
condition("f5_msg_not_matches", lambda: X.msg_not_matches(r"^(view|click)"), "NOT regexp_matches(msg, '^(view|click)')")


#: Patterns in which Java's dialect differs, over messages of which some end in a line end.
_PATTERNS = (
    r"k 1\d$", r"(?m)k 1\d$", r"^[[:alpha:]]+ user [[:digit:]]+ k [[:digit:]]+$", r"(?P<kind>error|view) user (?P<who>[0-9]{2})\b", r"(?i)^(VIEW|Click) user 1", r"\x{65}rror user \d+ k \d+\n\z",
    r"user [1-3]+ k [^1-5]+$", r"(?s)click.*k.$", r"click.*k 3.$", r"^\S+ user (?:7|8|1\d{2}) k",
)


def _lined() -> Column:
    return F.when(F.col("random") % 3 == 0, F.concat("msg", F.lit("\n"))).otherwise(F.col("msg"))


@register("f5_msg_matches_patterns", LOGS + ", lined AS (SELECT random, CASE WHEN random % 3 = 0 THEN msg || chr(10) ELSE msg END AS msg FROM logs)\n" + " UNION ALL ".join(f"SELECT {i} AS pattern, random FROM lined WHERE regexp_matches(msg, '{x}')" for i, x in enumerate(_PATTERNS)))
def f5_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = logs(spark, sf_dir).withColumn("msg", _lined())
    hits = F.array_compact(F.array(*[F.when(X.msg_matches(x), F.lit(i)) for i, x in enumerate(_PATTERNS)]))
    return df.select(F.explode(hits).alias("pattern"), "random")


condition("f6_msg_cmp", lambda: X.msg_cmp(">", "purchase user 5"), compare_sql("msg", ">", "purchase user 5"))


@register("f7_msg_cmp_number", LOGS + f"SELECT random, level, {prop_sql('k')} AS msg FROM logs WHERE {prop_sql('k')} > '30'")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are digits, of which those after '30' as texts stay, so 4 and not 100."""
    return logs(spark, sf_dir).withColumn("msg", P.prop("k")).where(X.msg_cmp_number(">", 30)).select("random", "level", "msg")



condition("f8_prop_like", lambda: X.prop_like("version", ".1"), f"coalesce(contains({prop_sql('version')}, '.1'), false)")
condition("f8_prop_not_like", lambda: X.prop_not_like("deviceId", "1"), f"coalesce(NOT contains({prop_sql('deviceId')}, '1'), false)")
condition("f9_prop_matches", lambda: X.prop_matches("k", "^[1-3]$"), f"coalesce(regexp_matches({prop_sql('k')}, '^[1-3]$'), false)")
condition("f9_prop_not_matches", lambda: X.prop_not_matches("deviceId", "^1"), f"coalesce(NOT regexp_matches({prop_sql('deviceId')}, '^1'), false)")
condition("f10_prop_cmp", lambda: X.prop_cmp("version", ">", "1.9.2"), compare_sql(prop_sql("version"), ">", "1.9.2"))
condition("f11_prop_cmp_number", lambda: X.prop_cmp_number("k", ">", 50), f"coalesce({prop_sql('k')} > '50', false)")
condition("f12_field_in", lambda: X.field_in("version", ["1.3.3", "1.5", 7]), " OR ".join([compare_sql(prop_sql("version"), "=", "1.3.3"), compare_sql(prop_sql("version"), "=", "1.5"), f"coalesce({prop_sql('version')} = '7', false)"]))
condition("f12_field_not_in", lambda: X.field_not_in("deviceId", ["1", 22]), f"coalesce({prop_sql('deviceId')} NOT IN ('1', '22'), false)")
condition("f13_exists", lambda: X.exists("deviceId"), f"{prop_sql('deviceId')} IS NOT NULL")
condition("f13_not_exists", lambda: X.not_exists("deviceId"), f"{prop_sql('deviceId')} IS NULL")
condition("f14_ts_cmp", lambda: X.ts_cmp(">=", MID), f"ts >= {MID_SQL}")
condition("f15_ts_part_cmp", lambda: X.ts_part_cmp("hour", "<", 5, 120), "date_part('hour', ts - INTERVAL 120 MINUTE) < 5")
condition("f16_all_of_any_of", lambda: X.all_of(X.level_cmp(">", "info"), X.any_of(X.prop_cmp_number("k", "=", 7), X.msg_like("user 12"))), f"{RANK_SQL} > 3 AND (coalesce({prop_sql('k')} = '7', false) OR contains(msg, 'user 12'))")
condition("f17_text_search", lambda: X.text_search("Purchase"), "contains(lower(msg), 'purchase')")
condition("f18_time_range", lambda: X.time_range(datetime(2024, 1, 10), MID), f"ts BETWEEN TIMESTAMP '2024-01-10' AND {MID_SQL}")
condition("f19_for_devices", lambda: X.for_devices(["3", "17", "unknown"]), "device_id IN ('3', '17', 'unknown')")


@register("f20_allowed_by_device", DEVICES + f"SELECT l.random, l.level, l.device_id FROM logs l JOIN devices d ON l.device_id = d.id WHERE d.send_logs AND {RANK_SQL.replace('level', 'l.level', 1)} >= d.filter_level")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.allowed_by_device(logs(spark, sf_dir), devices(spark, sf_dir)).select("random", "level", "device_id")


# -- search ------------------------------------------------------------------------------------------------------------

_FLAG_SQL = f"{RANK_SQL} >= 4 AND contains(lower(msg), 'error')"
_PAGE = f"SELECT random, ts, level, msg, CAST({ID_SQL} AS VARCHAR) AS id FROM logs"


def _flag() -> Column:
    return X.all_of(X.level_cmp(">=", "warn"), X.msg_like("error"))


def _page(df: DataFrame) -> DataFrame:
    return df.select("random", ntz("ts"), "level", "msg", F.col("id").cast("string").alias("id"))


@register("q1_search", LOGS + f"{_PAGE} WHERE {_FLAG_SQL} ORDER BY ts DESC, {ID_SQL} DESC LIMIT 200")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(Q.search(logs(spark, sf_dir), _flag()))


@register("q2_search_page", LOGS + f", first AS (SELECT ts, {ID_SQL} AS id FROM logs WHERE {RANK_SQL} >= 4 AND ts <= {MID_SQL} ORDER BY ts DESC, id DESC LIMIT 50), last AS (SELECT ts, id FROM first ORDER BY ts, id LIMIT 1)\n"
          f"SELECT random, logs.ts, level, msg, CAST({ID_SQL.replace('(ts)', '(logs.ts)')} AS VARCHAR) AS id FROM logs, last WHERE {RANK_SQL} >= 4 AND (logs.ts < last.ts OR logs.ts = last.ts AND {ID_SQL.replace('(ts)', '(logs.ts)')} < last.id) ORDER BY logs.ts DESC, {ID_SQL.replace('(ts)', '(logs.ts)')} DESC LIMIT 50")
def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, where = logs(spark, sf_dir), X.level_cmp(">=", "warn")
    first = Q.search(df, where, 50, MID).agg(F.min(F.struct("ts", "id")).alias("x")).select("x.*").first()
    return _page(Q.search_page(df, where, 50, first["ts"], int(first["id"]))) if first["ts"] else _page(Q.search(df, where, 0))


_AGAIN = _PAGE.replace(" msg,", f" CASE WHEN {RANK_SQL} > 3 THEN 'again ' || msg ELSE msg END AS msg,")


@register("q3_dedupe_by_id", LOGS + _AGAIN)
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some logs come twice, with other messages; the lesser one stays."""
    df = logs(spark, sf_dir)
    return _page(Q.dedupe_by_id(df.unionByName(df.where(X.level_cmp(">", "info")).withColumn("msg", F.concat(F.lit("again "), "msg")))))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = new_folder(spark, "logs")
    S.write_logs(logs(spark, sf_dir), path)
    return path


@register("q1_search_stored", LOGS + f"{_PAGE} WHERE {_FLAG_SQL} ORDER BY ts DESC, {ID_SQL} DESC LIMIT 200")
def q1_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over 30 stored days, newest first; older days than it takes aren't opened."""
    return _page(Q.search_stored(spark, _stored(spark, sf_dir), _flag()))


@register("q2_search_page_stored", LOGS + f", numbered AS ({_PAGE[:-len(' FROM logs')]}, row_number() OVER (ORDER BY ts DESC, {ID_SQL} DESC) AS n FROM logs WHERE {RANK_SQL} >= 4 AND ts <= {MID_SQL}) SELECT random, ts, level, msg, id FROM numbered WHERE n BETWEEN 51 AND 100")
def q2_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, where = _stored(spark, sf_dir), X.level_cmp(">=", "warn")
    last = Q.search_stored(spark, path, where, 50, MID).agg(F.min(F.struct("ts", "id")).alias("x")).select("x.*").first()
    return _page(Q.search_stored(spark, path, where, 50, last["ts"] or MID, int(last["id"] or 0)))


@register("q1_search_stored_props", LOGS + f"{_PAGE} WHERE {prop_sql('k')} IN ('7', '11') AND {RANK_SQL} >= 4 ORDER BY ts DESC, {ID_SQL} DESC LIMIT 40")
def q1_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are chosen by a stored table of the properties they hold."""
    path, index = new_folder(spark, "logs"), new_folder(spark, "properties")
    S.write_logs(logs(spark, sf_dir), path, buckets_per_device=1)
    write_properties(spark, path, index)
    return _page(Q.search_stored(spark, path, X.level_cmp(">=", "warn"), 40, props={"k": ["7", 11]}, index=index))


for _name, _test, _where in (
    ("f14_ts_cmp_stored", lambda: X.any_of(X.ts_cmp(">=", datetime(2024, 1, 29), "day"), X.all_of(X.ts_cmp("<", datetime(2024, 1, 2, 5), "day"), X.msg_like("error"))), "ts >= TIMESTAMP '2024-01-29' OR (ts < TIMESTAMP '2024-01-02 05:00:00' AND contains(msg, 'error'))"),
    ("f18_time_range_stored", lambda: X.time_range(datetime(2024, 1, 10, 7), MID, "day"), f"ts BETWEEN TIMESTAMP '2024-01-10 07:00:00' AND {MID_SQL}"),
):

    @register(_name, LOGS + f"SELECT random, level, msg, device_id FROM logs WHERE {_where}")
    def filtered(spark: SparkSession, sf_dir: str, test: Callable[[], Column] = _test) -> DataFrame:
        """Over stored logs; folders of other days are left out of the scan."""
        return S.read_logs(spark, _stored(spark, sf_dir)).where(test()).select("random", "level", "msg", "device_id")


@register("q4_recent_and_archive", LOGS + f"{_PAGE} WHERE {RANK_SQL} >= 3 ORDER BY ts DESC, {ID_SQL} DESC LIMIT 300")
def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = logs(spark, sf_dir)
    return _page(Q.recent_and_archive(df.where(F.col("ts") > F.lit(MID)), df.where(F.col("ts") <= F.lit(MID)), X.level_cmp(">=", "info"), 300))


@register("q5_search_with_stats", LOGS + f"{_PAGE} WHERE {_FLAG_SQL} ORDER BY ts DESC, {ID_SQL} DESC LIMIT 100")
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(Q.search_with_stats(logs(spark, sf_dir), _flag(), 100)[0])


@register("q5_search_counts", LOGS + f"SELECT count(*) AS examined, count(*) FILTER ({_FLAG_SQL}) AS matched FROM logs")
def q5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search says of itself once it has run, in the same pass."""
    rows, seen = Q.search_with_stats(logs(spark, sf_dir), _flag(), 100)
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["examined"], seen.get["matched"])], "examined long, matched long")


# -- aggregates --------------------------------------------------------------------------------------------------------


@register("a1_histogram", LOGS + f"SELECT CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) % 3600 AS bucket, count(*) AS count FROM logs WHERE {RANK_SQL} >= 3 GROUP BY 1 ORDER BY 1 DESC")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(logs(spark, sf_dir), X.level_cmp(">=", "info"), 3600)


_TOTALS = "SELECT count(*) AS segment_count, CAST(coalesce(sum(original_size), 0) AS BIGINT) AS original_size, CAST(coalesce(sum(compressed_size), 0) AS BIGINT) AS compressed_size, CAST(coalesce(sum(logs_count), 0) AS BIGINT) AS logs_count FROM segments"


@register("a2_segment_totals", SEGMENTS + _TOTALS)
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.segment_totals(segments(spark, sf_dir))


@register("a3_segment_averages", SEGMENTS + f", t AS ({_TOTALS})\nSELECT logs_count / segment_count AS logs_per_segment, compressed_size / segment_count AS bytes_per_segment, 100 * (compressed_size / original_size) AS compression_percent, original_size / logs_count AS bytes_per_log, compressed_size / logs_count AS compressed_bytes_per_log FROM t")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.segment_averages(segments(spark, sf_dir))


@register("a4_device_rollup", LOGS + f"SELECT device_id, count(*) AS logs_count, CAST(sum({BYTES_SQL}) AS BIGINT) AS logs_size, max(ts) AS last_upload_at FROM logs GROUP BY device_id")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.device_rollup(logs(spark, sf_dir)).select("device_id", "logs_count", "logs_size", ntz("last_upload_at"))


@register("a5_segment_summary", SEGMENTS + "SELECT device_id, chunk, first_timestamp, last_timestamp, logs_count, original_size FROM segments")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("device_id", "chunk", ntz("first_timestamp"), ntz("last_timestamp"), "logs_count", "original_size")


@register("a6_segment_props", with_(LOGS_SQL, CHUNKS_SQL, PROPS_SQL) + "SELECT * FROM segment_props")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.segment_props(chunks(spark, sf_dir))


_RATE = "CASE WHEN epoch_us(last_upload_at) > epoch_us(created_at) THEN logs_count / ((epoch_us(last_upload_at) - epoch_us(created_at)) / 1000000) ELSE 0.0 END"


@register("a7_fleet_totals", DEVICES + f"SELECT count(*) AS devices, CAST(sum(logs_count) AS BIGINT) AS logs_count, CAST(sum(logs_size) AS BIGINT) AS logs_size, sum(logs_size) / sum(logs_count) AS average_log_size, round(sum({_RATE}), 9) AS logs_per_second FROM devices")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fleet_totals(devices(spark, sf_dir)).withColumn("logs_per_second", F.round("logs_per_second", 9))


@register("a8_device_rates", DEVICES + f"SELECT id, {_RATE} AS logs_per_second, CASE WHEN logs_count > 0 THEN logs_size / logs_count ELSE 0.0 END AS average_log_size FROM devices")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.device_rates(devices(spark, sf_dir)).select("id", "logs_per_second", "average_log_size")


for _field, _column in A.PIVOTS.items():

    @register(f"a9_count_by_{_field}", LOGS + f'SELECT {_column} AS "{_field}", count(*) AS count FROM logs GROUP BY 1')
    def a9(spark: SparkSession, sf_dir: str, by: str = _field) -> DataFrame:
        out = A.count_by(logs(spark, sf_dir), by)
        return out.select(ntz(by), "count") if by == "timestamp" else out


@register("a10_prop_facets", DEVICES + "SELECT key, array_to_string(list_sort(list(DISTINCT value)), '|') AS values, count(DISTINCT value) AS n_values FROM device_props GROUP BY key")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prop_facets(device_props(spark, sf_dir)).withColumn("values", F.array_join("values", "|"))


@register("a10_prop_facet_rows", DEVICES + "SELECT key, value, count(DISTINCT device_id) AS devices FROM device_props GROUP BY key, value")
def a10_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prop_facet_rows(device_props(spark, sf_dir))


# -- templates and windows ---------------------------------------------------------------------------------------------

#: Messages of events differ only in numbers, so their templates are the event types, in the order in which these appear.
_TEMPLATES = f""", kinds AS (SELECT split_part(msg, ' ', 1) AS kind, min(ts) AS ts FROM logs GROUP BY 1),
ids AS (SELECT kind, CAST(row_number() OVER (ORDER BY ts, kind) AS INT) AS template_id FROM kinds),
parsed AS (SELECT random, logs.ts, device_id, {ID_SQL.replace('(ts)', '(logs.ts)')} AS id, template_id, kind || ' user * k *' AS text FROM logs JOIN ids ON split_part(msg, ' ', 1) = kind)
"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mine_templates(logs(spark, sf_dir), ["ts", "random"])


@register("d1_mine_templates", LOGS + _TEMPLATES + "SELECT random, template_id, text FROM parsed")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("random", "template_id", "text")


@register("d2_assign_templates")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns; those that repeat a conversation's number are in the order of their roles and texts, which `again` numbers."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("msg"), F.coalesce("role", F.lit("")).alias("role"))
    turns = turns.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "msg")))
    return D.assign_templates(turns, ["conv_id", "turn", "again"])


@register("d2_assign_templates_events", LOGS + _TEMPLATES + "SELECT random, template_id, text FROM parsed")
def d2_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.assign_templates(logs(spark, sf_dir), ["ts", "random"]).select("random", "template_id", "text")


@register("s9_write_templates_csv", LOGS + _TEMPLATES + """SELECT CAST(template_id AS VARCHAR) AS "TemplateID", text AS "Text" FROM parsed""")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "templates")
    S.write_templates_csv(parsed(spark, sf_dir), path)
    return spark.read.option("sep", ";").option("header", True).csv(path)


@register("a11_template_counts", LOGS + _TEMPLATES + "SELECT template_id, count(*) AS count FROM parsed GROUP BY template_id")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.template_counts(parsed(spark, sf_dir))


@register("a11_template_total", LOGS + _TEMPLATES + "SELECT count(DISTINCT template_id) AS templates FROM parsed")
def a11_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.template_total(parsed(spark, sf_dir))


@register("w1_cut_segments", CHUNKS + "SELECT random, device_id, chunk FROM chunks")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("random", "device_id", "chunk")


@register("w1_cut_segments_in_blocks", CHUNKS + "SELECT random, device_id, chunk FROM chunks")
def w1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.cut_segments_in_blocks(logs(spark, sf_dir), SIZE).select("random", "device_id", "chunk")


@register("w2_sequence_windows", LOGS + _TEMPLATES + """, w AS (SELECT device_id, row_number() OVER o AS pos, list(template_id) OVER (PARTITION BY device_id ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS a FROM parsed WINDOW o AS (PARTITION BY device_id ORDER BY ts, id))
SELECT device_id, CAST(pos AS INT) AS pos, array_to_string(a[1:10], ' ') AS x, array_to_string(a[11:11], ' ') AS y FROM w WHERE len(a) = 11""")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.mine_templates(logs(spark, sf_dir), ["ts", "random"], carry=("device_id",)).withColumn("id", P.log_id())
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c)
    return W.sequence_windows(lines, block=F.to_date("ts"), block_rows=50).select("device_id", "pos", text("x"), text("y"))


# -- devices -----------------------------------------------------------------------------------------------------------


@register("j1_devices_with_props", DEVICES + "SELECT id, filter_level, coalesce(p.props, '') AS props FROM devices LEFT JOIN (SELECT device_id, array_to_string(list(key || '=' || value ORDER BY key, value), ',') AS props FROM device_props GROUP BY device_id) p ON id = device_id")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.devices_with_props(devices(spark, sf_dir), device_props(spark, sf_dir))
    return out.select("id", "filter_level", F.array_join(F.transform("props", lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",").alias("props"))


@register("j2_filter_devices", DEVICES + f"SELECT {DEVICE_COLUMNS} FROM devices WHERE send_logs AND filter_level IN (2, 3, 4) AND id IN (SELECT device_id FROM device_props WHERE key = 'segment' AND value IN ('BUILDING', 'MACHINERY'))")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_devices(J.filter_devices(devices(spark, sf_dir), device_props(spark, sf_dir), True, ["debug", "info", 4], {"segment": ["BUILDING", "MACHINERY"]}))


_PAIRS = [("segment", "BUILDING"), ("nation", "NATION_10")]
_MATCH = "SELECT device_id FROM device_props WHERE key = 'segment' AND value = 'BUILDING'"


@register("j3_devices_matching_all", DEVICES + f"SELECT {DEVICE_COLUMNS} FROM devices WHERE id IN (SELECT device_id FROM device_props WHERE key = 'segment' AND value = 'BUILDING') AND id IN (SELECT device_id FROM device_props WHERE key = 'nation' AND value = 'NATION_10')")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_devices(J.devices_matching_all(devices(spark, sf_dir), device_props(spark, sf_dir), _PAIRS))


@register("j4_segments_with_prop", with_(LOGS_SQL, CHUNKS_SQL, SEGMENTS_SQL, PROPS_SQL) + f"SELECT s.id, s.device_id, s.chunk FROM segments s WHERE EXISTS (SELECT 1 FROM segment_props p WHERE p.device_id = s.device_id AND p.chunk = s.chunk AND p.key = 'version' AND ({compare_sql('p.value', '=', '1.3.3')} OR {compare_sql('p.value', '=', '1.10')}))")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.segments_with_prop(segments(spark, sf_dir), C.segment_props(chunks(spark, sf_dir)), "version", ["1.3.3", "1.10"]).select("id", "device_id", "chunk")


_BATCH = f"(SELECT device_id, count(*) AS n, CAST(sum({BYTES_SQL}) AS BIGINT) AS s, max(ts) AS up_at FROM logs WHERE ts >= {MID_SQL} GROUP BY device_id)"


@register("j5_upsert_device_stats", DEVICES + f"""SELECT coalesce(d.id, b.device_id) AS id, coalesce(send_logs, false) AS send_logs, coalesce(filter_level, 3) AS filter_level, coalesce(logs_size, 0) + coalesce(s, 0) AS logs_size,
  coalesce(logs_count, 0) + coalesce(n, 0) AS logs_count, coalesce(created_at, {NOW_SQL}) AS created_at, coalesce(up_at, last_upload_at) AS last_upload_at, coalesce(send_interval, 60) AS send_interval
  FROM (SELECT * FROM devices WHERE filter_level <> 2) d FULL JOIN {_BATCH} b ON d.id = b.device_id""")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = A.device_rollup(logs(spark, sf_dir).where(F.col("ts") >= F.lit(MID)))
    return show_devices(J.upsert_device_stats(devices(spark, sf_dir).where("filter_level <> 2"), batch, NOW))


@register("j6_replace_device_props", DEVICES + """SELECT device_id, key, value FROM device_props WHERE device_id NOT IN (SELECT id FROM devices WHERE filter_level = 3)
  UNION SELECT device_id, 'tier', value FROM device_props WHERE key = 'segment' AND device_id IN (SELECT id FROM devices WHERE filter_level = 3) AND value <> 'BUILDING'""")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = device_props(spark, sf_dir)
    ids = devices(spark, sf_dir).where("filter_level = 3").select(F.col("id").alias("device_id"))
    new = props.where("key = 'segment' AND value <> 'BUILDING'").select("device_id", F.lit("tier").alias("key"), "value")
    return J.replace_device_props(props, new, ids)


@register("j7_update_device_settings", DEVICES + f"""SELECT coalesce(d.id, c.id) AS id, coalesce(c.send_logs, d.send_logs) AS send_logs, coalesce(c.filter_level, d.filter_level) AS filter_level, coalesce(logs_size, 0) AS logs_size, coalesce(logs_count, 0) AS logs_count,
  coalesce(created_at, {NOW_SQL}) AS created_at, last_upload_at, coalesce(c.send_interval, d.send_interval) AS send_interval
  FROM devices d FULL JOIN (SELECT CASE WHEN filter_level = 5 THEN 'new-' || id ELSE id END AS id, true AS send_logs, 1 AS filter_level, 15 AS send_interval FROM devices WHERE filter_level IN (4, 5)) c ON d.id = c.id""")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = devices(spark, sf_dir)
    name = F.when(F.col("filter_level") == 5, F.concat(F.lit("new-"), "id")).otherwise(F.col("id"))
    changes = rows.where("filter_level IN (4, 5)").select(name.alias("id"), F.lit(True).alias("send_logs"), F.lit(1).alias("filter_level"), F.lit(15).alias("send_interval"))
    return show_devices(J.update_device_settings(rows, changes, NOW))


@register("j8_apply_settings_where", DEVICES + f"""SELECT id, CASE WHEN id IN ({_MATCH}) THEN true ELSE send_logs END AS send_logs, CASE WHEN id IN ({_MATCH}) THEN 2 ELSE filter_level END AS filter_level, logs_size, logs_count, created_at, last_upload_at,
  CASE WHEN id IN ({_MATCH}) THEN 30 ELSE send_interval END AS send_interval FROM devices""")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_devices(J.apply_settings_where(devices(spark, sf_dir), device_props(spark, sf_dir), _PAIRS[:1], True, 2, 30))


@register("j9_register_devices", DEVICES + f"""SELECT {DEVICE_COLUMNS} FROM devices WHERE filter_level <> 4
  UNION ALL SELECT id, false, 3, 0, 0, {NOW_SQL}, NULL, 500 FROM devices WHERE filter_level = 4""")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_devices(J.register_devices(devices(spark, sf_dir).where("filter_level <> 4"), logs(spark, sf_dir), NOW))


# -- segments ----------------------------------------------------------------------------------------------------------

_SEGMENT = "id, device_id, chunk, first_timestamp, last_timestamp, logs_count"


def _show_segments(df: DataFrame) -> DataFrame:
    return df.select("id", "device_id", "chunk", ntz("first_timestamp"), ntz("last_timestamp"), "logs_count")


@register("c1_segments_overlapping", SEGMENTS + f"SELECT {_SEGMENT} FROM segments WHERE last_timestamp > TIMESTAMP '2024-01-10' AND first_timestamp <= {MID_SQL} ORDER BY first_timestamp DESC, id DESC LIMIT 100")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show_segments(C.segments_overlapping(segments(spark, sf_dir), datetime(2024, 1, 10), MID, sort="desc"))


@register("c2_segment_covers", SEGMENTS + f"SELECT count(*) > 0 AS covered FROM segments WHERE first_timestamp <= {MID_SQL} AND last_timestamp >= {MID_SQL} AND device_id IN ('3', '4')")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.segment_covers(segments(spark, sf_dir), MID, ["3", "4"])


@register("c3_previous_segment_end", SEGMENTS + f"SELECT max(last_timestamp) AS previous_end FROM segments WHERE last_timestamp <= {MID_SQL}")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.previous_segment_end(segments(spark, sf_dir), MID).select(ntz("previous_end"))


@register("c4_retention_split", SEGMENTS + ", dropped AS (SELECT id FROM segments ORDER BY first_timestamp, id LIMIT 20)\nSELECT random, l.device_id, l.chunk FROM chunks l JOIN segments s ON l.device_id = s.device_id AND l.chunk = s.chunk WHERE s.id NOT IN (SELECT id FROM dropped)")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped, _ = C.retention_split(segments(spark, sf_dir), 20)
    return C.retain_logs(chunks(spark, sf_dir), dropped).select("random", "device_id", "chunk")


#: Logs in small chunks by day, to be compacted.
_DAYS = "days AS (SELECT *, CAST(date_part('day', ts) AS INT) AS chunk FROM logs)"


@register("c5_compact", with_(LOGS_SQL, _DAYS) + f""", sizes AS (SELECT device_id, chunk, count(*) AS n FROM days GROUP BY device_id, chunk),
marked AS (SELECT *, n < {SIZE} AND count(*) FILTER (n < {SIZE}) OVER (PARTITION BY device_id) >= 2 AS small, 1 + max(chunk) OVER (PARTITION BY device_id) AS next FROM sizes),
rows AS (SELECT d.*, small, next FROM days d JOIN marked m ON d.device_id = m.device_id AND d.chunk = m.chunk)
SELECT random, device_id, chunk FROM rows WHERE NOT small
UNION ALL SELECT random, device_id, CAST(next + floor((row_number() OVER (PARTITION BY device_id ORDER BY ts, {ID_SQL}) - 1) / {SIZE}) AS INT) FROM rows WHERE small""")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = logs(spark, sf_dir).withColumn("chunk", F.dayofmonth("ts"))
    return C.compact(days, SIZE).select("random", "device_id", "chunk")


def _compacted(spark: SparkSession, sf_dir: str) -> str:
    """A table in many small files, half of which one compaction and all of which another has joined."""
    path, df = new_folder(spark, "logs"), logs(spark, sf_dir)
    S.write_logs(df.where(F.col("ts") < F.lit(MID)), path, rows=45, buckets_per_device=1)
    compact_files(spark, path, 60)
    S.write_logs(df.where(F.col("ts") >= F.lit(MID)), path, rows=45, buckets_per_device=1)
    compact_files(spark, path, 60)
    return path


@register("c5_compact_files", LOGS + SHOW_LOGS)
def c5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_logs(S.read_logs(spark, _compacted(spark, sf_dir)))


_FILES_SQL = f"(SELECT CAST(ts AS DATE) AS day, ts >= {MID_SQL} AS late, count(*) AS n FROM logs GROUP BY 1, 2)"


@register("c5_compacted_file_rows", LOGS + "SELECT CAST(day AS VARCHAR) AS day, CAST(max(files) AS BIGINT) AS files, sum(n)::BIGINT AS rows FROM (SELECT day, n, ceil(sum(n) OVER (PARTITION BY day) / 60) AS files FROM " + _FILES_SQL + ") GROUP BY day")
def c5_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full files, and one more with what is left over, for every day; that of the day in the middle was joined twice."""
    files = file_rows(spark, _compacted(spark, sf_dir))
    return files.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


@register("c6_assign_orphans", LOGS + f"""SELECT random, device_id, CAST(floor((row_number() OVER (PARTITION BY device_id ORDER BY ts, {ID_SQL}) - 1) / {SIZE}) AS INT) AS chunk,
  CASE WHEN {prop_sql('deviceId')} IS NULL THEN 'unknown' ELSE {prop_sql('deviceId')} END AS named FROM logs WHERE random % 3 = 0""")
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).withColumn("device_id", F.when(F.col("random") % 3 != 0, F.col("device_id"))).withColumn("chunk", F.lit(0))
    return C.assign_orphans(rows, SIZE).select("random", "device_id", "chunk", P.prop("deviceId").alias("named"))


# -- streams: the events files, read once as a stream ------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"{sf_dir}/events.parquet"
    shape = spark.read.parquet(table).schema
    events = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/")
    return events.select(F.lit(1).alias("version"), F.col("event_id").alias("random"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "props")


def _as_logs(events: DataFrame) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    k = F.get_json_object("props", "$.k")
    pairs = F.array(F.struct(F.lit("k").alias("key"), k.alias("value")))
    return events.select(
        "version", "random", "ts", F.when(kind == "view", "debug").when(kind == "purchase", "warn").when(kind == "error", "error").otherwise("info").alias("level"), pairs.alias("props"),
        F.concat(kind, F.lit(" user "), user, F.lit(" k "), k).alias("msg"), F.when(F.col("user_id") % 10 != 0, user).otherwise("unknown").alias("device_id"),
    )


def _drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs the stream over what is there: the rows of all batches, or in complete mode of the last one, which holds the whole state."""
    spark, path, last = stream.sparkSession, new_folder(stream.sparkSession, name), []

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        last[:] = [batch_id]

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    of = f"/batch={last[0]}" if mode == "complete" and last else ""
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows{of}")


def _drain_lanes(streams: list[DataFrame], name: str) -> DataFrame:
    """Runs streams of the same columns beside each other over what is there: the rows of all their batches."""
    spark, path, runs = streams[0].sparkSession, new_folder(streams[0].sparkSession, name), []

    def put(lane: int) -> Callable[[DataFrame, int], None]:
        return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/rows/lane={lane}/batch={batch_id}")

    try:
        for i, stream in enumerate(streams):
            runs.append(stream.writeStream.foreachBatch(put(i)).option("checkpointLocation", f"{path}/state/{i}").trigger(availableNow=True).start())
        for run in runs:
            run.awaitTermination()
    finally:
        for run in runs:
            run.stop()
    return spark.read.schema(streams[0].schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")


@register("t1_tail", LOGS + f"SELECT random, ts, level, msg FROM logs WHERE {RANK_SQL} >= 4")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain(T.tail(_as_logs(_stream(spark, sf_dir)), X.level_cmp(">=", "warn")), "append", "tail").select("random", ntz("ts"), "level", "msg")


@register("t2_stream_histogram", LOGS + "SELECT CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) % 3600 AS bucket, count(*) AS count FROM logs GROUP BY 1")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain(T.stream_histogram(_as_logs(_stream(spark, sf_dir)), 3600), "complete", "histogram")


@register("t2_stream_histogram_closed", LOGS + """, counts AS (SELECT CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) % 3600 AS bucket, count(*) AS count FROM logs GROUP BY 1)
SELECT bucket, count FROM counts WHERE (bucket + 3600) * 1000 <= (SELECT floor(epoch_us(max(ts)) / 1000) FROM logs) - 86400000""")
def t2_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: only buckets that end a day or more before the newest log, which the watermark has closed."""
    return _drain(T.stream_histogram(_as_logs(_stream(spark, sf_dir)), 3600, "1 day"), "append", "closed")


@register("t3_stream_device_stats", LOGS + "SELECT device_id, count(*) AS logs_count, CAST(sum(20 + 2 + 1 + length(list_extract(list_transform(list_filter(props, lambda x: x.key = 'k'), lambda x: x.value), 1)) + strlen(msg)) AS BIGINT) AS logs_size, max(ts) AS last_upload_at FROM logs GROUP BY device_id")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain(T.stream_device_stats(_as_logs(_stream(spark, sf_dir))), "complete", "stats").select("device_id", "logs_count", "logs_size", ntz("last_upload_at"))


#: Logs come from five uploaders; those of every eleventh user come in files that name none.
_UPLOADER = "CASE WHEN user_id % 11 <> 0 THEN 'u' || user_id % 5 END"


def _drop_files(spark: SparkSession, logs_: DataFrame, folder: str, again: int) -> None:
    """Finished files of the uploaders, as they would send them. again: numbers the lots."""
    user = F.regexp_extract("msg", "user ([0-9]+)", 1).cast("int")
    owner = F.when(user % 11 != 0, F.concat(F.lit("u"), (user % 5).cast("string")))
    rows = logs_.withColumn("_owner", owner).repartition(8, "_owner", F.col("random") % 3).sortWithinPartitions("_owner")
    named = B.encode_batches(rows.where("_owner is not null"), 700, F.col("_owner"), f"-{again}.ready")
    bare = B.encode_batches(rows.where("_owner is null"), 700, ending=f"_{again}.ready").withColumn("path", F.translate("path", "-", "_"))
    B.write_files(named.unionByName(bare), folder)


@register("s4_stream_spool", LOGS + f"SELECT {_UPLOADER} AS uploader, count(*) AS logs_count, CAST(sum({BYTES_SQL}) AS BIGINT) AS logs_size FROM logs JOIN (SELECT event_id, user_id FROM events) ON random = event_id GROUP BY 1")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a drop folder as a stream, and what each uploader sent."""
    folder = new_folder(spark, "spool")
    _drop_files(spark, logs(spark, sf_dir), folder, 1)
    # names end with a file's number in its task, a mark and the lot's number
    files = _drain_lanes([B.count_contents(T.stream_spool(spark, folder, 5, names)) for names in T.spool_lanes(2)], "spool")
    return files.groupBy("uploader").agg(F.sum("records").alias("logs_count"), F.sum("record_bytes").alias("logs_size"))


@register("t4_ingest_with_flush", LOGS + SHOW_LOGS)
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lots of files, each by a start of its own: of the first, what reaches the limit of rows leaves; the second start goes on with the rest."""
    return _ingested(spark, sf_dir)[0]


@register("t4_ingest_stats", LOGS + f"SELECT {_UPLOADER} AS uploader, count(*) AS logs_count, CAST(sum({BYTES_SQL}) AS BIGINT) AS logs_size FROM logs JOIN (SELECT event_id, user_id FROM events) ON random = event_id WHERE {_UPLOADER} IS NOT NULL GROUP BY 1")
def t4_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ingest says each uploader sent."""
    return _ingested(spark, sf_dir)[1].groupBy("uploader").agg(F.sum("logs_count").alias("logs_count"), F.sum("logs_size").alias("logs_size"))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    root, df = new_folder(spark, "ingest"), logs(spark, sf_dir)
    for lot, (rows, seconds) in enumerate(((1_500, 0.001), (1_000_000, 0))):
        _drop_files(spark, df.where(F.col("random") % 3 == 0) if lot else df.where(F.col("random") % 3 != 0), f"{root}/spool", lot)
        T.ingest_with_flush(spark, f"{root}/spool", f"{root}/logs", f"{root}/state", seconds, rows, stats=f"{root}/stats").awaitTermination()
    stats = "uploader string, reason string, files long, logs_count long, logs_size long, skipped long"
    return show_logs(S.read_logs(spark, f"{root}/logs")), spark.read.schema(stats).option("recursiveFileLookup", True).parquet(f"{root}/stats")


@register("t3_stored_device_stats", DEVICES + f"""SELECT coalesce(d.id, b.device_id) AS id, coalesce(filter_level, 3) AS filter_level, coalesce(d.logs_count, 0) + coalesce(n, 0) AS logs_count, coalesce(up_at, last_upload_at) AS last_upload_at
  FROM (SELECT * FROM devices WHERE filter_level <> 2) d FULL JOIN (SELECT device_id, count(*) AS n, max(ts) AS up_at FROM logs GROUP BY device_id) b ON d.id = b.device_id""")
def t3_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's counts in the stored table of devices, with the last batch put in twice."""
    root = new_folder(spark, "devices")
    create_table(devices(spark, sf_dir).where("filter_level <> 2"), root)
    stream = _as_logs(_stream(spark, sf_dir))
    T.store_device_stats(stream, root, f"{root}/state", NOW).awaitTermination()
    merge_once(spark, root, 0, lambda old: old.where("false"))  # as if the batch were tried again
    return read_table(spark, root).select("id", "filter_level", "logs_count", ntz("last_upload_at"))
