"""Device tables: joins and updates. An update returns the new table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.filters import rank_of

#: Defaults of a device that first appears with an upload, and of one that registers itself.
UPLOAD_DEFAULTS = {"send_logs": False, "filter_level": 3, "send_interval": 60}
REGISTER_DEFAULTS = {"send_logs": False, "filter_level": 3, "send_interval": 500}


def devices_with_props(devices: DataFrame, props: DataFrame) -> DataFrame:
    """Every device with its properties as a list ordered by key (and value); empty if it has none."""
    lists = props.groupBy(F.col("device_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("props"))
    kind = lists.schema["props"].dataType
    return devices.join(lists, "id", "left").withColumn("props", F.coalesce("props", F.array().cast(kind)))


def filter_devices(devices: DataFrame, props: DataFrame, send_logs: bool | None = None, levels: Iterable[str | int] = (), wanted: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Devices with that flag, a filter level in levels (empty: any), and for each wanted key a property among its values."""
    out = devices
    if send_logs is not None:
        out = out.where(F.col("send_logs") == send_logs)
    if levels := [rank_of(x) for x in levels]:
        out = out.where(F.col("filter_level").isin(levels))
    for key, values in (wanted or {}).items():
        hits = props.where((F.col("key") == key) & F.col("value").isin(list(values))).select(F.col("device_id").alias("id"))
        out = out.join(hits, "id", "left_semi")
    return out


def devices_matching_all(devices: DataFrame, props: DataFrame, wanted: Iterable[tuple[str, str]]) -> DataFrame:
    """Devices with all wanted pairs; without a wanted pair, all devices."""
    pairs = list(dict.fromkeys(wanted))
    if not pairs:
        return devices
    is_one = F.lit(False)
    for key, value in pairs:
        is_one = is_one | ((F.col("key") == key) & (F.col("value") == value))
    hits = props.where(is_one).groupBy(F.col("device_id").alias("id")).agg(F.count_distinct("key", "value").alias("n")).where(F.col("n") == len(pairs))
    return devices.join(hits, "id", "left_semi")


def upsert_device_stats(devices: DataFrame, batch: DataFrame, now: datetime) -> DataFrame:
    """Adds a batch's counts and bytes and sets the last upload; unseen devices get defaults. batch: device_id, logs_count,
    logs_size, last_upload_at, one row per device."""
    new = batch.select(F.col("device_id").alias("id"), F.col("logs_count").alias("_n"), F.col("logs_size").alias("_s"), F.col("last_upload_at").alias("_at"))
    d = UPLOAD_DEFAULTS
    return devices.join(new, "id", "full").select(
        "id", F.coalesce("send_logs", F.lit(d["send_logs"])).alias("send_logs"), F.coalesce("filter_level", F.lit(d["filter_level"])).alias("filter_level"),
        (F.coalesce("logs_size", F.lit(0)) + F.coalesce("_s", F.lit(0))).cast("long").alias("logs_size"),
        (F.coalesce("logs_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("logs_count"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"), F.coalesce("_at", "last_upload_at").alias("last_upload_at"),
        F.coalesce("send_interval", F.lit(d["send_interval"])).alias("send_interval"),
    )


def replace_device_props(props: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """props with the sets of the devices in ids (device_id) replaced by those in new; a device without rows in new ends
    without any."""
    stay = props.join(ids, "device_id", "left_anti")
    return stay.unionByName(new.join(ids, "device_id", "left_semi")).distinct()


def update_device_settings(devices: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """Overwrites send_logs, filter_level and send_interval for the ids in changes; unseen ids are inserted."""
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in ("send_logs", "filter_level", "send_interval")])
    pick = lambda c: F.coalesce(f"_{c}", c).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return devices.join(new, "id", "full").select(
        "id", pick("send_logs"), pick("filter_level"), zero("logs_size"), zero("logs_count"), F.coalesce("created_at", F.lit(now)).alias("created_at"), "last_upload_at", pick("send_interval"),
    )


def apply_settings_where(devices: DataFrame, props: DataFrame, wanted: Iterable[tuple[str, str]], send_logs: bool, filter_level: int, send_interval: int) -> DataFrame:
    """Settings for all devices that have every wanted pair; without a pair, for all."""
    hit = devices_matching_all(devices, props, wanted).select("id", F.lit(True).alias("_hit"))
    rows = devices.join(hit, "id", "left")
    put = lambda c, v: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c))
    return rows.withColumn("send_logs", put("send_logs", send_logs)).withColumn("filter_level", put("filter_level", filter_level)).withColumn("send_interval", put("send_interval", send_interval)).drop("_hit")


def register_devices(devices: DataFrame, logs: DataFrame, now: datetime) -> DataFrame:
    """devices with a row of defaults for each device id of logs that isn't there yet."""
    d = REGISTER_DEFAULTS
    unseen = logs.select(F.col("device_id").alias("id")).distinct().join(devices, "id", "left_anti")
    rows = unseen.select(
        "id", F.lit(d["send_logs"]).alias("send_logs"), F.lit(d["filter_level"]).alias("filter_level"), F.lit(0).cast("long").alias("logs_size"), F.lit(0).cast("long").alias("logs_count"),
        F.lit(now).alias("created_at"), F.lit(None).cast("timestamp").alias("last_upload_at"), F.lit(d["send_interval"]).alias("send_interval"),
    )
    return devices.unionByName(rows)
