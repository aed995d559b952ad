"""Registered queries over stored partials and snapshot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.readings import COLS, DAILY_SQL, GLOBAL_SQL, HOURLY_SQL
from tidemark.catalog.request_tables import CATALOG as LOOKUPS
from tidemark.catalog.tables import (
    AS_OF,
    LINEITEM_SQL,
    READINGS_SQL,
    events,
    lineitems,
    plain,
    requests_at,
)
from tidemark.operators import rollups as R
from tidemark.operators.requests import lookup_ids
from tidemark.plans import maintenance as M
from tidemark.plans.partials import SKETCH, PartialStore, estimated_devices
from tidemark.session import shared_folder
from tidemark.sources import footers as Q
from tidemark.sources import layout as Y
from tidemark.sources.buckets import write_buckets
from tidemark.sources.csv import load_csv
from tidemark.sources.snapshots import Snapshots
from tidemark.spec import READING_COLUMNS

CATALOG: dict = {}

#: When stored readings end and later ones arrive; a day and an hour are cut in two.
ARRIVALS = ("2024-01-12 07:31:00", "2024-01-25 00:00:00")
PERIODS = (("2024-01-01", "2024-01-01"), ("2024-01-05", "2024-01-11"), (None, None))


def add(name: str, query, sql: str | None, source: str = READINGS_SQL) -> None:
    CATALOG[name] = (query, f"WITH {source.strip()} {sql}" if sql else None)


def _lots(df):
    """The readings as they arrive: up to the first moment, between the two, and after."""
    first, second = [F.lit(t).cast("timestamp") for t in ARRIVALS]
    ts = F.col("ts")
    return [df.where(ts < first), df.where((ts >= first) & (ts < second)), df.where(ts >= second)]


def store_of(s, d, *tables, source=events) -> PartialStore:
    df = source(s, d)
    kind = df.schema["value"].dataType
    store = PartialStore(s, shared_folder(s, "partials"), kind.precision, kind.scale)
    for lot in _lots(df):
        store.merge(lot, tables)
    return store


def _periods(s, d):
    store, out = store_of(s, d, "devices"), None
    for first, last in PERIODS:
        days = store.days.read(day=(first, last)) if first else store.days.read()
        exact = store.distinct_devices(first, last) if first else store.distinct_devices()
        row = exact.join(F.broadcast(estimated_devices(days)), F.lit(True)).select(
            F.lit(first or "all").alias("first_day"), "active_devices", "estimated_devices"
        )
        out = row if out is None else out.unionByName(row)
    return out


def _near(s, d):
    """Whether each estimate is within four standard errors of the exact count, or within three devices."""
    off = F.abs(F.col("estimated_devices") - F.col("active_devices"))
    error = 4 * 1.04 / 2 ** (SKETCH / 2)
    near = off <= F.greatest(F.lit(3.0), F.col("active_devices") * error)
    return _periods(s, d).select("first_day", near.alias("near"))


def _clustered(s, d) -> Snapshots:
    """Readings loaded once, appended twice, and compacted."""
    table = Snapshots(s, shared_folder(s, "clustered"), "month", ["device_id", "ts", "id"],
                      curve=["device_id", "ts", "id"])
    for lot in _lots(events(s, d)):
        table.append(Y.with_month(lot.select(*READING_COLUMNS)))
    table.compact()
    return table


def _all_clustered(s, d):
    return plain(_clustered(s, d).read())


def _some_by_id(s, d):
    """Every 500th reading, looked up by id in the files whose ranges hold it."""
    table = _clustered(s, d)
    wanted = events(s, d).where("id % 500 = 0").select("id")
    held = table.holding(wanted, "id").join(F.broadcast(wanted), "id", "left_semi")
    return plain(held.select("id", "device_id", "ts", "value"))


def _device_time(s, d):
    first, last = [F.lit(f"2024-01-{k} 00:00:00").cast("timestamp") for k in (10, 20)]
    found = _clustered(s, d).read(device_id=("sensor-000010", "sensor-000019"), ts=(first, last))
    return plain(found.select("id", "device_id", "ts", "value"))


def _csv_appended(s, d):
    """Two CSV deliveries, each appended to the months of the organised table."""
    table = Snapshots(s, shared_folder(s, "loaded"), "month", ["device_id", "ts", "id"])
    start = 1000
    for k, lot in enumerate(_lots(events(s, d))[1:]):
        path = shared_folder(s, f"delivery-{k}")
        lot.select(
            "device_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "reading_type", "value", "unit"
        ).write.csv(path)
        loaded, _ = load_csv(s, path, start_id=start)
        table.append(Y.with_month(loaded))
        start = table.read().agg(F.max("id")).first()[0] + 1
    return plain(table.read().groupBy("device_id", "reading_type").agg(
        F.count(F.lit(1)).alias("reading_count"),
        F.count_distinct("id").alias("ids"),
        F.min("ts").alias("first_ts"),
        F.count_distinct("month").alias("months"),
    ))


def _pinned(s, d):
    """An hourly rollup pinned before a refresh by date, beside the one after it."""
    df = events(s, d)
    table = Snapshots(s, shared_folder(s, "rollup"), "bucket_date", ["device_id", "hour"])
    old = df.where(F.col("ts") < F.lit(ARRIVALS[1]).cast("timestamp"))
    before = M.refresh_snapshot(table, R.hourly_rollup(old), "hour")
    pinned = table.read(before)
    M.refresh_recent_snapshot(table, df, "hourly", AS_OF, 7)
    keep = [c for c in pinned.columns if c != "bucket_date"]
    both = pinned.select(F.lit("pinned").alias("reader"), *keep).unionByName(
        table.read().select(F.lit("new").alias("reader"), *keep)
    )
    return plain(both)


def _bucketed_lookup(s, d):
    buckets = max(8, int(s.conf.get("spark.sql.shuffle.partitions")))
    held = write_buckets(events(s, d), shared_folder(s, "by-id"), buckets)
    return plain(lookup_ids(requests_at(s, d), held))


def _sizes(s, d):
    names = ("events", "lineitem", "orders")
    sizes = Q.source_sizes(s, {n: f"{d}/{n}.parquet" for n in names})
    return sizes.select("table_name", "estimated_rows", (F.col("bytes") > 0).alias("has_bytes"))


def _extremes(s, d):
    summary = Q.manifest_summary(_clustered(s, d), ["ts", "id"])
    span = F.unix_micros("greatest_ts") - F.unix_micros("least_ts")
    return plain(summary.withColumn("span_us", span))


def _lag(s, d):
    df = events(s, d)
    table = Snapshots(s, shared_folder(s, "rollup"), "bucket_date", ["device_id", "hour"])
    M.refresh_snapshot(table, R.hourly_rollup(df.where(F.col("ts") < F.lit(ARRIVALS[1]).cast("timestamp"))), "hour")
    return plain(Q.manifest_lag(_clustered(s, d), table))


OLD_HOURLY = HOURLY_SQL.replace("hourly AS", "old_hourly AS", 1).replace(
    "FROM readings", f"FROM readings WHERE ts < TIMESTAMP '{ARRIVALS[1]}'"
)
WITHIN = " UNION ALL ".join(
    f"SELECT '{a or 'all'}' AS first_day, {{}} FROM readings"
    + (f" WHERE CAST(ts AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'" if a else "")
    for a, b in PERIODS
)

add("footer_summary", lambda s, d: Q.footer_summary(s, f"{d}/events.parquet", "event_id"),
    "SELECT count(*) AS row_count, min(event_id) AS least, max(event_id) AS greatest FROM events")
add("source_sizes", _sizes,
    """SELECT 'events' AS table_name, count(*) AS estimated_rows, true AS has_bytes FROM events UNION ALL
    SELECT 'lineitem', count(*), true FROM lineitem UNION ALL SELECT 'orders', count(*), true FROM orders""")
add("manifest_extremes", _extremes,
    """SELECT count(*) AS row_count, min(ts) AS least_ts, max(ts) AS greatest_ts, min(id) AS least_id,
    max(id) AS greatest_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us FROM readings""")
add("manifest_lag", _lag,
    f"""SELECT max(ts) AS latest_data, date_trunc('hour', max(ts) FILTER (WHERE ts < TIMESTAMP '{ARRIVALS[1]}'))::TIMESTAMP AS latest_bucket,
    CAST(epoch_us(max(ts)) - epoch_us(date_trunc('hour', max(ts) FILTER (WHERE ts < TIMESTAMP '{ARRIVALS[1]}'))) AS DOUBLE) / 1000000 AS lag_seconds
    FROM readings""")
CATALOG["bucketed_lookup"] = (_bucketed_lookup, LOOKUPS["lookup_by_id"][1])
add("merged_hourly", lambda s, d: plain(store_of(s, d, "hours").hourly()), f", {HOURLY_SQL} SELECT * FROM hourly")
add("merged_daily", lambda s, d: plain(store_of(s, d, "values").daily()), f", {DAILY_SQL} SELECT * FROM daily")
add("merged_global", lambda s, d: plain(store_of(s, d, "hours", "devices").overall()), f", {GLOBAL_SQL} SELECT * FROM global")
add("merged_daily_lineitem", lambda s, d: plain(store_of(s, d, "values", source=lineitems).daily()),
    f", {DAILY_SQL} SELECT * FROM daily", LINEITEM_SQL)
add("period_devices", lambda s, d: _periods(s, d).drop("estimated_devices"),
    WITHIN.replace("{}", "count(DISTINCT device_id) AS active_devices"))
add("period_devices_estimated", _near, WITHIN.replace("{}", "count(*) > 0 AS near"))
add("clustered_appends", _all_clustered,
    f"SELECT {COLS}, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month FROM readings")
add("clustered_lookup", _some_by_id, "SELECT id, device_id, ts, value FROM readings WHERE id % 500 = 0")
add("clustered_device_time", _device_time,
    """SELECT id, device_id, ts, value FROM readings WHERE device_id BETWEEN 'sensor-000010' AND 'sensor-000019'
    AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""")
add("csv_append", _csv_appended,
    f"""SELECT device_id, reading_type, count(*) AS reading_count, count(*) AS ids,
    min(date_trunc('second', ts))::TIMESTAMP AS first_ts, count(DISTINCT date_trunc('month', ts)) AS months
    FROM readings WHERE ts >= TIMESTAMP '{ARRIVALS[0]}' GROUP BY ALL""")
add("pinned_readers", _pinned,
    f""", {HOURLY_SQL}, {OLD_HOURLY} SELECT 'pinned' AS reader, * FROM old_hourly
    UNION ALL SELECT 'new', * FROM hourly""")
