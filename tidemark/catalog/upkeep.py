"""Registered queries for layout, loads, rollup refresh and statistics by period."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.readings import COLS, DAILY_SQL, GLOBAL_SQL, HOURLY_SQL
from tidemark.catalog.tables import AS_OF, DEVICE, ORDERS_SQL, READINGS_SQL, events, orders, plain
from tidemark.operators import attributes as J
from tidemark.operators import quality as Q
from tidemark.operators import rollups as R
from tidemark.operators.filters import between_ts, by_type
from tidemark.plans import maintenance as M
from tidemark.plans.stats import stats
from tidemark.session import shared_folder
from tidemark.sources import layout as Y
from tidemark.sources.csv import append_readings, load_csv
from tidemark.sources.readings import read_layout

CATALOG: dict = {}


def add(name: str, query, sql: str | None, source: str = READINGS_SQL) -> None:
    CATALOG[name] = (query, f"WITH {source.strip()} {sql}" if sql else None)


def _organised(s, d, source=events):
    path = shared_folder(s, "layout")
    Y.write_layout(source(s, d), path)
    return path


def _layout(s, d):
    return plain(read_layout(s, _organised(s, d)))


def _month_range(s, d):
    stored = read_layout(s, _organised(s, d, orders))
    return plain(between_ts(stored, "1997-03-15 00:00:00", "1997-06-02 00:00:00").select("id", "device_id", "ts", "value"))


def _by_month(s, d):
    src, dst = shared_folder(s, "flat"), shared_folder(s, "monthly")
    append_readings(orders(s, d), src)
    return plain(Y.repartition_by_month(s, src, dst).select("id", "device_id", "ts", "value", "month"))


def _expired(s, d):
    path = _organised(s, d, orders)
    Y.drop_expired(s, path, "1999-06-15 00:00:00", 12)
    return plain(s.read.parquet(path).select("id", "device_id", "ts", "value"))


def _csv(s, d):
    path = shared_folder(s, "csv")
    source = events(s, d)
    source.select(
        "device_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "reading_type", "value", "unit"
    ).write.csv(path)
    loaded, _ = load_csv(s, path, start_id=1000)
    return plain(loaded.groupBy("device_id", "reading_type", "unit").agg(
        F.count(F.lit(1)).alias("reading_count"),
        F.sum("value").alias("total"),
        F.min("ts").alias("first_ts"),
        F.count_distinct("id").alias("ids"),
        F.max((F.col("id") < 1000).cast("int")).alias("below_start"),
    ))


def _published(s, d):
    base = shared_folder(s, "rollups")
    df = events(s, d)
    M.refresh(by_type(df, "view"), base, "hourly")
    M.refresh(df, base, "hourly")
    return plain(Y.read_rollup(s, f"{base}/hourly"))


def _refreshed_all(s, d):
    base = shared_folder(s, "rollups")
    M.refresh(events(s, d), base)
    return M.rollup_status({k: Y.read_rollup(s, f"{base}/{k}") for k in M.KEYS} | {"readings": events(s, d)})


def _old(df):
    """The stored rollup before rows since 2024-01-25 arrived."""
    return df.where(F.col("ts") < F.lit("2024-01-25").cast("timestamp"))


def _incremental(kind, days):
    def run(s, d):
        df = events(s, d)
        old = M.build(kind, _old(df))
        refresh = M.refresh_hourly if kind == "hourly" else M.refresh_daily
        return plain(refresh(old, df, AS_OF, days))

    return run


def _by_date(s, d):
    path = shared_folder(s, "rollup-dates")
    df = events(s, d)
    M.write_rollup_by_date(R.hourly_rollup(_old(df)), "hour", path)
    M.refresh_recent_dates(df, path, "hourly", AS_OF, 7)
    return plain(M.read_rollup_by_date(s, path))


def _stale(s, d):
    """A stored hourly rollup that misses the newest rows, against the recomputed one."""
    df = events(s, d)
    return plain(M.rollup_diff(R.hourly_rollup(df), R.hourly_rollup(_old(df)), "hourly"))


def _rollups(s, d):
    df = events(s, d)
    return {"hourly": R.hourly_rollup(df), "daily": R.daily_rollup(df), "global": R.global_rollup(df)}


add("organised_layout", _layout, f"SELECT {COLS}, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month FROM readings")
add("organised_month_range", _month_range,
    """SELECT id, device_id, ts, value FROM readings
    WHERE ts BETWEEN TIMESTAMP '1997-03-15' AND TIMESTAMP '1997-06-02'""", ORDERS_SQL)
add("month_partitions", _by_month,
    "SELECT id, device_id, ts, value, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month FROM readings", ORDERS_SQL)
add("retention_drop", _expired,
    "SELECT id, device_id, ts, value FROM readings WHERE ts >= TIMESTAMP '1998-06-01'", ORDERS_SQL)
add("retention_filter", lambda s, d: plain(
        Y.kept_months(Y.with_month(orders(s, d)), "1999-06-15 00:00:00", 12).select("id", "ts")),
    "SELECT id, ts FROM readings WHERE ts >= TIMESTAMP '1998-06-01'", ORDERS_SQL)
add("csv_load", _csv,
    """SELECT device_id, reading_type, unit, count(*) AS reading_count, CAST(sum(cents) AS BIGINT) / CAST(100 AS DOUBLE) AS total,
    min(date_trunc('second', ts))::TIMESTAMP AS first_ts, count(*) AS ids, 0 AS below_start FROM readings GROUP BY ALL""")
add("published_rollup", _published, f", {HOURLY_SQL} SELECT * FROM hourly")
add("refresh_all_status", _refreshed_all,
    f""", {HOURLY_SQL}, {DAILY_SQL}, {GLOBAL_SQL}
    SELECT 'hourly' AS table_name, count(*) AS row_count FROM hourly UNION ALL
    SELECT 'daily', count(*) FROM daily UNION ALL SELECT 'global', count(*) FROM global UNION ALL
    SELECT 'readings', count(*) FROM readings""")
add("refresh_hourly_incremental", _incremental("hourly", 7), f", {HOURLY_SQL} SELECT * FROM hourly")
add("refresh_daily_incremental", _incremental("daily", 30), f", {DAILY_SQL} SELECT * FROM daily")
add("refresh_recent_dates", _by_date, f", {HOURLY_SQL} SELECT * FROM hourly")
add("refresh_global", lambda s, d: plain(M.refresh_global(orders(s, d))), f", {GLOBAL_SQL} SELECT * FROM global", ORDERS_SQL)
add("rollup_lag", lambda s, d: plain(M.rollup_lag(events(s, d), R.hourly_rollup(_old(events(s, d))))),
    """SELECT max(ts) AS latest_data, date_trunc('hour', max(ts) FILTER (WHERE ts < TIMESTAMP '2024-01-25'))::TIMESTAMP AS latest_bucket,
    CAST(epoch_us(max(ts)) - epoch_us(date_trunc('hour', max(ts) FILTER (WHERE ts < TIMESTAMP '2024-01-25'))) AS DOUBLE) / 1000000 AS lag_seconds
    FROM readings""")
add("rollup_equals_raw", lambda s, d: plain(M.rollup_diff(R.hourly_rollup(events(s, d)), _published_frame(s, d), "hourly")),
    "SELECT device_id, ts AS hour, reading_type, '' AS difference FROM readings WHERE false")
add("rollup_difference", _stale,
    """, a AS (SELECT device_id, date_trunc('hour', ts)::TIMESTAMP AS hour, reading_type, count(*) AS n FROM readings GROUP BY ALL),
    b AS (SELECT device_id, date_trunc('hour', ts)::TIMESTAMP AS hour, reading_type, count(*) AS n FROM readings
          WHERE ts < TIMESTAMP '2024-01-25' GROUP BY ALL)
    SELECT a.*  EXCLUDE (n), CASE WHEN b.n IS NULL THEN 'missing' ELSE 'different' END AS difference
    FROM a LEFT JOIN b USING (device_id, hour, reading_type) WHERE a.n IS DISTINCT FROM b.n""")
add("stats_by_hour", lambda s, d: plain(stats(_rollups(s, d), "hour", DEVICE)),
    f""", {HOURLY_SQL} SELECT hour AS bucket, device_id, reading_type, reading_count, avg_value, min_value, max_value
    FROM hourly WHERE device_id = '{DEVICE}'""")
add("stats_by_day", lambda s, d: plain(stats(_rollups(s, d), "day", None, "view")),
    f""", {DAILY_SQL} SELECT day AS bucket, device_id, reading_type, reading_count, avg_value, min_value, max_value
    FROM daily WHERE reading_type = 'view'""")
add("stats_overall", lambda s, d: plain(stats(_rollups(s, d), "all").drop("bucket", "device_id")),
    f""", {GLOBAL_SQL} SELECT reading_type, total_readings AS reading_count, global_avg AS avg_value,
    global_min AS min_value, global_max AS max_value FROM global""")
add("stats_of_device", lambda s, d: plain(stats(_rollups(s, d), "all", DEVICE).drop("bucket")),
    f""", {DAILY_SQL} SELECT device_id, reading_type, CAST(sum(reading_count) AS BIGINT) AS reading_count,
    CAST((2 * sum(CAST(round(avg_value * 100) AS BIGINT) * reading_count) + sum(reading_count)) // (2 * sum(reading_count)) AS BIGINT) / CAST(100 AS DOUBLE) AS avg_value,
    min(min_value) AS min_value, max(max_value) AS max_value FROM daily WHERE device_id = '{DEVICE}' GROUP BY ALL""")
add("backfill_attributes", lambda s, d: plain(
        J.backfill_metadata(events(s, d).withColumn("metadata", F.when(F.col("reading_type") != "view", F.col("metadata"))), 7)
        .groupBy("reading_type").agg(
            F.count_if(F.get_json_object("metadata", "$.k").isNotNull()).alias("kept"),
            F.count_if(F.get_json_object("metadata", "$.battery_level").cast("int").between(1, 100)).alias("filled"))),
    """SELECT reading_type, count(*) FILTER (WHERE reading_type <> 'view') AS kept,
    count(*) FILTER (WHERE reading_type = 'view') AS filled FROM readings GROUP BY 1""")
add("reconcile_copy", lambda s, d: Q.reconcile(events(s, d), s.read.parquet(_organised(s, d))),
    """SELECT count(*) AS source_rows, count(DISTINCT device_id) AS source_devices, count(*) AS target_rows,
    count(DISTINCT device_id) AS target_devices, true AS matches FROM readings""")


def _published_frame(s, d):
    base = shared_folder(s, "rollups")
    M.refresh(events(s, d), base, "hourly")
    return Y.read_rollup(s, f"{base}/hourly")
