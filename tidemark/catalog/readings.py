"""Registered queries over readings: lookups, filters, aggregates, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.tables import (
    AS_OF,
    DEVICE,
    EVENT_TYPES,
    LINEITEM_SQL,
    ORDERS_SQL,
    READINGS_SQL,
    events,
    lineitems,
    orders,
    plain,
)
from tidemark.functions.joins import beside
from tidemark.functions.percentiles import large_groups
from tidemark.operators import aggregates as A
from tidemark.operators import attributes as J
from tidemark.operators import filters as P
from tidemark.operators import latest as L
from tidemark.operators import quality as Q
from tidemark.operators import rollups as R

CATALOG: dict = {}

AVG = "CAST((2 * sum(cents) + count(*)) // (2 * count(*)) AS BIGINT) / CAST(100 AS DOUBLE)"
DEV = """CASE WHEN count(*) > 1 THEN
  floor(sqrt(CAST(count(*) * sum(CAST(cents AS HUGEINT) * cents) - sum(CAST(cents AS HUGEINT)) * sum(CAST(cents AS HUGEINT)) AS DOUBLE)
    / (CAST(count(*) AS DOUBLE) * (count(*) - 1))) + 0.5) / CAST(100 AS DOUBLE) END"""
STATS = f"""count(*) AS reading_count, {AVG} AS avg_value, min(value) AS min_value,
  max(value) AS max_value, {DEV} AS stddev_value"""
SPAN = "min(ts) AS first_reading, max(ts) AS last_reading"


def pct(p: int, a: str = "vals") -> str:
    """Interpolated percentile of a sorted list of cents, in units of value."""
    i = f"((len({a}) - 1) * {p}) // 100"
    f = f"(((len({a}) - 1) * {p}) % 100)"
    low, high = f"{a}[{i} + 1]", f"{a}[least({i} + 2, len({a}))]"
    return (
        f"((2 * ({low} * (100 - {f}) + {high} * {f}) + 100) // 200) / CAST(100 AS DOUBLE)"
    )


HOURLY_SQL = f"""
hourly AS (
  SELECT device_id, date_trunc('hour', ts)::TIMESTAMP AS hour, reading_type, {STATS}, {SPAN}
  FROM readings GROUP BY ALL)"""

DAILY_SQL = f"""
grouped AS (
  SELECT device_id, date_trunc('day', ts)::TIMESTAMP AS day, reading_type, {STATS}, {SPAN},
         list_sort(list(cents)) AS vals
  FROM readings GROUP BY ALL),
daily AS (
  SELECT * EXCLUDE (vals), {pct(50)} AS median_value, {pct(95)} AS p95_value,
         {pct(99)} AS p99_value FROM grouped)"""

GLOBAL_SQL = f"""
global AS (
  SELECT reading_type, count(*) AS total_readings, count(DISTINCT device_id) AS active_devices,
         {AVG} AS global_avg, min(value) AS global_min, max(value) AS global_max,
         {DEV} AS global_stddev, {SPAN}
  FROM readings GROUP BY reading_type)"""


def add(name: str, query, sql: str | None, source: str = READINGS_SQL) -> None:
    CATALOG[name] = (query, f"WITH {source.strip()} {sql}" if sql else None)


COLS = "id, device_id, ts, reading_type, value, unit, metadata"

# Scan, filters, projection
add("typed_scan", lambda s, d: plain(events(s, d)), f"SELECT {COLS} FROM readings")
add("typed_scan_orders", lambda s, d: plain(orders(s, d)),
    "SELECT id, device_id, ts, reading_type, value, 'USD' AS unit, '{}' AS metadata FROM readings", ORDERS_SQL)
add("by_device", lambda s, d: plain(P.by_device(events(s, d), DEVICE)),
    f"SELECT {COLS} FROM readings WHERE device_id = '{DEVICE}'")
add("by_device_all", lambda s, d: plain(A.row_count(P.by_device(events(s, d), ""))),
    "SELECT count(*) AS row_count FROM readings")
add("by_type", lambda s, d: plain(P.by_type(events(s, d), "purchase")),
    f"SELECT {COLS} FROM readings WHERE reading_type = 'purchase'")
add("between_times", lambda s, d: plain(P.between_ts(orders(s, d), "1997-03-01", "1997-06-30").drop("unit", "metadata")),
    "SELECT id, device_id, ts, reading_type, value FROM readings WHERE ts BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-06-30'", ORDERS_SQL)
add("record_projection", lambda s, d: plain(P.project_record(events(s, d))),
    "SELECT CAST(id AS VARCHAR) AS id, device_id, ts, reading_type, value, unit, metadata FROM readings")
for n, unit in ((1, "hour"), (24, "hour"), (7, "day")):
    add(f"last_{n}_{unit}", lambda s, d, n=n, unit=unit: plain(P.last_interval(events(s, d), AS_OF, n, unit)),
        f"SELECT {COLS} FROM readings WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {n} {unit}")

# Latest readings
add("latest_of_device", lambda s, d: plain(L.latest(events(s, d), DEVICE, 10)),
    f"SELECT {COLS} FROM readings WHERE device_id = '{DEVICE}' ORDER BY ts DESC, id DESC LIMIT 10")
add("latest_of_device_typed", lambda s, d: plain(
        L.latest(events(s, d), DEVICE, 500, "view", "2024-01-05 00:00:00", "2024-01-25 00:00:00")),
    f"""SELECT {COLS} FROM readings WHERE device_id = '{DEVICE}' AND reading_type = 'view'
    AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY ts DESC, id DESC LIMIT 500""")
add("latest_all_devices", lambda s, d: plain(L.latest(orders(s, d), "", 500).drop("unit", "metadata")),
    "SELECT id, device_id, ts, reading_type, value FROM readings ORDER BY ts DESC, id DESC LIMIT 500", ORDERS_SQL)
add("latest_per_device", lambda s, d: plain(L.latest_per_entity(events(s, d), 3)),
    f"""SELECT {COLS}, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER
    (PARTITION BY device_id ORDER BY ts DESC, id DESC) AS rn FROM readings) WHERE rn <= 3""")
add("latest_per_customer", lambda s, d: plain(L.latest_per_entity(orders(s, d), 1).drop("unit", "metadata")),
    """SELECT id, device_id, ts, reading_type, value, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER
    (PARTITION BY device_id ORDER BY ts DESC, id DESC) AS rn FROM readings) WHERE rn <= 1""", ORDERS_SQL)
add("latest_per_supplier", lambda s, d: plain(
        L.latest_per_entity(lineitems(s, d), 5).select(
            F.col("id.k0").alias("l_orderkey"), F.col("id.k1").alias("l_linenumber"),
            F.col("id.k2").alias("l_partkey"), "device_id", "ts", "reading_type", "value", "rn")),
    """SELECT l_orderkey, l_linenumber, l_partkey, device_id, ts, reading_type, value,
    CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY device_id
    ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn FROM readings)
    WHERE rn <= 5""", LINEITEM_SQL)
add("page_before_time", lambda s, d: plain(L.page_before(events(s, d), DEVICE, "2024-01-20 00:00:00", None, 20)),
    f"""SELECT {COLS} FROM readings WHERE device_id = '{DEVICE}' AND ts < TIMESTAMP '2024-01-20'
    ORDER BY ts DESC, id DESC LIMIT 20""")
add("page_before_cursor", lambda s, d: plain(
        L.page_before(orders(s, d), "customer-000000007", "1998-06-01 00:00:00", 9000, 10).drop("unit", "metadata")),
    """SELECT id, device_id, ts, reading_type, value FROM readings
    WHERE device_id = 'customer-000000007' AND (ts, id) < (TIMESTAMP '1998-06-01', 9000)
    ORDER BY ts DESC, id DESC LIMIT 10""", ORDERS_SQL)

# JSON attributes
add("attribute_equals", lambda s, d: plain(J.json_eq(events(s, d), "k", "69")),
    f"SELECT {COLS} FROM readings WHERE json_extract_string(metadata, '$.k') = '69'")
add("attribute_nested_equals", lambda s, d: plain(
        J.json_eq(events(s, d).withColumn("metadata", F.concat(F.lit('{"location":'), F.col("metadata"), F.lit("}"))),
                  "location.k", "42").drop("metadata")),
    """SELECT id, device_id, ts, reading_type, value, unit FROM readings
    WHERE json_extract_string('{"location":' || metadata || '}', '$.location.k') = '42'""")
add("attribute_below", lambda s, d: plain(J.json_num_lt(events(s, d), "k", 20)),
    f"SELECT {COLS} FROM readings WHERE CAST(json_extract_string(metadata, '$.k') AS INTEGER) < 20")
add("attribute_exists", lambda s, d: plain(
        beside(
            J.json_has(events(s, d), "k").agg(F.count("*").alias("with_k")),
            J.json_has(events(s, d), "missing").agg(F.count("*").alias("with_missing")))),
    """SELECT count(*) FILTER (WHERE json_exists(metadata, '$.k')) AS with_k,
    count(*) FILTER (WHERE json_exists(metadata, '$.missing')) AS with_missing FROM readings""")
add("attribute_exists_when_null", lambda s, d: plain(
        J.json_has(events(s, d).withColumn("metadata", F.when(F.col("reading_type") == "view", '{"k":null}').otherwise("{}")), "k")
        .select("id")),
    "SELECT id FROM readings WHERE reading_type = 'view'")
add("low_attribute_counts", lambda s, d: plain(J.low_attr_counts(events(s, d), "k", 20)),
    """SELECT device_id, count(*) AS reading_count FROM readings
    WHERE CAST(json_extract_string(metadata, '$.k') AS INTEGER) < 20 GROUP BY device_id""")
add("default_attributes", lambda s, d: plain(J.add_metadata(orders(s, d).drop("metadata").select("id")).union(
        J.add_metadata(events(s, d).select("id", F.when(F.col("reading_type") == "view", F.col("metadata")).alias("metadata"))))),
    """SELECT o_orderkey + 1 AS id, '{}' AS metadata FROM orders UNION ALL
    SELECT id, CASE WHEN reading_type = 'view' THEN metadata ELSE '{}' END FROM readings""")
add("merge_attributes", lambda s, d: plain(J.merge_metadata(events(s, d), DEVICE, '{"k": 1, "firmware": "2.1.0"}')
        .select("id", F.get_json_object("metadata", "$.k").alias("k"),
                F.get_json_object("metadata", "$.firmware").alias("firmware"))),
    f"""SELECT id, CASE WHEN device_id = '{DEVICE}' THEN '1' ELSE json_extract_string(metadata, '$.k') END AS k,
    CASE WHEN device_id = '{DEVICE}' THEN '2.1.0' END AS firmware FROM readings""")
add("widen_value", lambda s, d: plain(J.widen_value(events(s, d))[0].select("id", "value")),
    "SELECT id, value FROM readings")
add("widen_value_changes", lambda s, d: J.widen_value(orders(s, d))[1],
    "SELECT count(*) FILTER (WHERE CAST(value AS DECIMAL(15,6)) <> CAST(value AS DECIMAL(15,2))) AS changed FROM readings", ORDERS_SQL)

# Quality and reconciliation
add("constraint_good", lambda s, d: plain(Q.check_readings(events(s, d), ("click", "purchase", "view"))[0]),
    f"SELECT {COLS} FROM readings WHERE reading_type IN ('click', 'purchase', 'view')")
add("constraint_quarantine", lambda s, d: plain(
        Q.check_readings(events(s, d), ("click", "purchase", "view"))[1]
        .select("id", F.array_join("violations", ",").alias("violations"))),
    "SELECT id, 'type_unknown' AS violations FROM readings WHERE reading_type NOT IN ('click', 'purchase', 'view')")
add("constraint_value_range", lambda s, d: plain(
        Q.flag_readings(orders(s, d).withColumn("value", (F.col("value") * 1000).cast("decimal(18,2)")), ("F", "O"))
        .select("id", F.array_join("violations", ",").alias("violations"))),
    """SELECT id, concat_ws(',', CASE WHEN reading_type NOT IN ('F', 'O') THEN 'type_unknown' END,
    CASE WHEN cents * 1000 >= 10000000000 THEN 'value_range' END) AS violations FROM readings""", ORDERS_SQL)
add("quality_summary", lambda s, d: plain(Q.quality_summary(events(s, d))),
    """SELECT count(*) AS total_rows, count(*) FILTER (WHERE value IS NULL OR reading_type IS NULL) AS null_values,
    min(value) AS min_value, max(value) AS max_value,
    sum(value::DECIMAL(28, 6))::DOUBLE AS sum_value,
    sum(value::DECIMAL(28, 6))::DOUBLE / count(value) AS avg_value,
    count(*) FILTER (WHERE value <> round(value, 6)) AS changed_by_rounding FROM readings""")
add("reconcile", lambda s, d: Q.reconcile(events(s, d), P.by_type(events(s, d), "view")),
    """SELECT count(*) AS source_rows, count(DISTINCT device_id) AS source_devices,
    count(*) FILTER (WHERE reading_type = 'view') AS target_rows,
    count(DISTINCT device_id) FILTER (WHERE reading_type = 'view') AS target_devices,
    count(*) = count(*) FILTER (WHERE reading_type = 'view') AND count(DISTINCT device_id)
      = count(DISTINCT device_id) FILTER (WHERE reading_type = 'view') AS matches FROM readings""")

# Aggregates
add("row_count", lambda s, d: A.row_count(events(s, d)), "SELECT count(*) AS row_count FROM readings")
add("device_count", lambda s, d: A.device_count(events(s, d)),
    "SELECT count(DISTINCT device_id) AS device_count FROM readings")
def _estimates(readings):
    """The exact device count, and whether the approximate and the sampled one keep their promise."""
    close = F.col("device_count") * 0.06 + 1  # three standard errors of the default
    sampled = A.device_count_sampled(readings, 0.5).withColumnRenamed("device_count", "sampled")
    approx = A.device_count_approx(readings).withColumnRenamed("device_count", "approx")
    return beside(beside(A.device_count(readings), approx), sampled).select(
        "device_count",
        (F.abs(F.col("approx") - F.col("device_count")) <= close).alias("approx_close"),
        (F.col("sampled") <= F.col("device_count")).alias("sample_below"),
    )


add("device_count_sampled", lambda s, d: A.device_count_sampled(events(s, d), 0.5), None)
add("device_count_approx", lambda s, d: A.device_count_approx(events(s, d)), None)
add("device_count_estimates", lambda s, d: _estimates(events(s, d)),
    """SELECT count(DISTINCT device_id) AS device_count, TRUE AS approx_close, TRUE AS sample_below FROM readings""")
add("max_id", lambda s, d: A.max_id(events(s, d)), "SELECT max(id) AS max_id FROM readings")
add("time_span", lambda s, d: plain(A.time_span(events(s, d)).withColumn(
        "span_us", F.unix_micros("latest") - F.unix_micros("earliest")).drop("time_span")),
    "SELECT min(ts) AS earliest, max(ts) AS latest, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us FROM readings")
add("top_devices", lambda s, d: A.top_devices(events(s, d), 20),
    "SELECT device_id, count(*) AS reading_count FROM readings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
add("hot_device_rows", lambda s, d: plain(A.hot_device_rows(events(s, d), 100)),
    f"""SELECT {COLS} FROM readings WHERE device_id IN (SELECT device_id FROM readings GROUP BY 1
    ORDER BY count(*) DESC, device_id LIMIT 100)""")
add("reads_per_device", lambda s, d: plain(A.reads_per_device_dist(events(s, d))),
    """, c AS (SELECT device_id, count(*) AS n FROM readings GROUP BY 1), v AS (SELECT list_sort(list(n)) AS a FROM c)
    SELECT %s, (SELECT max(n) FROM c) AS max_reads, (SELECT min(n) FROM c) AS min_reads,
    (SELECT CAST(sum(n) AS DOUBLE) / count(*) FROM c) AS avg_reads FROM v""" % ", ".join(
        f"(a[((len(a)-1)*{p})//100+1]*(100-((len(a)-1)*{p})%100) + a[least(((len(a)-1)*{p})//100+2, len(a))]"
        f"*(((len(a)-1)*{p})%100)) / CAST(100 AS DOUBLE) AS p{p}_reads" for p in (50, 95, 99)))
add("count_by_state", lambda s, d: A.count_by_state(events(s, d), "reading_type", list(EVENT_TYPES)),
    "SELECT count(*) AS total, %s FROM readings" % ", ".join(
        f"count(*) FILTER (WHERE reading_type = '{t}') AS \"{t}\"" for t in EVENT_TYPES))
add("device_hourly_avg", lambda s, d: plain(A.device_hourly_avg(events(s, d), DEVICE, AS_OF, 24)),
    f"""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, {AVG} AS avg_value FROM readings
    WHERE device_id = '{DEVICE}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY 1""")
add("daily_avg_recent", lambda s, d: plain(A.daily_avg_recent(events(s, d), AS_OF, 7)),
    f"""SELECT date_trunc('day', ts)::TIMESTAMP AS day, device_id, reading_type, {AVG} AS avg_value,
    count(*) AS reading_count FROM readings
    WHERE date_trunc('day', ts) >= DATE '2024-01-30' - INTERVAL 7 DAY GROUP BY ALL""")
add("concentration", lambda s, d: plain(A.concentration(events(s, d))),
    """, c AS (SELECT device_id, count(*) AS n FROM readings GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, device_id) AS rk, count(*) OVER () AS dn FROM c)
    SELECT p AS percent, count(*) AS devices, CAST(sum(n) AS BIGINT) AS reading_count,
    CAST(sum(n) AS DOUBLE) / (SELECT sum(n) FROM c) AS share
    FROM r, (SELECT unnest([1, 5, 20])::INTEGER AS p) WHERE rk <= (dn * p + 99) // 100 GROUP BY p""")

# Rollups
add("hourly_rollup", lambda s, d: plain(R.hourly_rollup(events(s, d))), f", {HOURLY_SQL} SELECT * FROM hourly")
add("daily_rollup", lambda s, d: plain(R.daily_rollup(events(s, d))), f", {DAILY_SQL} SELECT * FROM daily")
add("daily_rollup_measured", lambda s, d: plain(R.daily_rollup(events(s, d), R.large_daily_groups(events(s, d)))),
    f", {DAILY_SQL} SELECT * FROM daily")
add("daily_rollup_mixed_groups", lambda s, d: plain(R.daily_rollup(events(s, d), large_groups(R.daily_keys(events(s, d)), R.DAILY_KEY, 2))),
    f", {DAILY_SQL} SELECT * FROM daily")
add("global_rollup", lambda s, d: plain(R.global_rollup(events(s, d))), f", {GLOBAL_SQL} SELECT * FROM global")
add("daily_rollup_orders", lambda s, d: plain(R.daily_rollup(orders(s, d))), f", {DAILY_SQL} SELECT * FROM daily", ORDERS_SQL)
add("global_rollup_lineitem", lambda s, d: plain(R.global_rollup(lineitems(s, d))), f", {GLOBAL_SQL} SELECT * FROM global", LINEITEM_SQL)
PLAIN_STATS = """count(*) AS reading_count, CAST(sum(cents) AS DOUBLE) / count(*) * 0.01 AS avg_value,
  min(value) AS min_value, max(value) AS max_value, CASE WHEN count(*) > 1 THEN
  sqrt(CAST(count(*) * sum(CAST(cents AS HUGEINT) * cents) - sum(CAST(cents AS HUGEINT)) * sum(CAST(cents AS HUGEINT)) AS DOUBLE)
  / (CAST(count(*) AS DOUBLE) * (count(*) - 1))) * 0.01 END AS stddev_value"""
add("entity_type_stats", lambda s, d: plain(R.entity_type_stats(events(s, d))),
    f"SELECT device_id, reading_type, {PLAIN_STATS} FROM readings GROUP BY ALL")
add("entity_stats", lambda s, d: plain(R.entity_stats(events(s, d))),
    f"SELECT device_id, {PLAIN_STATS} FROM readings GROUP BY ALL")
add("total_from_rollup", lambda s, d: A.total_from_rollup(R.global_rollup(events(s, d))),
    "SELECT count(*) AS total_readings FROM readings")
add("devices_upper_bound", lambda s, d: A.devices_upper_bound(R.global_rollup(events(s, d))),
    """SELECT CAST(sum(n) AS BIGINT) AS total_devices FROM (SELECT reading_type, count(DISTINCT device_id) AS n
    FROM readings GROUP BY 1)""")
add("service_stats", lambda s, d: A.service_stats(R.global_rollup(events(s, d)), events(s, d)),
    "SELECT count(*) AS total_readings, count(DISTINCT device_id) AS total_devices FROM readings")
add("weighted_average", lambda s, d: plain(R.weighted_avg(R.hourly_rollup(events(s, d)), ["device_id"])),
    f""", {HOURLY_SQL}, w AS (SELECT device_id, CAST(sum(reading_count) AS BIGINT) AS n,
    CAST(sum(CAST(round(avg_value * 100) AS BIGINT) * reading_count) AS BIGINT) AS s FROM hourly GROUP BY 1)
    SELECT device_id, n AS reading_count, ((2 * s + n) // (2 * n)) / CAST(100 AS DOUBLE) AS avg_value FROM w""")
add("weighted_average_exact", lambda s, d: plain(R.weighted_avg(R.hourly_rollup(events(s, d), keep_sum=True), ["device_id"])),
    f"SELECT device_id, count(*) AS reading_count, {AVG} AS avg_value FROM readings GROUP BY device_id")
add("rollup_recent_hours", lambda s, d: plain(A.rollup_recent(R.hourly_rollup(events(s, d)), "hour", DEVICE, AS_OF, 240, "hour", 10)),
    f""", {HOURLY_SQL} SELECT * FROM hourly WHERE device_id = '{DEVICE}'
    AND hour >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR ORDER BY hour DESC, reading_type LIMIT 10""")
add("rollup_recent_days", lambda s, d: plain(A.rollup_recent(R.daily_rollup(events(s, d)), "day", DEVICE, AS_OF, 7, "day")),
    f", {DAILY_SQL} SELECT * FROM daily WHERE device_id = '{DEVICE}' AND day >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")

