"""The driver's tables in the shapes the operators take, for Spark and for the SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.readings import read_readings, read_utc
from tidemark.spec import EVENT_READINGS, LINEITEM_READINGS, ORDER_READINGS

AS_OF = "2024-01-30 00:00:00"
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
DEVICE = "sensor-000007"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_readings(spark, f"{sf}/events.parquet", EVENT_READINGS)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return read_readings(spark, f"{sf}/orders.parquet", ORDER_READINGS)


def lineitems(spark: SparkSession, sf: str) -> DataFrame:
    return read_readings(spark, f"{sf}/lineitem.parquet", LINEITEM_READINGS)


def plain(df: DataFrame) -> DataFrame:
    """Result types both engines share: decimals as double, instants without a zone, dates as text."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith("decimal"):
            out.append(F.col(name).cast("double").alias(name))
        elif kind == "timestamp":
            out.append(F.col(name).cast("timestamp_ntz").alias(name))
        elif kind == "date":
            out.append(F.col(name).cast("string").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One text request per event: unbounded, typed, bounded, by id, and a broken one."""
    e = read_utc(spark, f"{sf}/events.parquet").withColumn("t", F.col("ts"))
    kind, eid = F.col("event_type"), F.col("event_id")
    device = F.format_string("sensor-%06d", "user_id")
    limit = (eid % 500 + 1).cast("string")
    broken = eid % 8

    def at(seconds: int):
        return F.date_format(
            F.timestamp_seconds(F.unix_seconds("t") + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"
        )

    bad = kind == "error"
    return e.select(
        eid.alias("request_id"),
        F.when(kind == "signup", (eid * 3 + 1).cast("string"))
        .when(bad & (broken == 0), "7")
        .when(bad & (broken == 1), "-5")
        .when(bad & (broken == 2), " 12")
        .alias("id"),
        F.when(kind == "signup", "")
        .when(bad & broken.isin(1, 2, 3), F.lit(None))
        .when(bad & (broken == 4), "sensor 1")
        .when(bad & (broken == 7), "no-such-device")
        .otherwise(device)
        .alias("device_id"),
        F.when(bad & (broken == 5), "501").when(bad & (broken == 7), "10abc").otherwise(limit).alias("limit"),
        F.when(kind == "click", F.lit("view")).otherwise("").alias("reading_type"),
        F.when(kind == "purchase", at(-7 * 86400))
        .when(bad & (broken == 6), "2024-01-01")
        .alias("from"),
        F.when(kind.isin("purchase", "click") & (eid % 2 == 0), at(0)).alias("to"),
    )


def requests_at(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.requests import validate_requests

    return validate_requests(requests(spark, sf))


READINGS_SQL = """
readings AS (
  SELECT event_id + 1 AS id, 'sensor-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS device_id,
         ts, event_type AS reading_type, CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(round(value * 100) AS BIGINT) / CAST(100 AS DOUBLE) AS value,
         'per_' || event_type AS unit, props AS metadata
  FROM events)"""

ORDERS_SQL = """
readings AS (
  SELECT o_orderkey + 1 AS id, 'customer-' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS device_id,
         o_orderdate AS ts, o_orderstatus AS reading_type,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         CAST(round(o_totalprice * 100) AS BIGINT) / CAST(100 AS DOUBLE) AS value
  FROM orders)"""

LINEITEM_SQL = """
readings AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         'supplier-' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS device_id,
         l_shipdate AS ts, l_returnflag AS reading_type,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(round(l_extendedprice * 100) AS BIGINT) / CAST(100 AS DOUBLE) AS value
  FROM lineitem)"""

REQUESTS_SQL = r"""
requests AS (
  SELECT event_id AS request_id,
    CASE WHEN event_type = 'signup' THEN CAST(event_id * 3 + 1 AS VARCHAR)
         WHEN event_type = 'error' AND event_id % 8 = 0 THEN '7'
         WHEN event_type = 'error' AND event_id % 8 = 1 THEN '-5'
         WHEN event_type = 'error' AND event_id % 8 = 2 THEN ' 12' END AS id,
    CASE WHEN event_type = 'signup' THEN ''
         WHEN event_type = 'error' AND event_id % 8 IN (1, 2, 3) THEN NULL
         WHEN event_type = 'error' AND event_id % 8 = 4 THEN 'sensor 1'
         WHEN event_type = 'error' AND event_id % 8 = 7 THEN 'no-such-device'
         ELSE 'sensor-' || lpad(CAST(user_id AS VARCHAR), 6, '0') END AS device_id,
    CASE WHEN event_type = 'error' AND event_id % 8 = 5 THEN '501'
         WHEN event_type = 'error' AND event_id % 8 = 7 THEN '10abc'
         ELSE CAST(event_id % 500 + 1 AS VARCHAR) END AS lim,
    CASE WHEN event_type = 'click' THEN 'view' ELSE '' END AS reading_type,
    CASE WHEN event_type = 'purchase'
           THEN strftime(date_trunc('second', ts) - INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%SZ')
         WHEN event_type = 'error' AND event_id % 8 = 6 THEN '2024-01-01' END AS frm,
    CASE WHEN event_type IN ('purchase', 'click') AND event_id % 2 = 0
           THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') END AS til
  FROM events),
parsed AS (
  SELECT *,
    coalesce(id, '') <> '' AS by_id, coalesce(device_id, '') <> '' AS by_device,
    CASE WHEN regexp_full_match(coalesce(id, ''), '[+-]?[0-9]+') THEN TRY_CAST(id AS BIGINT) END AS row_id,
    coalesce(TRY_CAST(nullif(regexp_extract(lim, '^[ \t]*([+-]?[0-9]+)', 1), '') AS BIGINT), 10) AS n,
    CASE WHEN regexp_full_match(frm, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ')
         THEN CAST(replace(replace(frm, 'T', ' '), 'Z', '') AS TIMESTAMP) END AS from_ts,
    CASE WHEN regexp_full_match(til, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ')
         THEN CAST(replace(replace(til, 'T', ' '), 'Z', '') AS TIMESTAMP) END AS to_ts
  FROM requests),
checked AS (
  SELECT *,
    CASE WHEN by_id AND NOT by_device THEN 'id' WHEN by_device AND NOT by_id THEN 'device' END AS mode,
    CASE WHEN by_id AND by_device THEN 'id,device_id'
         WHEN NOT by_id AND NOT by_device THEN 'id or device_id'
         WHEN by_id THEN CASE WHEN coalesce(row_id, 0) < 1 THEN 'id' END
         WHEN n < 1 OR n > 500 THEN 'limit'
         WHEN coalesce(frm, '') <> '' AND from_ts IS NULL THEN 'from'
         WHEN coalesce(til, '') <> '' AND to_ts IS NULL THEN 'to'
         WHEN from_ts > to_ts THEN 'from, to'
         WHEN NOT regexp_full_match(device_id, '[a-zA-Z0-9_-]{1,50}') THEN 'device_id'
         WHEN reading_type <> '' AND NOT regexp_full_match(reading_type, '[a-zA-Z0-9]{1,30}')
           THEN 'reading_type' END AS error_param
  FROM parsed),
hits AS (
  SELECT q.request_id, q.n, r.*,
         row_number() OVER (PARTITION BY q.request_id ORDER BY r.ts DESC, r.id DESC) AS rn
  FROM checked q JOIN readings r ON r.device_id = q.device_id
   AND (q.reading_type = '' OR r.reading_type = q.reading_type)
   AND (q.from_ts IS NULL OR r.ts >= q.from_ts) AND (q.to_ts IS NULL OR r.ts <= q.to_ts)
  WHERE q.mode = 'device' AND q.error_param IS NULL),
answers AS (SELECT * FROM hits WHERE rn <= n)"""
