"""Registered queries that answer a whole table of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.tables import READINGS_SQL, REQUESTS_SQL, events, plain, requests_at
from tidemark.operators import requests as B
from tidemark.session import written

CATALOG: dict = {}


def add(name: str, query, sql: str | None) -> None:
    prefix = f"WITH {READINGS_SQL.strip()}, {REQUESTS_SQL.strip()} "
    CATALOG[name] = (query, prefix + sql if sql else None)


DOCUMENT = (
    "data array<struct<id string, timestamp string, value double, metadata struct<k string>>>, "
    "meta struct<count bigint, `limit` bigint, device_id string, reading_type string>"
)


def _parsed(s, d):
    """Requests are parsed once; several steps read them."""
    return written(requests_at(s, d), "parsed-requests")


def _outcomes(s, d):
    parsed = _parsed(s, d)
    return B.request_outcome(parsed, B.batch_latest(parsed, events(s, d)))


def _documents(s, d):
    parsed = _parsed(s, d)
    hits = B.batch_latest(parsed, B.with_text(events(s, d)), listed="text")
    doc = B.to_documents(parsed, hits).select("request_id", F.from_json("document", DOCUMENT).alias("doc"))
    meta, records = F.col("doc.meta"), F.col("doc.data")
    first = F.get(records, F.lit(0))
    return doc.select(
        "request_id",
        meta["count"].alias("count"),
        meta["limit"].alias("limit"),
        meta["device_id"].alias("device_id"),
        meta["reading_type"].alias("reading_type"),
        first["id"].alias("first_id"),
        first["timestamp"].alias("first_timestamp"),
        first["value"].alias("first_value"),
        first["metadata"]["k"].alias("first_k"),
        F.get(records, F.lit(1))["id"].alias("second_id"),
        F.array_join(F.transform(records, lambda r: r["id"]), ",").alias("ids"),
        F.array_join(F.transform(records, lambda r: r["timestamp"]), ",").alias("stamps"),
        F.aggregate(
            records, F.lit(0).cast("bigint"), lambda n, r: n + F.round(r["value"] * 100).cast("bigint")
        ).alias("cents"),
        F.aggregate(
            records, F.lit(0).cast("bigint"), lambda n, r: n + F.coalesce(r["metadata"]["k"].try_cast("bigint"), F.lit(0))
        ).alias("sum_k"),
    )


def _record_documents(s, d):
    doc = B.to_record_documents(B.lookup_ids(requests_at(s, d), events(s, d)))

    def field(path):
        return F.get_json_object("document", path)

    return doc.select(
        "request_id",
        field("$.meta.id").alias("meta_id"),
        field("$.data.id").alias("data_id"),
        field("$.data.device_id").alias("device_id"),
        field("$.data.unit").alias("unit"),
    )


OUTCOME = """CASE WHEN error_param IS NOT NULL THEN 'INVALID_PARAMETER'
  WHEN c.n IS NULL AND from_ts IS NULL AND to_ts IS NULL THEN 'DEVICE_NOT_FOUND' ELSE 'OK' END"""
STAMP = """strftime(a.ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(a.ts) % 1000000 = 0 THEN ''
  ELSE '.' || rtrim(lpad(CAST(epoch_us(a.ts) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z'"""

add("request_validation", lambda s, d: plain(requests_at(s, d)),
    """SELECT request_id, mode, CASE WHEN mode = 'id' THEN row_id END AS id,
    CASE WHEN by_device THEN device_id END AS device_id, CASE WHEN by_device THEN n END AS "limit",
    CASE WHEN by_device THEN nullif(reading_type, '') END AS reading_type,
    CASE WHEN by_device THEN from_ts END AS from_ts, CASE WHEN by_device THEN to_ts END AS to_ts,
    error_param, CASE WHEN error_param IS NOT NULL THEN 'INVALID_PARAMETER' END AS error_code FROM checked""")
add("lookup_by_id", lambda s, d: plain(B.lookup_ids(requests_at(s, d), events(s, d))),
    """SELECT q.request_id, CASE WHEN q.mode = 'id' THEN q.row_id END AS id,
    CASE WHEN q.error_param IS NOT NULL THEN 'INVALID_PARAMETER' WHEN r.id IS NULL THEN 'READING_NOT_FOUND'
    ELSE 'OK' END AS outcome, r.device_id, r.ts, r.reading_type, r.value, r.unit, r.metadata
    FROM checked q LEFT JOIN readings r ON q.error_param IS NULL AND r.id = q.row_id
    WHERE q.mode = 'id'""")
add("latest_for_requests", lambda s, d: plain(B.batch_latest(_parsed(s, d), events(s, d), carried=["ts", "reading_type", "value"])),
    "SELECT request_id, CAST(rn AS INTEGER) AS rn, id, device_id, ts, reading_type, value FROM answers")
add("request_outcomes", _outcomes,
    f"""SELECT q.request_id, {OUTCOME} AS outcome, coalesce(c.n, 0) AS row_count
    FROM checked q LEFT JOIN (SELECT request_id, count(*) AS n FROM answers GROUP BY 1) c USING (request_id)
    WHERE mode = 'device' OR mode IS NULL""")
add("response_documents", _documents,
    f"""SELECT q.request_id, coalesce(c.n, 0) AS count, q.n AS "limit", q.device_id, q.reading_type,
    CAST(a.id AS VARCHAR) AS first_id, {STAMP} AS first_timestamp, a.value AS first_value,
    json_extract_string(a.metadata, '$.k') AS first_k, CAST(b.id AS VARCHAR) AS second_id,
    coalesce(c.ids, '') AS ids, coalesce(c.stamps, '') AS stamps, coalesce(c.cents, 0) AS cents, coalesce(c.sum_k, 0) AS sum_k
    FROM checked q LEFT JOIN (SELECT request_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS ids,
      string_agg({STAMP}, ',' ORDER BY rn) AS stamps, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
      CAST(sum(coalesce(CAST(json_extract_string(metadata, '$.k') AS BIGINT), 0)) AS BIGINT) AS sum_k FROM answers a GROUP BY 1) c USING (request_id)
    LEFT JOIN answers a ON a.request_id = q.request_id AND a.rn = 1
    LEFT JOIN answers b ON b.request_id = q.request_id AND b.rn = 2
    WHERE mode = 'device' AND {OUTCOME} = 'OK'""")
add("record_documents", _record_documents,
    """SELECT q.request_id, CAST(r.id AS VARCHAR) AS meta_id, CAST(r.id AS VARCHAR) AS data_id, r.device_id, r.unit
    FROM checked q JOIN readings r ON q.error_param IS NULL AND q.mode = 'id' AND r.id = q.row_id""")
