"""Registered streaming queries; each runs its source to the end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import telemetry as C
from tidemark.catalog.readings import DAILY_SQL, HOURLY_SQL
from tidemark.catalog.tables import READINGS_SQL, plain
from tidemark.operators import alerts as K
from tidemark.operators import telemetry as T
from tidemark.plans.maintenance import read_rollup_by_date
from tidemark.plans.partials import PartialStore
from tidemark.session import shared_folder, written
from tidemark.sources.paths import folders
from tidemark.spec import EVENT_READINGS
from tidemark.streaming import rollups as S
from tidemark.streaming import state as Z
from tidemark.streaming.late import continuous_partials, correct, late_table
from tidemark.streaming.telemetry import continuous_metrics, window_metrics

CATALOG: dict = {}


def _finish(s, query, path):
    query.awaitTermination()
    return s.read.parquet(path)


def _event_stream(s, d):
    return S.stream_readings(s, d, EVENT_READINGS, "events.parquet")


def _hourly(s, d):
    path = shared_folder(s, "hourly-stream")
    return plain(_finish(s, S.continuous_hourly(_event_stream(s, d), path, path + "-checkpoint"), path))


def _with_closing_row(s, d):
    """The events as a stream whose last row, a month later, closes the windows of all others.

    The closing row's own windows stay open, so a stream writes all windows of the events.
    """
    path = shared_folder(s, "closed-events")
    events = s.read.parquet(f"{d}/events.parquet")
    last = events.orderBy(F.desc("ts"), "event_id").limit(1)
    late = last.withColumn("ts", F.col("ts") + F.expr("INTERVAL 31 DAYS"))
    events.unionByName(late).write.parquet(path)
    return S.stream_readings(s, path, EVENT_READINGS)


def _hourly_whole(s, d):
    path = shared_folder(s, "hourly-stream")
    query = S.continuous_hourly(_with_closing_row(s, d), path, path + "-checkpoint")
    return plain(_finish(s, query, path))


def _metrics_whole(s, d):
    path = shared_folder(s, "metrics-stream")
    log = _log_of(_with_closing_row(s, d))
    query = continuous_metrics(log, path, path + "-checkpoint", "1 day", 3600, 900)
    return plain(_finish(s, query, path))


def _disordered(s, d):
    """Arrivals of a few days each; some days arrive after days that follow them by weeks."""
    path = shared_folder(s, "disordered")
    events = s.read.parquet(f"{d}/events.parquet")
    late = F.col("event_id") % 5 == 0
    order = F.dayofyear("ts") + F.when(late, (F.col("event_id") % 7) * 4).otherwise(0)
    lot = F.least(F.floor(order / 8), F.lit(5)).cast("int")
    events.withColumn("lot", lot).write.partitionBy("lot").parquet(path)
    return path


def _corrected(s, d):
    """The store after all arrivals, with late rows merged by two corrections."""
    source, base = _disordered(s, d), shared_folder(s, "late-store")
    store, late = PartialStore(s, f"{base}/store", 15, 2), late_table(s, f"{base}/late")
    for k, name in enumerate(folders(s, source)):
        if k == 3:
            correct(store, late)
        readings = S.stream_readings(s, f"{source}/{name}", EVENT_READINGS)
        query = continuous_partials(readings, store, late, f"{base}/checkpoint-{name}", 3, source=name)
        query.awaitTermination()
    correct(store, late)
    return store, late


def _set_aside(s, d):
    """How many rows were late, and whether the corrected store has every row."""
    store, late = _corrected(s, d)
    rows = store.hours.read().agg(F.sum("rows").alias("stored_rows"))
    held = late.read().agg((F.count(F.lit(1)) > 0).alias("some_late"))
    return rows.join(F.broadcast(held), F.lit(True))


def _daily(s, d):
    """Four arrivals, in whatever order their files are taken."""
    parts = shared_folder(s, "arrivals")
    s.read.parquet(f"{d}/events.parquet").repartitionByRange(4, "ts").write.parquet(parts)
    path = shared_folder(s, "daily-stream")
    stream = S.stream_readings(s, parts, EVENT_READINGS, files=1)
    S.continuous_daily(stream, path + "-store", path, path + "-checkpoint").awaitTermination()
    return plain(read_rollup_by_date(s, path))


def _streamed_table(s, df, name):
    """A finished table, read back as a stream."""
    stored = written(df, name)
    return s.readStream.schema(stored.schema).parquet(stored.inputFiles()[0].rsplit("/", 1)[0])


def _stream_log(s, d):
    return _log_of(_event_stream(s, d))


def _log_of(readings):
    """The request log over the streamed events."""
    k = F.get_json_object("metadata", "$.k").cast("int")
    return readings.select(
        "ts",
        (F.col("id") - 1).alias("request_id"),
        F.col("reading_type").alias("endpoint"),
        F.col("reading_type").alias("key"),
        F.when(F.col("reading_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("duration_ms"),
        k.alias("rows"),
        F.when(k >= 50, "HIT").otherwise("MISS").alias("cache_status"),
    )


def _metrics(s, d):
    path = shared_folder(s, "metrics-stream")
    query = continuous_metrics(_stream_log(s, d), path, path + "-checkpoint", "1 day", 3600, 900)
    return plain(_finish(s, query, path))


def _reuse(s, d):
    Z.use_keyed_state(s)
    path = shared_folder(s, "reuse-stream")
    status = Z.reuse_stream(_stream_log(s, d), 900)
    return _finish(s, Z.write_stream(status, path, path + "-checkpoint"), path)


def _dealt_series(s, d):
    """Whole series in each file; all files are one batch, sorted by time in the state."""
    return C.alert_series(s, d).repartition("rule", "series")


def _alerts(s, d):
    Z.use_keyed_state(s)
    path = shared_folder(s, "alert-stream")
    series = _streamed_table(s, _dealt_series(s, d), "alert-series")
    fired = Z.alert_stream(series, K.rules_table(s, C.ALERT_RULES))
    return plain(_finish(s, Z.write_stream(fired, path, path + "-checkpoint"), path))


def _out_of_order(s, evaluations, rules):
    """Evaluations in five batches without any order, and a last row that closes their time."""
    Z.use_keyed_state(s)
    path, source = shared_folder(s, "ordered-alerts"), shared_folder(s, "evaluations")
    series = written(evaluations, "alert-series")
    lot = F.pmod(F.xxhash64("ts"), F.lit(5))
    for k in range(5):  # one file a batch
        series.where(lot == k).coalesce(1).write.mode("append").parquet(source)
    last = series.agg((F.max("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"))
    last.select(
        F.lit("").alias("rule"), F.lit("").alias("series"), "ts", F.lit(0.0).alias("value")
    ).write.mode("append").parquet(source)
    stream = s.readStream.schema(series.schema).option("maxFilesPerTrigger", 1).parquet(source)
    fired = Z.ordered_alert_stream(stream, rules, "45 days")
    return plain(_finish(s, Z.write_stream(fired, path, path + "-checkpoint"), path))


METRICS_SQL = f"""WITH {C.LOG_SQL}, spread AS (
  SELECT {C.bucket_sql(900)} - INTERVAL (g * 900) SECOND AS window_start, * FROM log, (SELECT unnest(range(4)) AS g))
SELECT window_start, endpoint, count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS errors,
  count(*) FILTER (WHERE rows >= 50) AS hits, count(*) FILTER (WHERE rows < 50) AS misses,
  {", ".join(f"count(*) FILTER (WHERE cents <= {b} * 100000) AS le_{i}" for i, b in enumerate(T.LATENCY_BOUNDS))},
  CAST(count(*) FILTER (WHERE status >= 500) AS DOUBLE) / count(*) AS error_ratio,
  CAST(count(*) FILTER (WHERE rows >= 50) AS DOUBLE) / count(*) AS hit_ratio
FROM spread GROUP BY window_start, endpoint"""

CATALOG["continuous_hourly_rollup"] = (
    _hourly,
    f"WITH {READINGS_SQL.strip()}, {HOURLY_SQL} SELECT * FROM hourly WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM readings) - INTERVAL 7 DAY",
)
CATALOG["continuous_hourly_rollup_whole"] = (
    _hourly_whole, f"WITH {READINGS_SQL.strip()}, {HOURLY_SQL} SELECT * FROM hourly"
)
CATALOG["continuous_daily_rollup"] = (
    _daily, f"WITH {READINGS_SQL.strip()}, {DAILY_SQL} SELECT * FROM daily"
)
CATALOG["corrected_hourly"] = (
    lambda s, d: plain(_corrected(s, d)[0].hourly()), f"WITH {READINGS_SQL.strip()}, {HOURLY_SQL} SELECT * FROM hourly"
)
CATALOG["corrected_daily"] = (
    lambda s, d: plain(_corrected(s, d)[0].daily()), f"WITH {READINGS_SQL.strip()}, {DAILY_SQL} SELECT * FROM daily"
)
CATALOG["late_rows"] = (
    _set_aside, f"WITH {READINGS_SQL.strip()} SELECT count(*) AS stored_rows, true AS some_late FROM readings"
)
CATALOG["sliding_metrics"] = (
    lambda s, d: plain(window_metrics(C.log(s, d).withColumn(
        "cache_status", F.when(F.col("rows") >= 50, "HIT").otherwise("MISS")), 3600, 900)),
    METRICS_SQL,
)
CATALOG["continuous_metrics"] = (
    _metrics,
    METRICS_SQL + " HAVING window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM log) - INTERVAL 1 DAY",
)
CATALOG["continuous_metrics_whole"] = (_metrics_whole, METRICS_SQL)
CATALOG["continuous_cache_reuse"] = (_reuse, "WITH " + C.reuse_sql("endpoint", 900) + " SELECT * FROM judged")
_alert_sql = C.CATALOG["alerts"][1]
CATALOG["continuous_alerts"] = (
    _alerts, f"SELECT rule, series, pending_since, firing_since FROM ({_alert_sql})"
)
CATALOG["ordered_alerts"] = (
    lambda s, d: _out_of_order(s, C.alert_series(s, d), K.rules_table(s, C.ALERT_RULES)),
    CATALOG["continuous_alerts"][1],
)
CATALOG["continuous_rule_alerts"] = (
    lambda s, d: _out_of_order(s, C.rule_evaluations(s, d), K.rules_table(s)),
    f"WITH {C.LOG_SQL}{C.RULE_ALERTS_SQL} SELECT rule, series, pending_since, firing_since FROM fired",
)
