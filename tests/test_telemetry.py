"""Edge cases of histograms, rates, alerts and verdicts."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordered import gap_islands, previous, running_max
from tidemark.operators import alerts as K
from tidemark.operators import telemetry as T
from tidemark.operators import verdicts as V

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SAMPLES = "ts timestamp, metric string, labels map<string,string>, le double, value double"
LOG = "ts timestamp, endpoint string, method string, status int, duration_ms decimal(10,2), size_bytes bigint, cache_status string"


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def samples(spark, rows):
    return spark.createDataFrame(rows, SAMPLES)


def test_counter_reset_and_first_sample(spark):
    values = [100, 110, 115, 3, 10]
    df = samples(spark, [(at(i * 60), "c", {"a": "x"}, None, float(v)) for i, v in enumerate(values)])
    rows = T.counter_increase(df, "c").orderBy("ts").collect()
    assert [r["increase"] for r in rows] == [None, 10.0, 5.0, 3.0, 7.0]
    rate = T.counter_rate(df, "c", ["a"], 300).collect()
    assert [(r["a"], r["rate"]) for r in rate] == [("x", 25 / 300)]


def test_label_order_does_not_split_a_series(spark):
    rows = [(at(0), "c", {"a": "x", "b": "y"}, None, 1.0), (at(60), "c", {"b": "y", "a": "x"}, None, 4.0)]
    assert [r["rate"] for r in T.counter_rate(samples(spark, rows), "c", ["a"], 300).collect()] == [3 / 300]


def test_previous_across_days(spark):
    """A predecessor days earlier, past chunks without rows, is still found."""
    times = [0, 10, 86399, 86400, 86400 * 5 + 7, 86400 * 9]
    df = spark.createDataFrame([("k", at(t), i) for i, t in enumerate(times)], "k string, ts timestamp, n int")
    got = previous(df, ["k"], ["ts"], ["n"]).orderBy("ts").select("_prev.n").collect()
    assert [r[0] for r in got] == [None, 0, 1, 2, 3, 4]
    tops = running_max(df, ["k"], ["ts"], F.when(F.col("n") == 2, 9).otherwise(F.col("n")), "m").orderBy("ts").collect()
    assert [r["m"] for r in tops] == [0, 1, 9, 9, 9, 9]
    isles = gap_islands(df, ["k"], ["ts"], 86400).groupBy("island").count().orderBy("island").collect()
    assert [r["count"] for r in isles] == [4, 1, 1]


def test_quantile_edges(spark):
    rows = [("all_slow", 1.0, 0), ("all_slow", float("inf"), 5), ("empty", 1.0, 0), ("empty", float("inf"), 0)]
    rows += [("mid", 1.0, 2), ("mid", 2.0, 10), ("mid", float("inf"), 10)]
    hist = spark.createDataFrame(rows, "k string, le double, cumulative bigint")
    got = {r["k"]: r["quantile"] for r in T.histogram_quantile(hist, 0.5, ["k"]).collect()}
    assert got == {"all_slow": 1.0, "empty": None, "mid": 1.0 + 3 / 8}


def log(spark):
    rows = [
        (at(0), "a", "GET", 200, "1.00", 0, "HIT"),
        (at(1), "a", "GET", 200, "5.00", 100, "MISS"),
        (at(2), "a", "GET", 503, "12000.00", 101, None),
        (at(400), "a", "GET", 200, "5.01", 99999999, None),
    ]
    df = spark.createDataFrame(rows, LOG.replace("decimal(10,2)", "string"))
    return df.withColumn("duration_ms", F.col("duration_ms").cast("decimal(10,2)"))


def test_histograms_and_ratios(spark):
    lat = {r["le"]: r["cumulative"] for r in T.latency_histogram(log(spark)).collect()}
    assert len(lat) == 13
    assert (lat[0.001], lat[0.005], lat[0.01], lat[10.0], lat[float("inf")]) == (1, 2, 3, 3, 4)
    size = {r["le"]: (r["cumulative"], r["observations"]) for r in T.size_histogram(log(spark)).collect()}
    assert (size[100.0], size[1000.0], size[float("inf")]) == ((1, 3), (2, 3), (3, 3))
    hits = [r["hit_ratio"] for r in T.hit_ratio(log(spark)).orderBy("window_start").collect()]
    assert hits == [0.5, None]
    errors = [r["error_ratio"] for r in T.error_ratio(log(spark)).orderBy("window_start").collect()]
    assert errors == [1 / 3, 0.0]


def series(spark, values, step=30):
    rows = [("HighLatency", "a", at(i * step), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "rule string, series string, ts timestamp, value double")


@pytest.mark.parametrize(
    "values, fires",
    [
        ([1, 1, 1, 1], 0),  # holds for 90 seconds
        ([1, 1, 1, 1, 1], 1),  # exactly two minutes
        ([1, 1, 1, 0, 1, 1, 1], 0),
        ([0, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1], 2),
        ([0.5, 0.5, 0.5, 0.5, 0.5], 0),  # the threshold itself does not count
    ],
)
def test_alert_hold(spark, values, fires):
    out = K.alerts(series(spark, [float(v) for v in values]), K.rules_table(spark)).collect()
    assert len(out) == fires
    for r in out:
        assert r["firing_since"] - r["pending_since"] == datetime.timedelta(minutes=2)
        assert (r["severity"], r["component"]) == ("warning", "api")


def test_alert_over_midnight(spark):
    df = series(spark, [1.0] * 5000)
    out = K.alerts(df, K.rules_table(spark)).collect()
    assert [(r["pending_since"], r["last_true"]) for r in out] == [(at(0).replace(tzinfo=None), at(4999 * 30).replace(tzinfo=None))]


def test_all_rules_from_samples(spark):
    rows = []
    for i in range(80):
        t = at(i * 5)
        rows += [
            (t, "node_cpu_seconds_total", {"cpu": "0", "mode": "iowait"}, None, i * 5 * 0.5),
            (t, "node_cpu_seconds_total", {"cpu": "0", "mode": "idle"}, None, i * 5 * 0.05),
            (t, "node_memory_SwapTotal_bytes", {}, None, 100.0),
            (t, "node_memory_SwapFree_bytes", {}, None, 90.0),
            (t, "http_request_duration_seconds_bucket", {"endpoint": "/a"}, 0.5, 1.0 * i),
            (t, "http_request_duration_seconds_bucket", {"endpoint": "/a"}, 1.0, 10.0 * i),
            (t, "http_request_duration_seconds_bucket", {"endpoint": "/a"}, float("inf"), 10.0 * i),
            (t, "http_requests_total", {"endpoint": "/a", "status": "200"}, None, 9.0 * i),
            (t, "http_requests_total", {"endpoint": "/a", "status": "503"}, None, 1.0 * i),
            (t, "pg_stat_activity_count", {"state": "active"}, None, 100.0),
            (t, "pg_stat_activity_count", {"state": "idle"}, None, 61.0),
            (t, "redis_memory_used_bytes", {}, None, 0.95 * K.CACHE_BYTES),
        ]
    evaluated = K.rule_series(samples(spark, rows))
    fired = {r["rule"]: r["severity"] for r in K.alerts(evaluated, K.rules_table(spark)).collect()}
    assert fired == {name: severity for name, _, _, severity, _ in K.RULES}


def test_rules_do_not_add_up_hosts(spark):
    """Two hosts below a threshold never fire it; one host above it does, whatever the other does."""

    def node(host, wait, idle, used):
        out = []
        for i in range(80):
            t, labels = at(i * 5), {"instance": host, "cpu": "0"}
            out += [
                (t, "node_cpu_seconds_total", {**labels, "mode": "iowait"}, None, i * 5 * wait),
                (t, "node_cpu_seconds_total", {**labels, "mode": "idle"}, None, i * 5 * idle),
                (t, "redis_memory_used_bytes", {"instance": host}, None, used * K.CACHE_BYTES),
            ]
        return out

    def fired(rows):
        found = K.alerts(K.rule_series(samples(spark, rows)), K.rules_table(spark)).collect()
        return {(r["rule"], "h2" in r["series"]) for r in found}

    assert fired(node("h1", 0.15, 0.8, 0.5) + node("h2", 0.15, 0.8, 0.5)) == set()
    assert fired(node("h1", 0.01, 0.9, 0.1) + node("h2", 0.5, 0.05, 0.95)) == {
        ("HighIOWait", True),
        ("CPUHighUsage", True),
        ("RedisMemoryPressure", True),
    }


def test_verdicts_and_comparison(spark):
    summary = spark.createDataFrame(
        [("s", 300.0, 499.9, 0.01, 0.7)], "scenario string, p50_ms double, p95_ms double, error_share double, hit_ratio double"
    )
    got = {r["stat"]: r["verdict"] for r in V.slo_verdict(summary, ["scenario"], V.targets_table(spark)).collect()}
    assert got == {"p50_ms": "fail", "p95_ms": "pass", "error_share": "fail"}
    bands = {r["stat"]: r["grade"] for r in V.banded(summary, ["scenario"]).collect()}
    assert bands == {"p50_ms": "pass", "p95_ms": "pass", "error_share": "pass", "hit_ratio": "warn"}
    levels = {r["stat"]: r["grade"] for r in V.alert_level(summary, ["scenario"]).collect()}
    assert levels == {"p95_ms": "warning", "error_share": "warning", "hit_ratio": "ok"}
    rows = [
        ("a", "p50_ms", 100.0), ("b", "p50_ms", 110.0),
        ("a", "p95_ms", 100.0), ("b", "p95_ms", 110.01),
        ("a", "requests", 100.0), ("b", "requests", 80.0),
        ("a", "avg_ms", 3.0), ("b", "avg_ms", 2.0),
        ("a", "error_share", 0.0), ("b", "error_share", 0.5),
    ]
    runs = spark.createDataFrame(rows, "run string, stat string, value double")
    out = {r["stat"]: (r["verdict"], r["delta_percent"]) for r in V.compare_runs(runs, [], "a", "b").collect()}
    assert {k: v[0] for k, v in out.items()} == {
        "p50_ms": "minor", "p95_ms": "regression", "requests": "regression", "avg_ms": "improved", "error_share": "N/A"
    }
    assert float(out["avg_ms"][1]) == -33.3333


def test_probes(spark):
    rows = [
        (at(0), "database", "healthy", 1.0), (at(0), "cache", "healthy", 2.0),
        (at(60), "database", "unhealthy", 1.0), (at(60), "cache", "unhealthy", 2.0),
        (at(120), "database", "healthy", 1.0), (at(120), "cache", "unhealthy", 9.0),
    ]
    checks = spark.createDataFrame(rows, "probe_ts timestamp, dependency string, status string, latency_ms double")
    got = [r["status"] for r in T.probe_rollup(checks).orderBy("probe_ts").collect()]
    assert got == ["healthy", "unhealthy", "degraded"]
    share = {r["dependency"]: r["availability"] for r in T.availability(checks).collect()}
    assert share == {"database": 2 / 3, "cache": 1 / 3}


def test_load_ceiling_stops_at_first_failure(spark):
    rows = []
    for step, (n, ms) in enumerate([(10, 100), (20, 150), (30, 5000), (5, 10)]):
        rows += [(at(step * 30 + i), "a", "GET", 200, ms, 1, None) for i in range(min(n, 30))]
    df = spark.createDataFrame(rows, LOG.replace("decimal(10,2)", "int")).withColumn(
        "duration_ms", F.col("duration_ms").cast("decimal(10,2)")
    )
    r = T.load_ceiling(df).first()
    assert (r["steps_held"], r["last_rate"]) == (2, 20 / 30)
