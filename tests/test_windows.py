"""Panes, measured time ranges, quantile sketches, and what is judged from them."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordered as O
from tidemark.operators import telemetry as T
from tidemark.operators import verdicts as V

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SAMPLES = "ts timestamp, metric string, labels map<string,string>, le double, value double"


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def naive(t):
    return t.replace(tzinfo=None)


@pytest.mark.parametrize("seconds, slide", [(120, 5), (3600, 900), (300, None), (60, 60), (90, 60)])
def test_windows_from_panes(spark, seconds, slide):
    """Every window holds what rows within it add up to; a window that is no multiple of its slide, too."""
    rng = random.Random(7)
    rows = [(at(rng.randrange(0, 9000)), rng.choice("ab"), 1) for _ in range(400)] + [(None, "a", 1)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, n int")
    got = T.paned(df, ["k"], seconds, slide, {"n": F.sum("n")}).collect()
    step, want = slide or seconds, {}
    for ts, k, n in rows[:-1]:
        second = int((ts - T0).total_seconds())
        first = second // step * step
        for start in range(first, second - seconds, -step):
            key = (naive(at(start)), k)
            want[key] = want.get(key, 0) + n
    assert {(r["window_start"], r["k"]): r["n"] for r in got} == want


def test_only_panes_are_repeated(spark):
    """Rows meet an aggregate before anything is multiplied for the windows."""
    rows = spark.range(1000).select(F.timestamp_seconds("id").alias("ts"))
    windows = T.paned(rows, [], 120, 5, {"n": F.count(F.lit(1))})
    plan = windows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {name: [i for i, line in enumerate(plan) if name in line] for name in ("Expand", "Aggregate")}
    assert len(depth["Expand"]) == 1 and len(depth["Aggregate"]) == 2
    assert depth["Aggregate"][0] < depth["Expand"][0] < depth["Aggregate"][1]


def test_one_series_in_one_day_is_spread(spark):
    """A series with all rows of one day falls into many chunks, none with a hundredth of them."""
    n = 200_000
    df = spark.range(n).select(
        F.lit("hot").alias("k"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 400_000).alias("ts"), "id"
    )
    chunked = O._chunked(df, "ts", O.DAY)
    assert chunked.agg(F.count_distinct(F.to_date("ts"))).first()[0] == 1
    sizes = chunked.groupBy("_chunk").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] <= n / 100 and sizes[1] >= 500
    linked = O.previous(df, ["k"], ["ts", "id"], ["id"])
    wrong = linked.where(~F.col("_prev.id").eqNullSafe(F.when(F.col("id") > 0, F.col("id") - 1)))
    assert linked.count() == n and wrong.count() == 0
    isles = O.islands(df, ["k"], ["ts", "id"], F.col("id") % 50_000 == 0).groupBy("island").count().collect()
    assert [r["count"] for r in isles] == [50_000] * 4


def test_chunks_follow_time_with_ties_and_nulls(spark):
    rng = random.Random(3)
    times = [rng.choice([5, 5, 5, 86399, 86400, 100, 9 * 86400 + rng.randrange(50)]) for _ in range(300)]
    rows = [("a" if i % 3 else None, at(t), i) for i, t in enumerate(times)] + [("a", None, 900), ("b", None, 901)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int")
    order = {}
    for k in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] or at(-1), r[2]))
        order.update({r[2]: (p[2] if p else None) for p, r in zip([None, *mine], mine)})
    got = {r["id"]: r["p"] for r in O.previous(df, ["k"], ["ts", "id"], ["id"]).select("id", F.col("_prev.id").alias("p")).collect()}
    assert got == order
    assert O.previous(df.limit(0), ["k"], ["ts", "id"], ["id"]).count() == 0


def test_waits_per_operation(spark):
    def counter(name, per_minute, labels=None):
        return [(at(i * 60), name, labels or {"device": "sda"}, None, float(i * per_minute)) for i in range(3)]

    rows = counter("node_disk_reads_completed_total", 30) + counter("node_disk_read_time_seconds_total", 3)
    rows += counter("node_disk_writes_completed_total", 0) + counter("node_disk_write_time_seconds_total", 0)
    got = T.wait_per_operation(spark.createDataFrame(rows, SAMPLES), ["device"], 60).collect()
    found = {(r["operation"], r["per_second"], r["wait_ms"]) for r in got}
    assert found == {("read", 0.5, 100.0), ("write", 0.0, None)}


def test_share_of_a_gauge(spark):
    rows = [(at(0), "used", {"db": d}, None, v) for d, v in (("a", 30.0), ("b", 50.0))]
    rows += [(at(0), "most", {}, None, 200.0), (at(60), "used", {"db": "a"}, None, 1.0), (at(60), "most", {}, None, 0.0)]
    rows += [(at(120), "used", {"db": "a"}, None, 1.0)]  # no limit was scraped
    got = T.gauge_share(spark.createDataFrame(rows, SAMPLES), "used", "most").orderBy("ts").collect()
    assert [r["share"] for r in got] == [0.4, None]


def test_tiers_and_their_targets(spark):
    rows = [("id", None, None, None), (None, None, None, None), ("device", "d", None, None),
            ("device", "d", at(0), None), ("device", "d", None, at(0))]
    asked = spark.createDataFrame(rows, "mode string, device_id string, from_ts timestamp, to_ts timestamp")
    assert [r[0] for r in asked.select(T.query_tier()).collect()] == [
        "pk_lookup", "stats_agg", "device_filter", "time_range", "time_range"]
    summary = spark.createDataFrame([("pk_lookup", 100.0, 150.0), ("stats_agg", 450.0, 900.0), ("other", 1.0, 1.0)],
                                    "segment string, p95_ms double, p99_ms double")
    got = V.slo_verdict(summary, ["segment"], V.tier_targets(spark)).collect()
    assert {(r["segment"], r["stat"]): r["verdict"] for r in got} == {
        ("pk_lookup", "p95_ms"): "fail", ("pk_lookup", "p99_ms"): "pass",
        ("stats_agg", "p95_ms"): "pass", ("stats_agg", "p99_ms"): "fail"}


def test_users_at_a_time(spark):
    rows = [("a", f"u{i % 40}", at(i)) for i in range(60)] + [("a", f"w{i}", at(100 + i)) for i in range(29)]
    rows += [("b", "u", at(i)) for i in range(50)] + [("c", f"x{i}", at(i)) for i in range(50)]
    log = spark.createDataFrame(rows, "endpoint string, device_id string, ts timestamp")
    users = T.concurrent_users(log, ["endpoint"], 60)
    assert {r[0]: r[1] for r in users.collect()} == {"a": 40, "b": 1, "c": 50}
    assert {r["endpoint"]: r["grade"] for r in V.banded(users, ["endpoint"]).collect()} == {
        "a": "warn", "b": "fail", "c": "pass"}


@pytest.mark.parametrize("seconds", [600, 86400])
def test_sketches_of_any_windows_unite(spark, seconds):
    """The rank of every estimate is within the bound, for few and for many united sketches."""
    n = 50_000
    log = spark.range(n).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7).alias("ts"),
        F.lit("a").alias("endpoint"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 100).cast("decimal(10,2)").alias("duration_ms"),
    )
    with_null = log.unionByName(log.limit(1).withColumn("duration_ms", F.lit(None).cast("decimal(10,2)")))
    row = T.sketched_quantiles(T.latency_sketches(with_null, ["endpoint"], seconds), ["endpoint"]).first()
    assert row["requests"] == n
    values = sorted(int(r[0] * 100) for r in log.select("duration_ms").collect())
    for p in (50, 90, 95, 99):
        rank = sum(v < row[f"p{p}"] for v in values) / n
        assert abs(rank - p / 100) <= T.SKETCH_ERROR
