"""Streams in several batches against the batch operators on the same rows."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.catalog import streams as C
from tidemark.operators import alerts as K
from tidemark.operators import reuse as U
from tidemark.operators import rollups as R
from tidemark.plans import maintenance as M
from tidemark.spec import ReadingsSpec
from tidemark.streaming import rollups as S
from tidemark.streaming import state as Z

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
READ = "id bigint, device_id string, ts timestamp, reading_type string, value decimal(10,2), unit string, metadata string"
SPEC = ReadingsSpec(("id",), "device_id", "ts", "value", "reading_type", "unit", "metadata")
LOG = "ts timestamp, request_id bigint, key string, status int, rows int"


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def readings(spark, times, start=0):
    rows = [(start + i, "d", at(t), "t", Decimal(i % 17), "u", "{}") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, READ).coalesce(1)


def test_hourly_drops_rows_past_the_look_back(spark, folder):
    src, out = folder + "/src", folder + "/out"

    def advance():
        stream = S.stream_readings(spark, src, SPEC)
        S.continuous_hourly(stream, out, folder + "/checkpoint", 7).awaitTermination()

    day = 86400
    first = readings(spark, [10, 20, 3700, 8 * day, 8 * day + 10])
    first.write.mode("append").parquet(src)
    advance()
    # One hour inside the look-back, one hour that is closed already.
    second = readings(spark, [2 * day, 30, 20 * day], 100)
    second.write.mode("append").parquet(src)
    advance()
    got = spark.read.parquet(out)
    counts = {r["hour"].replace(tzinfo=datetime.timezone.utc): r["reading_count"] for r in got.collect()}
    assert counts == {at(0): 2, at(3600): 1, at(2 * day): 1, at(8 * day): 2}
    kept = first.unionByName(second.where("id <> 101"))
    closed = R.hourly_rollup(kept).where(F.col("hour") < F.lit(at(13 * day)))
    assert M.rollup_diff(closed, got, "hourly").isEmpty()


def test_daily_reopens_days_within_the_look_back_only(spark, folder):
    src, out, day = folder + "/src", folder + "/out", 86400

    def advance():
        stream = S.stream_readings(spark, src, SPEC, files=1)
        S.continuous_daily(stream, folder + "/store", out, folder + "/checkpoint", 30).awaitTermination()
        return M.read_rollup_by_date(spark, out)

    first = readings(spark, [5, 10, 40 * day, 40 * day + 1])
    first.write.mode("append").parquet(src)
    advance()
    inside = readings(spark, [12 * day, 40 * day + 2], 10)
    inside.write.mode("append").parquet(src)
    assert M.rollup_diff(M.build("daily", first.unionByName(inside)), advance(), "daily").isEmpty()
    readings(spark, [20], 20).write.mode("append").parquet(src)
    assert M.rollup_diff(M.build("daily", first.unionByName(inside)), advance(), "daily").isEmpty()


def test_reuse_over_batches(spark, folder):
    Z.use_keyed_state(spark)
    rng, rows, t = random.Random(4), [], 0.0
    for i in range(900):
        t += rng.expovariate(1 / 9)
        rows.append((at(round(t, 3)), i, f"k{rng.randint(0, 2)}", 200 if rng.random() < 0.9 else 500, rng.randint(0, 2)))
    src, out = folder + "/src", folder + "/out"
    for part in range(3):
        spark.createDataFrame(rows[part * 300 : part * 300 + 300], LOG).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(LOG).parquet(src)
        Z.write_stream(Z.reuse_stream(stream, 30), out, folder + "/checkpoint").awaitTermination()
    got = {r["request_id"]: r["cache_status"] for r in spark.read.parquet(out).collect()}
    want = {r["request_id"]: r["cache_status"] for r in U.ttl_status(spark.createDataFrame(rows, LOG), 30).collect()}
    assert got == want and set(want.values()) == {"HIT", "MISS"}


def test_alert_hold_over_batches(spark, folder):
    Z.use_keyed_state(spark)
    rng = random.Random(9)
    rows = [("HighLatency", f"s{i % 2}", at(i * 15), rng.choice([0.1, 0.9, 0.9, 0.9, 0.9, 0.9])) for i in range(600)]
    schema = "rule string, series string, ts timestamp, value double"
    src, out = folder + "/src", folder + "/out"
    rules = K.rules_table(spark)
    for part in range(3):
        spark.createDataFrame(rows[part * 200 : part * 200 + 200], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        Z.write_stream(Z.alert_stream(stream, rules), out, folder + "/checkpoint").awaitTermination()
    columns = ["rule", "series", "pending_since", "firing_since"]
    got = spark.read.parquet(out).select(columns)
    want = K.alerts(spark.createDataFrame(rows, schema), rules).select(columns)
    assert sorted(got.collect()) == sorted(want.collect()) and not want.isEmpty()


def test_a_closing_row_lets_the_stream_write_every_window(spark, sf):
    """All windows of the whole-table query come out of the stream, without the closing row's own."""
    from tidemark.catalog.tables import events, plain

    got, closed = C._hourly_whole(spark, sf), C._hourly(spark, sf)
    want = plain(R.hourly_rollup(events(spark, sf)))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
    assert closed.count() < got.count()


def test_alert_series_are_dealt_by_rule_and_series(spark, sf):
    plan = C._dealt_series(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("RepartitionByExpression [rule")


def test_alerts_by_event_time(spark, folder):
    """Batches out of order, with breaks of a run arriving after it seemed to hold."""
    Z.use_keyed_state(spark)
    rules = K.rules_table(spark, (("Hot", 10.0, 60, "warning", "x"),))
    values = [11, 12, 13, 14, 9, 11, 11, 11, 11, 11, 3, 11, 11, 12, 12, 11, 8, 20, 20]
    rows = [("Hot", s, at(20 * i), float(v)) for i, v in enumerate(values) for s in ("a", "b")]
    rows += [("Hot", "c", at(20 * i), 5.0 if i % 3 == 0 else 50.0) for i in range(19)]
    schema = "rule string, series string, ts timestamp, value double"
    want = sorted(
        (r["series"], r["pending_since"], r["firing_since"])
        for r in K.alerts(spark.createDataFrame(rows, schema), rules).collect()
    )
    assert want and not any(s == "c" for s, _, _ in want)
    src, out = folder + "/src", folder + "/out"
    random.Random(4).shuffle(rows)
    for k in range(0, len(rows), 12):
        spark.createDataFrame(rows[k : k + 12], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        Z.write_stream(Z.ordered_alert_stream(stream, rules, "1 hour"), out, folder + "/c").awaitTermination()
    assert spark.read.parquet(out).count() == 0  # nothing is certain yet
    spark.createDataFrame([("", "", at(9000), 0.0)], schema).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    Z.write_stream(Z.ordered_alert_stream(stream, rules, "1 hour"), out, folder + "/c").awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted((r["series"], r["pending_since"], r["firing_since"]) for r in got) == want


def test_a_busy_key_is_answered_in_pieces_from_plain_arrays(monkeypatch):
    import pandas as pd

    from tidemark.streaming import state

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, _):
            pass

    def never(*_, **__):
        raise AssertionError("the rows of a key are not gathered in one frame")

    monkeypatch.setattr(state.pd, "concat", never)
    monkeypatch.setattr(state, "PIECE", 100)
    rows = [{"t": (k * 7919 % 1000) * 10**6, "request_id": k, "fills": None if k % 7 == 0 else k % 3 > 0}
            for k in range(1000)]
    one = state.ReuseProcessor(5)
    one.init(Handle())
    pieces = [pd.DataFrame(rows[k : k + 30]) for k in range(0, 1000, 30)]
    got = list(one.handleInputRows(("a",), iter(pieces), None))
    until, want = -1, {}
    for r in sorted(rows, key=lambda r: (r["t"], r["request_id"])):
        want[r["request_id"]] = "HIT" if r["t"] < until else "MISS"
        if r["fills"] and r["t"] >= until:
            until = r["t"] + 5 * 10**6
    assert max(map(len, got)) <= 100
    assert {i: s for f in got for i, s in zip(f["request_id"], f["cache_status"])} == want
