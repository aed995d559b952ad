"""Loads, physical layout, publishing and refresh."""

from __future__ import annotations

import datetime
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import attributes as J
from tidemark.operators import quality as Q
from tidemark.operators import rollups as R
from tidemark.operators.aggregates import concentration, device_count, device_count_approx, device_count_sampled
from tidemark.operators.filters import between_ts, by_device
from tidemark.plans import maintenance as M
from tidemark.plans.stats import stats
from tidemark.sources import layout as Y
from tidemark.sources import synth
from tidemark.sources.csv import load_csv
from tidemark.sources.readings import read_layout

READ = "id bigint, device_id string, ts timestamp, reading_type string, value decimal(10,2), unit string, metadata string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_synthetic_readings(spark):
    made = synth.synth_readings(spark, 60_000, 5_000, 90, seed=3, partitions=4).cache()
    again = synth.synth_readings(spark, 60_000, 5_000, 90, seed=3, partitions=4)
    assert made.exceptAll(again).isEmpty()
    for kind, (low, span) in zip(synth.TYPES, synth.RANGES):
        r = made.where(F.col("reading_type") == kind).agg(F.min("value"), F.max("value"), F.count("*")).first()
        assert low <= r[0] and r[1] <= low + span and 18_000 < r[2] < 22_000
    hot = made.where("device_id < 'sensor-001000'").count() / 60_000
    assert abs(hot - (0.3 + 0.7 * 0.2)) < 0.02
    span = made.agg(F.min("ts"), F.max("ts")).first()
    assert span[1] - span[0] <= datetime.timedelta(days=90)
    assert Q.check_readings(made)[1].isEmpty()


def test_concentration_of_synthetic_readings(spark):
    """100,000 devices: the busiest one percent, the hot ones, get 0.3 + 0.7 / 100 of the rows."""
    made = synth.synth_readings(spark, 1_000_000, 100_000, partitions=8)
    share = {r["percent"]: r["share"] for r in concentration(made).collect()}
    assert abs(share[1] - 0.307) < 0.01


def test_sampled_and_approximate_device_counts(spark):
    made = synth.synth_readings(spark, 50_000, 3_000, partitions=4)
    exact = device_count(made).first()[0]
    assert device_count_sampled(made, 5).first()[0] <= exact
    assert abs(device_count_approx(made).first()[0] - exact) <= 0.06 * exact


def test_attributes(spark):
    docs = synth.synth_metadata(synth.synth_readings(spark, 2_000, 10, partitions=2), 5)
    r = docs.select(
        F.get_json_object("metadata", "$.firmware_version").alias("f"),
        F.get_json_object("metadata", "$.battery_level").cast("int").alias("b"),
        F.get_json_object("metadata", "$.location.building").alias("l"),
    )
    assert r.where(r"not f rlike '^2\\.([1-9]|10)\\.0$' or b not between 1 and 100 or not l rlike '^Building [A-G]$'").isEmpty()


def test_json_edges(spark):
    docs = ['{"battery_level":"low"}', '{"battery_level":null}', "{}", '{"battery_level":7}', '{"battery_level":"19.5"}']
    df = spark.createDataFrame([(i, "d", m) for i, m in enumerate(docs)], "id int, device_id string, metadata string")
    assert [r["id"] for r in J.json_num_lt(df, "battery_level", 20).collect()] == [3, 4]
    assert [r["id"] for r in J.json_has(df, "battery_level").collect()] == [0, 1, 3, 4]
    assert J.json_eq(df, "location.building", "A").isEmpty()
    kept = '{"a":1,"n":{"x":[1,2]},"b":true,"z":null}'
    one = spark.createDataFrame([("d", kept), ("e", kept)], "device_id string, metadata string")
    got = {r[0]: r[1] for r in J.merge_metadata(one, "d", '{"b":"new","c":2.5}').collect()}
    import json

    assert got["e"] == kept
    assert json.loads(got["d"]) == {"a": 1, "n": {"x": [1, 2]}, "z": None, "b": "new", "c": 2.5}


def test_quarantine(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [
        (1, "d", t, "temperature", Decimal("1.00"), "C", "{}"),
        (2, "d", t, "voltage", Decimal("1.00"), "V", "{}"),
        (3, "d" * 51, t, "humidity", Decimal("1.00"), None, "{}"),
        (4, "d" * 50, t, "humidity", None, "u" * 21, None),
    ]
    good, bad = Q.check_readings(spark.createDataFrame(rows, READ))
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["violations"] for r in bad.collect()} == {
        2: ["type_unknown"],
        3: ["device_length", "unit_null"],
        4: ["value_null", "unit_length", "metadata_null"],
    }


def test_csv_ids_and_corrupt_lines(spark, folder):
    for part in range(3):
        with open(os.path.join(folder, f"{part}.csv"), "w") as f:
            for i in range(100):
                f.write(f'sensor-{part},2024-01-01 00:00:{i % 60:02d},temperature,{i}.5,"°C"\n')
            f.write("sensor-9,yesterday,temperature,1,C\n")
    loaded, bad = load_csv(spark, folder, start_id=500)
    ids = sorted(r["id"] for r in loaded.collect())
    assert len(set(ids)) == 300 and ids[0] == 500 and ids[-1] <= 500 + 302
    assert bad.count() == 3
    first = loaded.where("device_id = 'sensor-1'").orderBy("id").first()
    assert (first["value"], first["unit"], first["metadata"]) == (Decimal("0.50"), "°C", "{}")


def test_layout_prunes_and_keeps_a_hot_device_apart(spark, folder):
    made = synth.synth_readings(spark, 40_000, 50, 90, partitions=4).withColumn(
        "device_id", F.when(F.col("id") % 3 == 0, "sensor-000001").otherwise(F.col("device_id"))
    )
    Y.write_layout(made, folder + "/t", partitions=12)
    stored = read_layout(spark, folder + "/t")
    ranged = between_ts(by_device(stored, "sensor-000001"), "2023-12-05 00:00:00", "2023-12-20 00:00:00")
    text = plan(ranged)
    assert "PartitionFilters: [isnotnull(month" in text
    assert "EqualTo(device_id,sensor-000001)" in text and "GreaterThanOrEqual(ts" in text
    assert all("month=2023-12-01" in f for f in ranged.inputFiles()) or "month" in text
    assert ranged.count() == between_ts(by_device(made, "sensor-000001"), "2023-12-05 00:00:00", "2023-12-20 00:00:00").count()
    files = stored.where("device_id = 'sensor-000001'").select(F.input_file_name()).distinct().count()
    assert files > 4


def test_retention(spark, folder):
    made = synth.synth_readings(spark, 5_000, 50, 400, partitions=2, end_ts="2024-06-15 00:00:00")
    path = folder + "/t"
    Y.write_layout(made, path, partitions=4)
    want = Y.kept_months(read_layout(spark, path), "2024-06-10 00:00:00", 3).count()
    dropped = Y.drop_expired(spark, path, "2024-06-10 00:00:00", 3)
    assert max(dropped) == "2024-02-01"
    assert read_layout(spark, path).count() == want


def test_publish_keeps_the_old_version_until_the_new_one_is_whole(spark, folder):
    df = synth.synth_readings(spark, 3_000, 20, 10, partitions=2)
    path = folder + "/hourly"
    Y.publish_rollup(R.hourly_rollup(df.where("reading_type = 'humidity'")), path, view="hourly_now")
    before = Y.read_rollup(spark, path)
    n = before.count()
    os.makedirs(path + "/version=0000000002/_temporary")  # a refresh that died
    assert Y.read_rollup(spark, path).count() == n
    Y.publish_rollup(R.hourly_rollup(df), path, view="hourly_now")
    assert Y.read_rollup(spark, path).count() == R.hourly_rollup(df).count() > n
    assert spark.table("hourly_now").count() == R.hourly_rollup(df).count()
    assert before.count() == n  # still readable
    with pytest.raises(ValueError):
        Y.read_rollup(spark, folder + "/nothing")


@pytest.mark.parametrize("kind", ["hourly", "daily"])
def test_incremental_refresh_equals_full(spark, folder, kind):
    df = synth.synth_readings(spark, 8_000, 20, 20, partitions=2, end_ts="2024-01-31 12:34:56").cache()
    late = F.col("ts") >= F.lit("2024-01-27 03:04:05").cast("timestamp")
    old = M.build(kind, df.where(~late))
    refresh = M.refresh_hourly if kind == "hourly" else M.refresh_daily
    new = refresh(old, df, "2024-01-31 12:34:56", 6)
    assert M.rollup_diff(M.build(kind, df), new, kind).isEmpty()
    path = folder + "/dates"
    M.write_rollup_by_date(old, M.BUCKET[kind], path)
    M.refresh_recent_dates(df, path, kind, "2024-01-31 12:34:56", 6)
    assert M.rollup_diff(M.build(kind, df), M.read_rollup_by_date(spark, path), kind).isEmpty()
    # Rows older than the look-back do not reach their bucket.
    stale = refresh(M.build(kind, df.where("id > 4000")), df, "2024-01-31 12:34:56", 6)
    assert not M.rollup_diff(M.build(kind, df), stale, kind).isEmpty()


def test_stats_period(spark):
    with pytest.raises(ValueError, match="INVALID_PERIOD"):
        stats({}, "week")


def test_copy_by_month(spark, folder):
    df = synth.synth_readings(spark, 2_000, 20, 100, partitions=2)
    df.write.parquet(folder + "/src")
    copied = Y.repartition_by_month(spark, folder + "/src", folder + "/dst")
    assert copied.select("month").distinct().count() >= 4
    assert bool(Q.reconcile(df, copied).first()["matches"])
