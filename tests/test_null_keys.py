"""Rows with null keys or times are rows like any other, on every path and at every size."""

from __future__ import annotations

import datetime
import decimal

import pytest

from tidemark.functions import ordered
from tidemark.functions.percentiles import large_groups
from tidemark.operators import quality as Q
from tidemark.operators import rollups as R
from tidemark.plans import maintenance as M

SCHEMA = (
    "id long, device_id string, ts timestamp, reading_type string, value decimal(10,2), "
    "unit string, metadata string"
)


def reading(i, device, day, kind, value):
    ts = day and datetime.datetime(2024, 1, day, 1, i % 60)
    return (i, device, ts, kind, None if value is None else decimal.Decimal(value), "u", "{}")


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for i in range(40):
        out.append(reading(i, [None, "a"][i % 2], 1 + i % 3, [None, "t"][i // 2 % 2], i))
    return spark.createDataFrame(out, SCHEMA)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_daily_is_one_semantics(rows):
    unmeasured = table(R.daily_rollup(rows))
    large = large_groups(R.daily_keys(rows), R.DAILY_KEY, 3)
    assert large.count() > 0
    assert table(R.daily_rollup(rows, large)) == unmeasured
    assert table(R.daily_rollup(rows, R.large_daily_groups(rows))) == unmeasured
    assert table(R.large_daily_groups(rows, 3)) == table(large)
    assert R.large_daily_groups(rows, 40).count() == 0
    assert all(r[-3] is not None for r in unmeasured)


def test_ordered_functions_keep_every_row(spark, rows):
    odd = spark.createDataFrame([reading(100, "a", None, "t", 1), reading(101, None, None, None, 2)], SCHEMA)
    every = rows.unionByName(odd)
    keys, order = ["device_id", "reading_type"], ["ts", "id"]
    assert ordered.previous(every, keys, order, ["id"]).count() == 42
    assert ordered.running_max(every, keys, order, every["value"], "top").count() == 42
    assert ordered.gap_islands(every, keys, order, 60).count() == 42
    had = ordered.previous(rows, keys, order, ["id"]).where("_prev is null").count()
    assert had == 4  # one first row a series


def test_quality_average(spark):
    rows = [reading(1, "a", 1, None, 4), reading(2, "a", 1, "t", 5), reading(3, "a", 1, "t", None)]
    got = Q.quality_summary(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got["null_values"], got["avg_value"]) == (2, 4.5)
    none = spark.createDataFrame([reading(1, "a", 1, None, None)], SCHEMA)
    assert Q.quality_summary(none).first()["avg_value"] is None


def test_refresh_drops_emptied_dates(spark, rows, folder):
    path = f"{folder}/hourly"
    M.write_rollup_by_date(R.hourly_rollup(rows), "hour", path)
    left = rows.where("day(ts) <> 2")
    M.refresh_recent_dates(left, path, "hourly", "2024-01-03 12:00:00", 5)
    got = M.read_rollup_by_date(spark, path)
    want = R.hourly_rollup(left)
    assert table(got.select(*want.columns)) == table(want)
