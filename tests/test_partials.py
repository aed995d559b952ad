"""Stored partials against rollups of all readings."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rollups as R
from tidemark.plans import partials as P
from tidemark.session import written
from tidemark.spec import READING_COLUMNS

START = datetime.datetime(2024, 1, 30)


def readings(spark, n=3000, seed=1, types=("a", "b", None), hot=0.4):
    """Readings over three days of two months; one group holds a large share of them."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        device = "hot" if rng.random() < hot else f"d{rng.randint(0, 20)}"
        second = rng.randint(0, 600) if device == "hot" else rng.randint(0, 3 * 86400)
        value = None if rng.random() < 0.05 else Decimal(rng.randint(-10**7, 10**7)) / 100
        if rng.random() < 0.02:
            value = Decimal(rng.choice([-1, 1]) * (10**15 - 1 - i)) / 100
        rows.append((i + 1, None if rng.random() < 0.01 else device, START + datetime.timedelta(seconds=second),
                     rng.choice(types) if device != "hot" else "a", value, "u", "{}"))
    return spark.createDataFrame(
        rows, "id long, device_id string, ts timestamp, reading_type string, value decimal(17,2), unit string, metadata string"
    ).select(*READING_COLUMNS)


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def held(spark):
    return written(readings(spark), "partial-readings")


def store_with(spark, folder, lots):
    store = P.PartialStore(spark, folder, 17, 2)
    for lot in lots:
        store.merge(lot)
    return store


@pytest.fixture(scope="module")
def store(spark, held):
    import tempfile

    lots = [held.where(F.col("id") % 3 == k) for k in range(3)]
    return store_with(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), lots)


def cut(df):
    """Extremes without their trailing digits' type."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def test_rollups_of_merged_partials(store, held):
    assert rows_of(cut(store.hourly())) == rows_of(cut(R.hourly_rollup(held)))
    assert rows_of(cut(store.daily())) == rows_of(cut(R.daily_rollup(held)))
    assert rows_of(cut(store.overall())) == rows_of(cut(R.global_rollup(held)))


def test_large_groups_are_opened_by_ranges(store, held):
    got = P.daily_of(store.values.read(), 17, 2, large_rows=40)
    assert rows_of(cut(got)) == rows_of(cut(R.daily_rollup(held)))


def test_compacting_changes_nothing(spark, store, held):
    before = rows_of(cut(store.daily())), rows_of(cut(store.hourly()))
    counts = store.values.manifest().agg(F.sum("rows")).first()[0]
    pinned = store.values.newest()
    store.compact()
    assert (rows_of(cut(store.daily())), rows_of(cut(store.hourly()))) == before
    assert store.values.manifest().agg(F.sum("rows")).first()[0] < counts
    assert store.values.read(pinned).count() == counts
    assert store.distinct_devices().first()[0] == held.select("device_id").dropna().distinct().count()


def test_days_and_periods(store, held):
    first = START + datetime.timedelta(days=1)
    some = held.where(F.col("ts") >= F.lit(first))
    assert rows_of(cut(store.daily(first=first))) == rows_of(cut(R.daily_rollup(some)))
    for a, b in ((0, 0), (1, 2), (0, 2), (7, 9)):
        days = [(START + datetime.timedelta(days=k)).date() for k in (a, b)]
        want = held.where(F.to_date("ts").between(*days)).select("device_id").dropna().distinct().count()
        assert store.distinct_devices(*days).first()[0] == want


def test_a_merge_reads_no_old_reading(spark, folder, held):
    """The readings behind the stored partials are gone when new ones arrive."""
    from tidemark.sources.paths import drop_folder

    old = folder + "/old"
    held.where("id <= 2000").write.parquet(old)
    store = P.PartialStore(spark, folder + "/store", 17, 2)
    store.merge(spark.read.parquet(old))
    drop_folder(spark, old)
    store.merge(held.where("id > 2000"))
    assert rows_of(cut(store.daily())) == rows_of(cut(R.daily_rollup(held)))
    plan = store.daily()._jdf.queryExecution().executedPlan().toString()
    assert "/old" not in plan and "values/data" in plan


def test_one_exchange_on_the_daily_key(store):
    plan = P._daily_of_small(store.values.read(), 17, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_numbers_are_unique_and_dense(spark, held):
    first = written(P.number_devices(held.where("id % 2 = 0"), None), "numbers")
    more = P.number_devices(held, first)
    numbers = [r["number"] for r in first.unionByName(more).collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))
    assert len(numbers) == held.select("device_id").dropna().distinct().count()


def test_many_devices_over_several_bitmaps(spark, folder):
    rows = spark.range(70_000).select(
        F.format_string("d%06d", F.col("id") % 50_000).alias("device_id"),
        F.timestamp_seconds(F.lit(1_706_000_000) + F.col("id") % 5 * 86400).alias("ts"),
        F.lit("t").alias("reading_type"),
    )
    store = P.PartialStore(spark, folder)
    store.merge(rows.where("device_id < 'd020000'"), ("devices",))
    store.merge(rows.where("device_id >= 'd020000'"), ("devices",))
    assert store.distinct_devices().first()[0] == 50_000
    estimate = P.estimated_devices(store.days.read()).first()[0]
    assert abs(estimate - 50_000) < 4 * 50_000 * 1.04 / 2 ** (P.SKETCH / 2)
    assert store.days.read().select("bucket").distinct().count() >= 2


def test_empty_merges(spark, folder, held):
    store = P.PartialStore(spark, folder, 17, 2)
    store.merge(held.limit(0))
    assert store.daily().count() == 0 and store.distinct_devices().first()[0] == 0
    store.merge(held)
    store.merge(held.limit(0))
    assert store.hourly().count() == R.hourly_rollup(held).count()


def test_days_are_dealt_over_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    from tidemark.plans import partials

    monkeypatch.setattr(partials, "TASK_ROWS", 100)
    rows = spark.range(2500).selectExpr(
        "concat('d', id % 50) AS device_id", "timestamp_seconds(id * 3600) AS ts", "'t' AS reading_type",
        "CAST(id AS DECIMAL(15,2)) AS value",
    )
    counted = partials.value_partials(rows)
    plan = partials._daily_of_small(counted, 15, 2)._jdf.queryExecution().toString()
    assert ", 26)" in plan and "REPARTITION_BY_NUM" in plan
