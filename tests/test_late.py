"""Late rows of a continuous rollup: set aside, then merged, whatever order they came in."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rollups as R
from tidemark.plans.maintenance import rollup_diff
from tidemark.plans.partials import PartialStore
from tidemark.spec import ReadingsSpec
from tidemark.streaming import late as L
from tidemark.streaming.rollups import stream_readings

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
READ = "id bigint, device_id string, ts timestamp, reading_type string, value decimal(10,2), unit string, metadata string"
SPEC = ReadingsSpec(("id",), "device_id", "ts", "value", "reading_type", "unit", "metadata")
DAY = 86400


def readings(spark, times, start=0):
    rows = [
        (start + i, f"d{i % 3}", T0 + datetime.timedelta(seconds=t), "t", Decimal(i * 37 % 101), "u", "{}")
        for i, t in enumerate(times)
    ]
    return spark.createDataFrame(rows, READ).coalesce(1)


@pytest.fixture
def job(spark, folder):
    store, late = PartialStore(spark, f"{folder}/store", 10, 2), L.late_table(spark, f"{folder}/late")

    def arrive(rows):
        rows.write.mode("append").parquet(f"{folder}/src")
        stream = stream_readings(spark, f"{folder}/src", SPEC)
        L.continuous_partials(stream, store, late, f"{folder}/checkpoint", 2).awaitTermination()

    return store, late, arrive


def test_late_rows_are_set_aside_and_corrected(spark, job):
    store, late, arrive = job
    first = readings(spark, [10, 20, 3700, 8 * DAY, 8 * DAY + 10])
    second = readings(spark, [7 * DAY, 30, 5 * DAY, 20 * DAY], 100)  # two of them behind 6 days
    third = readings(spark, [40, 20 * DAY + 5, 18 * DAY - 7200], 200)
    arrive(first)
    assert late.read().count() == 0
    arrive(second)
    assert {r["id"] for r in late.read().collect()} == {101, 102}
    kept = first.unionByName(second.where("id NOT IN (101, 102)"))
    assert rollup_diff(R.hourly_rollup(kept), store.hourly(), "hourly").isEmpty()
    assert L.correct(store, late) == late.newest()
    every = first.unionByName(second)
    assert rollup_diff(R.hourly_rollup(every), store.hourly(), "hourly").isEmpty()
    arrive(third)
    assert {r["id"] for r in late.read().collect()} == {101, 102, 200, 202}
    L.correct(store, late)
    L.correct(store, late)  # nothing is merged twice
    every = every.unionByName(third)
    assert rollup_diff(R.hourly_rollup(every), store.hourly(), "hourly").isEmpty()
    assert rollup_diff(R.daily_rollup(every), store.daily(), "daily").isEmpty()


def test_disorder_of_any_kind(spark, job):
    store, late, arrive = job
    rng, every = random.Random(3), None
    for k in range(4):
        rows = readings(spark, [rng.randint(0, 12 * DAY) for _ in range(60)], 1000 * k)
        arrive(rows)
        every = rows if every is None else every.unionByName(rows)
    assert late.read().count() > 20
    L.correct(store, late)
    assert rollup_diff(R.hourly_rollup(every), store.hourly(), "hourly").isEmpty()
    assert rollup_diff(R.daily_rollup(every), store.daily(), "daily").isEmpty()


def test_a_batch_cut_off_is_repeated_in_full(spark, job, monkeypatch):
    """A batch that failed between two tables ends with every row once."""
    store, late, arrive = job
    arrive(readings(spark, [10, 8 * DAY]))
    rows = readings(spark, [30, 8 * DAY + 5, 9 * DAY], 100)
    real = type(store.hours).append

    def failing(self, df, mark=None):
        if self.path == store.hours.path:
            raise OSError("lost")
        return real(self, df, mark)

    monkeypatch.setattr(type(store.hours), "append", failing)
    with pytest.raises(Exception, match="lost"):
        arrive(rows)
    monkeypatch.undo()
    arrive(readings(spark, [9 * DAY + 1], 200))
    assert late.read().count() == 1 and store.hours.read().agg(F.sum("rows")).first()[0] == 5
    assert store.values.read().agg(F.sum("rows")).first()[0] == 5
    L.correct(store, late)
    assert store.hours.read().agg(F.sum("rows")).first()[0] == 6


def test_a_batch_does_not_scan_the_store(spark, job):
    """What is stored is gone but for its manifest, and the next batch goes through."""
    from tidemark.sources.paths import drop_folder, folders

    store, late, arrive = job
    arrive(readings(spark, [10, 8 * DAY]))
    for table in (store.values, store.hours):
        for name in folders(spark, f"{table.path}/data"):
            drop_folder(spark, f"{table.path}/data/{name}")
    arrive(readings(spark, [20, 9 * DAY], 100))
    assert late.read().count() == 1 and store.values.newest() == store.hours.newest() == 2
