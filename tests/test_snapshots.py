"""Versioned tables: pinned readers, conflicts, pruning, compaction and collection."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import paths
from tidemark.sources.snapshots import Conflict, Snapshots, along_curve, curve_place, cuts_of


def readings(spark, first, n):
    return spark.range(first, first + n).select(
        F.col("id"),
        F.format_string("d%03d", F.col("id") * 7 % 50).alias("device_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600).alias("ts"),
        (F.col("id") % 9).cast("decimal(10,2)").alias("value"),
    ).withColumn("month", F.trunc("ts", "month"))


@pytest.fixture
def table(spark, folder):
    return Snapshots(spark, folder, "month", ["device_id", "ts", "id"], curve=["device_id", "ts", "id"])


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def opened(df):
    return len(df.inputFiles())


def test_appends_and_pinned_readers(spark, table):
    assert table.newest() == 0
    first = table.append(readings(spark, 0, 1000))
    pinned = table.read()
    table.append(readings(spark, 1000, 500))
    table.append(readings(spark, 1500, 10))
    assert table.versions() == [1, 2, 3] and ids(pinned) == list(range(1000))
    assert ids(table.read()) == list(range(1510)) and ids(table.read(first)) == list(range(1000))
    assert table.read().schema.names == readings(spark, 0, 1).schema.names
    manifest = table.manifest().collect()
    assert sum(r["rows"] for r in manifest) == 1510
    for r in manifest:
        assert r["low"]["id"] <= r["high"]["id"] and r["bytes"] > 0
        assert r["part"].day == 1


def test_a_lookup_opens_only_what_the_manifest_names(spark, table):
    for k in range(8):
        table.append(readings(spark, 1000 * k, 1000))
    every = opened(table.read())
    wanted = spark.createDataFrame([(17,), (1018,), (None,), (99_999,)], "id long")
    found = table.holding(wanted, "id")
    named = table.manifest().where(
        "(17 BETWEEN low.id AND high.id) OR (1018 BETWEEN low.id AND high.id)"
    ).count()
    assert opened(found) == named < every
    assert {17, 1018} <= set(ids(found))
    day = [datetime.datetime(2024, 3, 1), datetime.datetime(2024, 3, 2)]
    rows = table.read(device_id=("d010", "d012"), ts=tuple(day))
    assert opened(rows) < every / 2
    want = table.read().where(F.col("device_id").between("d010", "d012") & F.col("ts").between(*day))
    assert ids(rows) == ids(want)
    assert table.read(id=(10**9, None)).count() == 0


def test_curve_clusters_every_column(spark, folder):
    """Files of a curve are narrow in device and in time; sorted files are narrow in one."""
    table = Snapshots(spark, folder, "lot", ["device_id", "ts"], curve=["device_id", "ts"], slices=8)
    rows = spark.range(40_000).select(
        F.lit(1).alias("lot"), F.format_string("d%03d", F.col("id") * 7919 % 500).alias("device_id"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
    )
    table.append(rows)
    files = table.manifest().count()
    assert files >= 4
    for bounds in ({"device_id": ("d100", "d101")}, {"ts": tuple(
        datetime.datetime.fromtimestamp(x, datetime.timezone.utc) for x in (100, 200))}):
        assert opened(table.read(**bounds)) <= 0.75 * files


def test_curve_places(spark):
    got = spark.range(64).select(
        curve_place([F.col("id") % 8, F.floor(F.col("id") / 8)], 3).alias("p"), "id"
    ).collect()
    assert sorted(r["p"] for r in got) == list(range(64))
    for r in got:
        a, b = r["id"] % 8, r["id"] // 8
        assert r["p"] == sum(((a >> i & 1) << 2 * i) | ((b >> i & 1) << 2 * i + 1) for i in range(3))


def test_compaction(spark, table):
    for k in range(5):
        table.append(readings(spark, 100 * k, 100))
    before, version = table.manifest().count(), table.newest()
    assert table.compact() == version + 1
    assert table.manifest().count() < before and ids(table.read()) == list(range(500))
    assert ids(table.read(version)) == list(range(500))
    assert table.compact(small=1) == version + 1  # no file is that small


def test_one_of_two_writers_wins(spark, table):
    table.append(readings(spark, 0, 10))
    table.commit(add=readings(spark, 10, 10), base=1)
    with pytest.raises(Conflict):
        table.commit(add=readings(spark, 20, 10), base=1)
    assert ids(table.read()) == list(range(20))


def test_replaced_parts_and_collection(spark, table):
    table.append(readings(spark, 0, 2000))
    march = datetime.date(2024, 3, 1)
    old = table.read()
    version = table.replace(
        readings(spark, 5000, 5).withColumn("month", F.lit(march)), F.col("part") == F.lit(march)
    )
    left = readings(spark, 0, 2000).where(F.col("month") != F.lit(march))
    assert ids(table.read()) == sorted(ids(left) + list(range(5000, 5005)))
    assert ids(old) == list(range(2000))
    assert table.collect(keep=1) == 0  # too young
    assert table.collect(keep=1, older_than=-5) > 0
    assert table.versions() == [version]
    assert ids(table.read()) == sorted(ids(left) + list(range(5000, 5005)))


def test_a_half_written_entry_is_no_version(spark, table, folder):
    table.append(readings(spark, 0, 10))
    paths.create_text(spark, f"{folder}/log/{2:010d}.json", "")
    assert table.newest() == 1 and table.read().count() == 10
    assert not paths.create_text(spark, f"{folder}/log/{1:010d}.json", "x")


def test_empty_appends(spark, table):
    table.append(readings(spark, 0, 0))
    assert table.read().count() == 0
    table.append(readings(spark, 0, 3))
    table.append(readings(spark, 3, 0))
    assert table.read().count() == 3
    no_rows = spark.createDataFrame([], "id long")
    assert table.holding(no_rows, "id").count() == 0


def test_refresh_by_date(spark, sf, folder):
    """Dates of the look-back are replaced in one step, emptied ones too."""
    from tidemark.catalog.tables import AS_OF, events
    from tidemark.operators import rollups as R
    from tidemark.plans import maintenance as M

    df = events(spark, sf)
    table = Snapshots(spark, folder, "bucket_date", ["device_id", "hour"])
    M.refresh_snapshot(table, R.hourly_rollup(df), "hour")
    gone = F.to_date("ts") == F.lit("2024-01-26").cast("date")
    M.refresh_recent_snapshot(table, df.where(~gone), "hourly", AS_OF, 7)
    want = R.hourly_rollup(df.where(~gone))
    assert M.rollup_diff(want, table.read().drop("bucket_date"), "hourly").count() == 0


def test_a_large_part_is_written_side_by_side(spark, folder):
    table = Snapshots(spark, f"{folder}/one-part", "month", ["id"])
    rows = spark.range(600_000).select("id", F.xxhash64("id").alias("v"), F.lit("2024-01").alias("month"))
    table.append(rows)
    files = table.manifest().collect()
    assert len(files) >= 3 and sum(f["rows"] for f in files) == 600_000
    assert {f["part"] for f in files} == {"2024-01"} and min(f["low"]["id"] for f in files) == 0


def test_places_by_halving_equal_counted_cuts(spark):
    df = spark.range(900).select(
        "id", F.format_string("d%04d", F.col("id") * 7 % 900).alias("d"),
        F.when(F.col("id") % 10 > 0, F.col("id") % 5).alias("few"),
    )
    columns = ["id", "d", "few"]
    cuts = cuts_of(df, columns, 4)
    assert len(cuts["id"]) == len(cuts["d"]) == 15 and cuts["few"] == [0, 1, 2, 3, 4]
    for r in along_curve(df, columns, 4).collect():
        at = [0 if r[c] is None else sum(cut <= r[c] for cut in cuts[c]) for c in columns]
        assert r["_place"] == sum((at[k] >> b & 1) << (3 * b + k) for b in range(4) for k in range(3))
