"""Exact statistics against direct computation."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions.percentiles import (
    exact_percentiles,
    interpolated,
    large_groups,
    levels_for,
    rank_picks,
    ranked,
)
from tidemark.operators import aggregates as A
from tidemark.operators import rollups as R

SCHEMA = "id bigint, device_id string, ts timestamp, reading_type string, value decimal(10,2)"


def x100(values, p):
    values = sorted(values)
    low, weight = divmod((len(values) - 1) * p, 100)
    high = min(low + 1, len(values) - 1)
    return values[low] * (100 - weight) + values[high] * weight


@pytest.mark.parametrize("precision", [10, 15])
@pytest.mark.parametrize("way", ["counted", "ranked"])
def test_percentiles_of_hot_and_small_groups(spark, precision, way):
    rng = random.Random(precision)
    top = 10**precision - 1
    rows = [("hot", rng.randint(-top, top)) for _ in range(4000)]
    rows += [("flat", 5)] * 3000 + [("two", -7), ("two", 8), ("one", top)]
    rows += [(f"k{i % 50}", rng.randint(-500, 500)) for i in range(1000)] + [("two", None)]
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    df = spark.createDataFrame(rows, "k string, v bigint")
    percents = [0, 50, 95, 99, 100]
    if way == "counted":
        out = exact_percentiles(df, ["k"], F.col("v"), percents, precision)
    else:
        picks = [c.alias(n) for n, c in rank_picks(percents).items()]
        rows = ranked(df, ["k"], F.col("v"))
        out = rows.groupBy("k").agg(*picks).select("k", *interpolated(percents))
        assert sorted(r["k"] for r in large_groups(df, ["k"], 100).collect()) == ["flat", "hot"]
    got = {r["k"]: [r[f"p{p}_x100"] for p in (0, 50, 95, 99, 100)] for r in out.collect()}
    assert got == {k: [x100(v, p) for p in (0, 50, 95, 99, 100)] for k, v in groups.items()}


def test_percentiles_without_keys(spark):
    values = [random.Random(1).randint(-(10**9), 10**9) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    row = exact_percentiles(df, [], F.col("v"), [50, 95], 10).first()
    assert [row["p50_x100"], row["p95_x100"]] == [x100(values, 50), x100(values, 95)]
    assert exact_percentiles(df.where("v is null"), [], F.col("v"), [50], 10).count() == 0


def test_levels_cover_all_digits():
    for digits in (1, 5, 10, 15, 18):
        assert 2 ** (18 * levels_for(digits)) >= 2 * 10**digits


def test_round_div_half_away_from_zero(spark):
    cases = [(5, 10), (-5, 10), (4, 10), (-4, 10), (15, 10), (-15, 10), (0, 3), (7, 2)]
    df = spark.createDataFrame(cases, "a bigint, b bigint")
    got = [r[0] for r in df.select(N.round_div(F.col("a"), F.col("b"))).collect()]
    assert got == [1, -1, 0, 0, 2, -2, 0, 4]


def test_average_is_rounded_once(spark):
    """200,001 zeros and 200,000 cents average 0.004999..., not 0.005."""
    df = spark.range(400001).select(
        F.lit(1).cast("bigint").alias("id"),
        F.lit("d").alias("device_id"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.lit("t").alias("reading_type"),
        F.when(F.col("id") < 200001, Decimal("0.00")).otherwise(Decimal("0.01")).cast("decimal(10,2)").alias("value"),
    )
    assert R.global_rollup(df).first()["global_avg"] == Decimal("0.00")


def edge_rows():
    import datetime

    t = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    hour, day = datetime.timedelta(hours=1), datetime.timedelta(days=1)
    values = ["-3.00", "0.00", "0.01", "12.34", "-0.01", "99999999.99", "-99999999.99"]
    rows = [(i, "many", t + hour / 7 * i, "t", Decimal(v)) for i, v in enumerate(values)]
    return rows + [
        (20, "one", t + hour, "t", Decimal("-1.25")),
        (21, "edge", t, "t", Decimal("1.00")),
        (22, "edge", t + hour, "t", Decimal("2.00")),
        (23, "edge", t + day, "t", Decimal("3.00")),
    ]


def test_rollups_on_edge_rows(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    hourly = {(r["device_id"], r["hour"].hour, r["hour"].day): r for r in R.hourly_rollup(df).collect()}
    assert hourly[("one", 1, 1)]["stddev_value"] is None
    assert hourly[("one", 1, 1)]["avg_value"] == Decimal("-1.25")
    assert {k for k in hourly if k[0] == "edge"} == {("edge", 0, 1), ("edge", 1, 1), ("edge", 0, 2)}
    values = [r[4] for r in edge_rows()[:7]]
    many = next(r for k, r in hourly.items() if k[0] == "many")
    mean = sum(map(Fraction, values)) / 7
    variance = sum((Fraction(v) - mean) ** 2 for v in values) / 6
    assert many["avg_value"] == Decimal(mean.numerator / mean.denominator).quantize(Decimal("0.01"), ROUND_HALF_UP)
    assert abs(float(many["stddev_value"]) - math.sqrt(variance)) < 0.006

    for large in (None, R.large_daily_groups(df)):
        daily = {(r["device_id"], r["day"].day): r for r in R.daily_rollup(df, large).collect()}
        row = daily[("many", 1)]
        for p, name in R.PERCENTS.items():
            exact = Fraction(x100([int(v * 100) for v in values], p), 10000)
            want = Decimal(exact.numerator) / Decimal(exact.denominator)
            assert row[name] == want.quantize(Decimal("0.01"), ROUND_HALF_UP)


def test_deviation_beyond_long_sums(spark):
    """Large values leave the long form; the decimal form must agree with exact arithmetic."""
    base = 9_999_999_000
    ints = [base + (i * 7919) % 1000 for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in ints], "v bigint")
    sums = df.agg(*N.power_sums(F.col("v")))
    got = sums.select(N.spread(F.col("n"), F.col("s"), F.col("ss"))).first()[0]
    mean = Fraction(sum(ints), len(ints))
    want = math.sqrt(sum((v - mean) ** 2 for v in ints) / (len(ints) - 1))
    assert got == pytest.approx(want, rel=1e-12)


def test_concentration_cuts_a_class(spark):
    rows = [(f"d{i:03d}", 10 if i < 30 else 1) for i in range(100)]
    df = spark.createDataFrame([(d,) for d, n in rows for _ in range(n)], "device_id string")
    got = {r["percent"]: (r["devices"], r["reading_count"]) for r in A.concentration(df).collect()}
    assert got == {1: (1, 10), 5: (5, 50), 20: (20, 200)}
