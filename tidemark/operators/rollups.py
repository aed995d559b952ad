"""Hourly, daily and global rollups and the statistics tables built like them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.joins import BROADCAST_ROWS, on_same
from tidemark.functions.numbers import (
    from_units,
    mean_units,
    power_sums,
    round_div,
    spread,
    stddev_units,
    units,
)
from tidemark.functions.percentiles import (
    SMALL_GROUP,
    exact_percentiles,
    interpolated,
    large_groups,
    rank_picks,
    ranked,
)

HOURLY_KEY = ["device_id", "hour", "reading_type"]
DAILY_KEY = ["device_id", "day", "reading_type"]
GLOBAL_KEY = ["reading_type"]
PERCENTS = {50: "median_value", 95: "p95_value", 99: "p99_value"}


def decimal_type(df: DataFrame) -> tuple[int, int]:
    t = df.schema["value"].dataType
    return t.precision, t.scale


def _drop(scale: int) -> int:
    if scale < 2:
        raise ValueError("value needs at least two decimal places")
    return 10 ** (scale - 2)


def finish(
    sums: DataFrame, keys: list[str], names: tuple[str, ...], kept: list[str], scale: int
) -> DataFrame:
    """Rounded statistics from n, s, ss and the extremes of each key."""
    count, avg, low, high, dev = names
    n, s, ss, drop = F.col("n"), F.col("s"), F.col("ss"), _drop(scale)
    return sums.select(
        *keys,
        F.col("_rows").alias(count),
        *kept,
        from_units(mean_units(n, s, drop)).alias(avg),
        F.round("_min", 2).alias(low),
        F.round("_max", 2).alias(high),
        from_units(stddev_units(n, s, ss, drop)).alias(dev),
        "first_reading",
        "last_reading",
    )


def _grouped(df: DataFrame, keys: list[str], names: tuple[str, ...], extra: dict[str, Column]) -> DataFrame:
    _, scale = decimal_type(df)
    sums = df.groupBy(*keys).agg(
        *power_sums(units(F.col("value"), scale)),
        F.count(F.lit(1)).alias("_rows"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
        F.min("ts").alias("first_reading"),
        F.max("ts").alias("last_reading"),
        *[c.alias(name) for name, c in extra.items()],
    )
    return finish(sums, keys, names, list(extra), scale)


STAT_NAMES = ("reading_count", "avg_value", "min_value", "max_value", "stddev_value")


def hourly_rollup(df: DataFrame, keep_sum: bool = False) -> DataFrame:
    """Count, average, extremes, deviation and time span per device, hour and type.

    ``keep_sum`` adds ``sum_value``, from which coarser averages stay exact.
    """
    hourly = df.withColumn("hour", F.date_trunc("hour", "ts"))
    extra = {"sum_value": F.sum("value")} if keep_sum else {}
    return _grouped(hourly, HOURLY_KEY, STAT_NAMES, extra)


def hourly_by_window(df: DataFrame) -> DataFrame:
    """The hourly rollup grouped by a time window, as a stream with a watermark needs it."""
    opened = df.withColumn("_w", F.window("ts", "1 hour"))
    grouped = _grouped(opened, ["device_id", "_w", "reading_type"], STAT_NAMES, {})
    return grouped.withColumn("hour", F.col("_w.start")).select(
        *HOURLY_KEY, *STAT_NAMES, "first_reading", "last_reading"
    )


def daily_rollup(df: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """Hourly columns per day plus exact interpolated percentiles, rounded to two places.

    ``large`` holds the measured large groups, ``large_daily_groups(df)``; the others are then
    ranked and aggregated with one shuffle. Without it, or when they are too many to broadcast,
    every group is treated as one that may hold a third of all rows.
    """
    daily = daily_keys(df)
    found = None if large is None else large.limit(BROADCAST_ROWS + 1).count()
    if found is None or found > BROADCAST_ROWS:
        return _daily_of_large(daily)
    if not found:
        return _daily_of_small(daily)
    listed = F.broadcast(large)
    small = _daily_of_small(on_same(daily, listed, DAILY_KEY, "left_anti"))
    return small.unionByName(_daily_of_large(on_same(daily, listed, DAILY_KEY, "left_semi")))


def _daily_of_large(daily: DataFrame) -> DataFrame:
    precision, scale = decimal_type(daily)
    value = units(F.col("value"), scale)
    ranks = exact_percentiles(daily, DAILY_KEY, value, list(PERCENTS), precision)
    stats = _grouped(daily, DAILY_KEY, STAT_NAMES, {})
    return daily_columns(on_same(stats, ranks, DAILY_KEY, "left"), scale)


def _daily_of_small(daily: DataFrame) -> DataFrame:
    _, scale = decimal_type(daily)
    rows = ranked(daily, DAILY_KEY, units(F.col("value"), scale))
    picked = _grouped(rows, DAILY_KEY, STAT_NAMES, rank_picks(list(PERCENTS)))
    return daily_columns(picked.select("*", *interpolated(list(PERCENTS))), scale)


def daily_columns(stats: DataFrame, scale: int) -> DataFrame:
    return stats.select(
        *DAILY_KEY,
        *STAT_NAMES,
        *[
            from_units(round_div(F.col(f"p{p}_x100"), 100 * _drop(scale))).alias(name)
            for p, name in PERCENTS.items()
        ],
        "first_reading",
        "last_reading",
    )


def large_daily_groups(df: DataFrame, rows: int = SMALL_GROUP) -> DataFrame:
    """Daily groups above the bound; only (day, type) pairs above it can hold one.

    Pairs are few, so their count shuffles next to nothing; devices are counted within the
    large pairs alone, or not at all.
    """
    daily = daily_keys(df)
    pair = ["day", "reading_type"]
    pairs = large_groups(daily, pair, rows)
    if pairs.isEmpty():
        return daily.select(*DAILY_KEY).limit(0)
    return large_groups(on_same(daily, pairs, pair, "left_semi"), DAILY_KEY, rows)


def daily_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_trunc("day", "ts"))


def global_rollup(df: DataFrame) -> DataFrame:
    names = ("total_readings", "global_avg", "global_min", "global_max", "global_stddev")
    return _grouped(df, GLOBAL_KEY, names, {"active_devices": F.count_distinct("device_id")})


def _plain_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unrounded statistics; the average keeps ten places, the deviation is a double."""
    _, scale = decimal_type(df)
    one = Decimal(1).scaleb(-scale)
    sums = df.groupBy(*keys).agg(
        *power_sums(units(F.col("value"), scale)),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
    n, s, ss = F.col("n"), F.col("s"), F.col("ss")
    return sums.select(
        *keys,
        n.alias("reading_count"),
        (s.cast("double") / n * float(one)).alias("avg_value"),
        "min_value",
        "max_value",
        (spread(n, s, ss) * float(one)).alias("stddev_value"),
    )


def entity_type_stats(df: DataFrame) -> DataFrame:
    return _plain_stats(df, ["device_id", "reading_type"])


def entity_stats(df: DataFrame) -> DataFrame:
    return _plain_stats(df, ["device_id"])


def weighted_avg(rollup: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Average over rollup rows, weighted by their counts, rounded to two places.

    Exact when the rollup kept its sums, otherwise as exact as its rounded averages.
    """
    total = F.sum(F.col("reading_count"))
    if "sum_value" in rollup.columns:
        scale = rollup.schema["sum_value"].dataType.scale
        weighted = F.sum((F.col("sum_value") * 10**scale).cast("decimal(38,0)"))
        drop = _drop(scale)
    else:
        average = units(F.col("avg_value"), 2).cast("decimal(19,0)")
        weighted = F.sum((average * F.col("reading_count")).cast("decimal(38,0)"))
        drop = 1
    sums = rollup.groupBy(*(keys or [])).agg(total.alias("reading_count"), weighted.alias("_w"))
    return sums.withColumn(
        "avg_value", from_units(mean_units(F.col("reading_count"), F.col("_w"), drop))
    ).drop("_w")
