"""Counts, distributions and rankings over readings and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import BROADCAST_ROWS, beside
from tidemark.functions.numbers import from_units, mean_units, power_sums, units
from tidemark.functions.percentiles import exact_percentiles
from tidemark.operators.filters import ago, between_ts, by_device, moment


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def device_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("device_id").alias("device_count"))


def device_count_sampled(df: DataFrame, percent: float = 0.5, seed: int = 42) -> DataFrame:
    """Devices seen in a row sample: a lower bound, as the sampling is the feature."""
    return device_count(df.sample(fraction=percent / 100, seed=seed))


def device_count_approx(df: DataFrame, error: float = 0.02) -> DataFrame:
    return df.agg(F.approx_count_distinct("device_id", error).alias("device_count"))


def total_from_rollup(global_rollup: DataFrame) -> DataFrame:
    return global_rollup.agg(
        F.coalesce(F.sum("total_readings"), F.lit(0).cast("bigint")).alias("total_readings")
    )


def devices_upper_bound(global_rollup: DataFrame) -> DataFrame:
    """Sum over types: counts a device once per type it reports."""
    return global_rollup.agg(
        F.coalesce(F.sum("active_devices"), F.lit(0).cast("bigint")).alias("total_devices")
    )


def service_stats(global_rollup: DataFrame, readings: DataFrame, sample_percent: float | None = None) -> DataFrame:
    """One row: readings from the rollup, devices exact or from a sample."""
    devices = (
        device_count_sampled(readings, sample_percent) if sample_percent else device_count(readings)
    )
    return beside(
        total_from_rollup(global_rollup), devices.withColumnRenamed("device_count", "total_devices")
    )


def device_hourly_avg(df: DataFrame, device_id: str, as_of: str, hours: int = 24) -> DataFrame:
    rows = between_ts(by_device(df, device_id), frm=ago(as_of, hours, "hour"))
    return _averages(rows.withColumn("hour", F.date_trunc("hour", "ts")), ["hour"]).select(
        "hour", "avg_value"
    )


def daily_avg_recent(df: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per day, device and type over the last whole days, newest day first.

    The bound is on the time itself rather than on its day, so it reaches the scan.
    """
    start = F.date_trunc("day", moment(as_of)) - F.make_dt_interval(F.lit(days))
    rows = between_ts(df, frm=start).withColumn("day", F.date_trunc("day", "ts"))
    return _averages(rows, ["day", "device_id", "reading_type"]).orderBy(
        F.desc("day"), "device_id", "reading_type"
    )


def _averages(df: DataFrame, keys: list[str]) -> DataFrame:
    scale = df.schema["value"].dataType.scale
    sums = df.groupBy(*keys).agg(*power_sums(units(F.col("value"), scale))[:2])
    return sums.select(
        *keys,
        from_units(mean_units(F.col("n"), F.col("s"), 10 ** (scale - 2))).alias("avg_value"),
        F.col("n").alias("reading_count"),
    )


def per_device(df: DataFrame) -> DataFrame:
    return df.groupBy("device_id").agg(F.count(F.lit(1)).alias("reading_count"))


def reads_per_device_dist(df: DataFrame) -> DataFrame:
    """Percentiles and extremes of rows per device.

    Devices are counted per row count first: n rows in all have at most about sqrt(2n)
    different counts, so nothing is ordered per device.
    """
    counts = per_device(df)
    sums = counts.agg(
        F.max("reading_count").alias("max_reads"),
        F.min("reading_count").alias("min_reads"),
        F.sum("reading_count").alias("_s"),
        F.count(F.lit(1)).alias("_n"),
    )
    ranks = exact_percentiles(counts, [], F.col("reading_count"), [50, 95, 99])
    return beside(ranks, sums).select(
        *[(F.col(f"p{p}_x100") / 100).alias(f"p{p}_reads") for p in (50, 95, 99)],
        "max_reads",
        "min_reads",
        (F.col("_s") / F.col("_n")).alias("avg_reads"),
    )


def top_devices(df: DataFrame, k: int = 10) -> DataFrame:
    return per_device(df).orderBy(F.desc("reading_count"), "device_id").limit(k)


def hot_device_rows(df: DataFrame, k: int = 100) -> DataFrame:
    """Rows of the ``k`` devices with most readings; the key list is ``k`` rows long."""
    hot = top_devices(df, k).select("device_id")
    return df.join(F.broadcast(hot) if k <= BROADCAST_ROWS else hot, "device_id", "left_semi")


def time_span(df: DataFrame) -> DataFrame:
    return df.agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest")).withColumn(
        "time_span", F.col("latest") - F.col("earliest")
    )


def max_id(df: DataFrame) -> DataFrame:
    return df.agg(F.max("id").alias("max_id"))


def count_by_state(df: DataFrame, column: str, states: list[str]) -> DataFrame:
    """Total and one conditional count per state, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(column) == s).alias(s) for s in states],
    )


def concentration(df: DataFrame, percents: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Share of all rows held by the busiest ``percents`` of devices (at least one device).

    Works on the number of devices per row count, at most about sqrt(2 * rows) entries. The
    class that the boundary cuts contributes as many devices as are still wanted.
    """
    classes = per_device(df).groupBy("reading_count").agg(F.count(F.lit(1)).alias("devices"))
    whole = Window.partitionBy(F.lit(0))
    busier = whole.orderBy(F.desc("reading_count")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = classes.select(
        "reading_count",
        "devices",
        F.coalesce(F.sum("devices").over(busier), F.lit(0)).alias("_before"),
        F.sum("devices").over(whole).alias("_devices"),
        F.sum(F.col("devices") * F.col("reading_count")).over(whole).alias("_rows"),
    )
    ranked = ranked.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    wanted = F.call_function("div", F.col("_devices") * F.col("percent") + 99, F.lit(100))
    taken = F.greatest(F.lit(0), F.least(F.col("devices"), wanted - F.col("_before")))
    return (
        ranked.groupBy("percent")
        .agg(
            F.sum(taken).alias("devices"),
            F.sum(taken * F.col("reading_count")).alias("reading_count"),
            F.max("_rows").alias("_rows"),
        )
        .select(
            "percent", "devices", "reading_count", (F.col("reading_count") / F.col("_rows")).alias("share")
        )
    )


def rollup_recent(
    rollup: DataFrame, bucket: str, device_id: str, as_of: str, n: int, unit: str, limit: int | None = None
) -> DataFrame:
    """A device's rollup rows of the last ``n`` units, newest bucket first."""
    rows = by_device(rollup, device_id).where(F.col(bucket) >= ago(as_of, n, unit))
    ordered = rows.orderBy(F.desc(bucket), "reading_type")
    return ordered.limit(limit) if limit else ordered
