"""Statistics answered from the rollups by period, device and type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import by_device, by_type
from tidemark.operators.rollups import weighted_avg

COLUMNS = ["bucket", "device_id", "reading_type", "reading_count", "avg_value", "min_value", "max_value"]


def stats(
    rollups: dict[str, DataFrame],
    period: str = "hour",
    device_id: str | None = None,
    reading_type: str | None = None,
) -> DataFrame:
    """Rows of the rollup that serves the period.

    ``hour`` and ``day`` read the rollup of that name. ``all`` reads the global rollup, or, for
    one device, adds up that device's days.
    """
    if period in ("hour", "day"):
        rollup = rollups["hourly" if period == "hour" else "daily"]
        rows = by_type(by_device(rollup, device_id), reading_type)
        return rows.select(F.col(period).alias("bucket"), *COLUMNS[1:])
    if period != "all":
        raise ValueError("INVALID_PERIOD: period must be one of hour, day, all")
    if device_id:
        days = by_type(by_device(rollups["daily"], device_id), reading_type)
        keys = ["device_id", "reading_type"]
        ends = days.groupBy(*keys).agg(
            F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value")
        )
        rows = weighted_avg(days, keys).join(ends, keys)
    else:
        rows = by_type(rollups["global"], reading_type).select(
            F.lit(None).cast("string").alias("device_id"),
            "reading_type",
            F.col("total_readings").alias("reading_count"),
            F.col("global_avg").alias("avg_value"),
            F.col("global_min").alias("min_value"),
            F.col("global_max").alias("max_value"),
        )
    return rows.select(F.lit(None).cast("timestamp").alias("bucket"), *COLUMNS[1:])
