"""Synthetic readings and attributes, generated where they are needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import use_utc
from tidemark.spec import READING_COLUMNS

# The generated types, their units and value ranges, and the hot share.
TYPES = ("temperature", "humidity", "pressure")
UNITS = ("°C", "%", "hPa")
RANGES = ((-20, 60), (0, 100), (950, 100))
HOT_SHARE = 0.3
HOT_DEVICES = 1000


def synth_readings(
    spark: SparkSession,
    rows: int,
    devices: int = 100_000,
    days: int = 90,
    seed: int = 42,
    end_ts: str = "2024-01-31 00:00:00",
    partitions: int | None = None,
) -> DataFrame:
    """``rows`` readings; the same seed and partition count repeat the same rows."""
    use_utc(spark)
    hot = F.rand(seed) < HOT_SHARE
    index = F.floor(F.rand(seed + 1) * F.when(hot, min(HOT_DEVICES, devices)).otherwise(devices))
    base = spark.range(0, rows, 1, partitions).select(
        (F.col("id") + 1).alias("id"),
        index.alias("_device"),
        F.floor(F.rand(seed + 2) * (days * 86400 + 1)).alias("_back"),
        F.floor(F.rand(seed + 3) * len(TYPES)).cast("int").alias("_kind"),
        F.rand(seed + 4).alias("_draw"),
    )
    value = None
    for i, (low, span) in enumerate(RANGES):
        drawn = F.lit(low) + F.col("_draw") * span
        value = F.when(F.col("_kind") == i, drawn) if value is None else value.when(
            F.col("_kind") == i, drawn
        )
    end = F.unix_seconds(F.lit(end_ts).cast("timestamp"))
    return base.select(
        "id",
        F.format_string("sensor-%06d", "_device").alias("device_id"),
        F.timestamp_seconds(end - F.col("_back")).alias("ts"),
        _pick(TYPES).alias("reading_type"),
        F.round(value, 2).cast("decimal(10,2)").alias("value"),
        _pick(UNITS).alias("unit"),
        F.lit("{}").alias("metadata"),
    ).select(*READING_COLUMNS)


def _pick(names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_kind") + 1)


def attributes_json(seed: int) -> Column:
    """A random attribute document: firmware, battery and building."""
    firmware = F.concat(F.lit("2."), F.floor(F.rand(seed) * 10 + 1).cast("string"), F.lit(".0"))
    battery = F.floor(F.rand(seed + 1) * 100 + 1).cast("int")
    building = F.concat(F.lit("Building "), F.chr(65 + F.floor(F.rand(seed + 2) * 7)))
    return F.to_json(
        F.struct(
            firmware.alias("firmware_version"),
            battery.alias("battery_level"),
            F.struct(building.alias("building")).alias("location"),
        )
    )


def synth_metadata(df: DataFrame, seed: int = 42) -> DataFrame:
    return df.withColumn("metadata", attributes_json(seed))
