"""Typed scans of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import use_utc
from tidemark.spec import READING_COLUMNS, ReadingsSpec


def read_readings(spark: SparkSession, path: str, spec: ReadingsSpec) -> DataFrame:
    """Readings of a Parquet table in canonical columns; filters on them reach the scan."""
    return as_readings(read_utc(spark, path), spec)


def read_utc(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose timestamps without a zone are read as UTC instants.

    Reading them with that type, rather than casting afterwards, lets time filters reach the
    scan.
    """
    use_utc(spark)
    return spark.read.schema(utc_schema(spark.read.parquet(path).schema)).parquet(path)


def utc_schema(stored: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, T.TimestampType(), f.nullable)
            if isinstance(f.dataType, T.TimestampNTZType)
            else f
            for f in stored.fields
        ]
    )


def as_readings(df: DataFrame, spec: ReadingsSpec) -> DataFrame:
    """Canonical columns of any table. Timestamps without a zone are taken as UTC."""
    ids = [F.expr(e) for e in spec.id]
    row_id = ids[0].cast("bigint") if len(ids) == 1 else F.struct(
        *[c.alias(f"k{i}") for i, c in enumerate(ids)]
    )
    text = {
        name: F.expr(e) if e else F.lit(default)
        for name, e, default in (
            ("reading_type", spec.type, "value"),
            ("unit", spec.unit, ""),
            ("metadata", spec.metadata, "{}"),
        )
    }
    value = F.expr(spec.value) if spec.value else F.lit(1)
    return df.select(
        row_id.alias("id"),
        F.expr(spec.entity).alias("device_id"),
        F.expr(spec.ts).cast("timestamp").alias("ts"),
        text["reading_type"].alias("reading_type"),
        value.cast(f"decimal({spec.precision},{spec.scale})").alias("value"),
        text["unit"].alias("unit"),
        text["metadata"].alias("metadata"),
    )


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Readings written by ``write_layout``; keeps ``month`` for partition pruning."""
    use_utc(spark)
    return spark.read.parquet(path).select(*READING_COLUMNS, F.col("month").cast("date"))
