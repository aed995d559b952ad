"""Projections and predicates. All are plain column predicates, so they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.spec import READING_COLUMNS

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def moment(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def by_device(df: DataFrame, device_id: str | None) -> DataFrame:
    """An empty device means all devices."""
    return df.where(F.col("device_id") == device_id) if device_id else df


def by_type(df: DataFrame, reading_type: str | None) -> DataFrame:
    return df.where(F.col("reading_type") == reading_type) if reading_type else df


def between_ts(df: DataFrame, frm: str | Column | None = None, to: str | Column | None = None) -> DataFrame:
    """Both ends inclusive; a missing end is open. Prunes months when the layout has them."""
    if frm is not None:
        df = df.where(F.col("ts") >= moment(frm))
        if "month" in df.columns:
            df = df.where(F.col("month") >= F.trunc(moment(frm), "month"))
    if to is not None:
        df = df.where(F.col("ts") <= moment(to))
        if "month" in df.columns:
            df = df.where(F.col("month") <= F.trunc(moment(to), "month"))
    return df


def ago(as_of: str | Column, n: int, unit: str) -> Column:
    """A fixed number of seconds before ``as_of``."""
    return F.timestamp_micros(
        F.unix_micros(moment(as_of)) - F.lit(n * SECONDS[unit] * 1_000_000)
    )


def last_interval(df: DataFrame, as_of: str, n: int, unit: str) -> DataFrame:
    return between_ts(df, frm=ago(as_of, n, unit))


def project_record(df: DataFrame) -> DataFrame:
    """The seven record columns, with the id as text so that 64-bit ids survive JSON."""
    row_id = F.col("id").cast("string") if dict(df.dtypes)["id"] == "bigint" else F.to_json("id")
    return df.select(row_id.alias("id"), *READING_COLUMNS[1:])


def slow_requests(log: DataFrame, threshold_ms: int = 500, top: int = 10) -> DataFrame:
    """Endpoints with the most requests at or above the threshold."""
    return (
        log.where(F.col("duration_ms") >= threshold_ms)
        .groupBy("endpoint")
        .agg(F.count(F.lit(1)).alias("slow"), F.max("duration_ms").alias("slowest_ms"))
        .orderBy(F.desc("slow"), "endpoint")
        .limit(top)
    )
