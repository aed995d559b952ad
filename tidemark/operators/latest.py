"""Newest readings of one device, of every device, and paging backwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.filters import between_ts, by_device, by_type, moment
from tidemark.operators.requests import DEFAULT_LIMIT, MAX_LIMIT


def _newest_first() -> list[Column]:
    return [F.desc("ts"), F.desc("id")]


def latest(
    df: DataFrame,
    device_id: str | None,
    n: int = DEFAULT_LIMIT,
    reading_type: str | None = None,
    frm: str | None = None,
    to: str | None = None,
) -> DataFrame:
    """The newest ``n`` readings; equal times are ordered by id, newest id first."""
    if not 1 <= n <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    rows = between_ts(by_type(by_device(df, device_id), reading_type), frm, to)
    return rows.orderBy(*_newest_first()).limit(n)


def page_before(
    df: DataFrame, device_id: str, before_ts: str, before_id: int | None = None, n: int = DEFAULT_LIMIT
) -> DataFrame:
    """The ``n`` readings before a time, or before (time, id) so that ties are not lost."""
    rows = by_device(df, device_id)
    at = moment(before_ts)
    if before_id is None:
        rows = rows.where(F.col("ts") < at)
    else:
        rows = rows.where(F.col("ts") <= at).where((F.col("ts") < at) | (F.col("id") < before_id))
    return rows.orderBy(*_newest_first()).limit(n)


def latest_per_entity(df: DataFrame, n: int = 1) -> DataFrame:
    """The newest ``n`` readings of every device; each task sends at most ``n`` per device."""
    order = Window.partitionBy("device_id").orderBy(*_newest_first())
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
