"""Ordered functions over a series, cut into time chunks.

``lag`` and running values over one series put the whole series into one task. Here each
series is windowed per time chunk, and only one summary row per chunk is ordered across
chunks, so a series holding a third of all rows is spread over as many tasks as it has chunks.
Chunks are cut by the clock and, within, at quantiles of the table's times, measured first: no
chunk of any series holds much more than 1/``RANGES`` of all rows, also when they all fell into
one day. Only rows of one instant stay together.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import on_same

DAY = 86400
RANGES = 1024


def chunk_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds)


def time_cuts(df: DataFrame, ts: str, ranges: int = RANGES) -> list[float]:
    """At most ``ranges - 1`` instants, in microseconds, that part the rows about evenly."""
    shares = [i / ranges for i in range(1, ranges)]
    cuts = df.select(F.percentile_approx(F.unix_micros(ts), shares, 20 * ranges)).first()[0]
    return sorted({float(c) for c in cuts or []})


def _chunked(df: DataFrame, ts: str, chunk: int) -> DataFrame:
    """Add ``_chunk``, a number that grows with time; null where there is none."""
    at = F.unix_micros(ts).cast("double")
    splits = [float("-inf"), *time_cuts(df, ts), float("inf")]
    by_clock = chunk_of(F.col(ts), chunk)
    if len(splits) == 2:
        return df.withColumn("_chunk", by_clock)
    measured = Bucketizer(splits=splits, inputCol="_at", outputCol="_range", handleInvalid="keep")
    parted = measured.transform(df.withColumn("_at", F.coalesce(at, F.lit(0.0))))
    number = by_clock * RANGES + F.col("_range").cast("bigint")
    return parted.withColumn("_chunk", number).drop("_at", "_range")


def previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    chunk: int = DAY,
) -> DataFrame:
    """Add ``_prev``: a struct of ``columns`` from the previous row of the series, or null.

    ``order[0]`` is the timestamp; the rest break ties.
    """
    rows = _chunked(df, order[0], chunk)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    kept = F.struct(*columns)
    ends = rows.groupBy(*keys, "_chunk").agg(
        F.max_by(kept, F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk")
    carried = ends.select(*keys, "_chunk", F.lag("_last").over(across).alias("_carry"))
    rows = rows.withColumn("_prev", F.lag(kept).over(within))
    return (
        on_same(rows, carried, [*keys, "_chunk"])
        .withColumn("_prev", F.coalesce("_prev", "_carry"))
        .drop("_chunk", "_carry")
    )


def running_max(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, chunk: int = DAY
) -> DataFrame:
    """Add ``name``: the greatest ``value`` of the series up to and including the row."""
    rows = _chunked(df, order[0], chunk).withColumn("_x", value)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    tops = rows.groupBy(*keys, "_chunk").agg(F.max("_x").alias("_top"))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = tops.select(*keys, "_chunk", F.max("_top").over(across).alias("_carry"))
    rows = rows.withColumn(name, F.max("_x").over(within))
    return (
        on_same(rows, carried, [*keys, "_chunk"])
        .withColumn(name, F.greatest(name, "_carry"))
        .drop("_chunk", "_carry", "_x")
    )


def islands(
    df: DataFrame, keys: list[str], order: list[str], starts: Column, chunk: int = DAY
) -> DataFrame:
    """Add ``island``: the timestamp of the row that opened the row's island.

    ``starts`` decides from the ``order`` columns of a row and of its predecessor ``_prev``
    whether a new island opens. A row without a predecessor always opens one. Within a chunk
    all rows but the first know their predecessor; the first ones are settled on the summaries.
    """
    row = F.struct(*order)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = (
        _chunked(df, order[0], chunk)
        .withColumn("_prev", F.lag(row).over(within))
        .withColumn("_start", F.when(F.col("_prev").isNotNull() & starts, row))
        .withColumn("_lead", F.max("_start").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    )
    chunks = local.groupBy(*keys, "_chunk").agg(
        F.min(row).alias("_first"), F.max(row).alias("_last"), F.max("_start").alias("_top")
    )
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        chunks.select(*keys, "_chunk", "_first.*", "_top", F.lag("_last").over(across).alias("_prev"))
        .withColumn("_head", F.when(F.col("_prev").isNull() | starts, row))
        .withColumn("_newest", F.greatest("_head", "_top"))
        .select(
            *keys, "_chunk", F.coalesce("_head", F.max("_newest").over(earlier)).alias("_open")
        )
    )
    return (
        on_same(local, heads, [*keys, "_chunk"])
        .withColumn("island", F.coalesce("_lead", "_open")[order[0]])
        .drop("_chunk", "_prev", "_start", "_lead", "_open")
    )


def gap_islands(
    df: DataFrame, keys: list[str], order: list[str], gap_seconds: int, chunk: int = DAY
) -> DataFrame:
    """Islands separated by at least ``gap_seconds`` without a row."""
    waited = F.unix_micros(order[0]) - F.unix_micros(F.col(f"_prev.{order[0]}"))
    return islands(df, keys, order, waited >= gap_seconds * 1_000_000, chunk)
