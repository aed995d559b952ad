"""Exact interpolated percentiles without gathering a large group.

A group may hold a third of all rows, so neither its rows nor its distinct values may meet in
one task. Rows are first counted per distinct value (combined map-side). A histogram over the
high bits of the value then tells in which value range each wanted rank lies, and only those
ranges are opened, level by level, until single values remain. With 18 bits per level no task
orders more than 2**18 entries of one group, whatever the group's size.

A caller that measured which groups are large (``large_groups``) can rank the rows of the others
directly (``ranked``), which takes one shuffle and serves other aggregates as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import on_same
from tidemark.functions.numbers import floor_div
from tidemark.session import written

BITS = 18
SMALL_GROUP = 200_000


def levels_for(precision: int) -> int:
    """Levels that cover every signed whole number of ``precision`` decimal digits."""
    return max(1, math.ceil(math.log2(2 * 10**precision) / BITS))


def large_groups(df: DataFrame, keys: list[str], rows: int = SMALL_GROUP) -> DataFrame:
    """Keys of groups with more than ``rows`` rows; only one count per group is shuffled.

    The result is written, because it decides the plan and is then joined. A table of n rows
    has fewer than n / ``rows`` such groups.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return written(counts.where(F.col("_n") > rows).select(*keys), "large-groups")


def value_counts(rows: DataFrame, keys: list[str], precision: int) -> DataFrame:
    """(keys, ``_v``, ``_n``) for rows whose value is present.

    The conditions name everything later joins need, so that all uses of the counts have the
    same plan and Spark runs and shuffles them once.
    """
    for present in ["_v", *[F.shiftright("_v", s) for s in _shifts(precision) if s]]:
        rows = rows.where((F.col(present) if isinstance(present, str) else present).isNotNull())
    return rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))


def _shifts(precision: int) -> list[int]:
    return [BITS * i for i in reversed(range(levels_for(precision)))]


def ranked(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Rows with their whole value, its rank in the group from zero, and the group's size.

    Sorts each group in one task: only for groups known not to be large.
    """
    group = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_v"))
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("_v", value.cast("bigint")).select(
        "*",
        (F.row_number().over(group) - 1).cast("bigint").alias("_rank"),
        F.count("_v").over(whole).alias("_size"),
    )


def rank_picks(percents: list[int]) -> dict[str, Column]:
    """Aggregates over ``ranked`` rows that ``interpolated`` needs."""
    picks = {"_total": F.max("_size")}
    for i, p in enumerate(percents):
        low = floor_div((F.col("_size") - 1) * p, 100)
        high = F.least(low + 1, F.col("_size") - 1)
        picks[f"_lo{i}"] = F.max(F.when(F.col("_rank") == low, F.col("_v")))
        picks[f"_hi{i}"] = F.max(F.when(F.col("_rank") == high, F.col("_v")))
    return picks


def ranks_of_counts(
    counted: DataFrame, keys: list[str], value: Column, count: Column, percents: list[int]
) -> DataFrame:
    """Rows of value counts with the columns of ``rank_columns``, filled where a value has a
    wanted rank; null values have none. Orders each group in one task: not for large groups.
    """
    n = F.when(value.isNotNull(), count).otherwise(0)
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumns(
        {"_upto": F.sum(n).over(upto), "_total": F.sum(n).over(group)}
    ).withColumn("_from", F.col("_upto") - n)
    out = {}
    for i, p in enumerate(percents):
        low = floor_div((F.col("_total") - 1) * p, 100)
        for side, rank in (("lo", low), ("hi", F.least(low + 1, F.col("_total") - 1))):
            inside = (F.col("_from") <= rank) & (rank < F.col("_upto"))
            out[f"_{side}{i}"] = F.when(inside, value)
    return placed.withColumns(out).drop("_upto", "_from")


def rank_columns(percents: int) -> list[str]:
    return ["_total", *[f"_{side}{i}" for i in range(percents) for side in ("lo", "hi")]]


def interpolated(percents: list[int]) -> list[Column]:
    """``p<percent>_x100`` from the two values around each rank."""
    return [_interpolate(i, p).alias(f"p{p}_x100") for i, p in enumerate(percents)]


def exact_percentiles(
    df: DataFrame, keys: list[str], value: Column, percents: list[int], precision: int = 15
) -> DataFrame:
    """Per key, ``p<percent>_x100``: 100 times the interpolated percentile of ``value``.

    ``value`` is a whole number below 10**precision in size; rows without a value do not count,
    and rows with a null key are a group like any other. The factor 100 keeps the interpolation
    weight exact: percentile = x100 / 100.
    """
    rows = df.select(*keys, value.cast("bigint").alias("_v"))
    return percentiles_of_counts(value_counts(rows, keys, precision), keys, percents, precision)


def percentiles_of_counts(
    counted: DataFrame, keys: list[str], percents: list[int], precision: int
) -> DataFrame:
    shifts = _shifts(precision)
    group = Window.partitionBy(*(keys or [F.lit(0)]))

    top = _bucketed(counted, keys, [], shifts[0])
    ranked = top.withColumn("_total", F.sum("_n").over(group)).withColumn(
        "_wanted", _ranks(F.col("_total"), percents)
    )
    found = _keep_wanted(ranked, group.orderBy("_p"))

    for upper, lower in zip(shifts, shifts[1:]):
        parts = _bucketed(counted, keys, [F.shiftright("_v", upper).alias("_up")], lower)
        wanted = found.select(*keys, F.col("_p").alias("_up"), "_total", "_wanted")
        opened = on_same(parts, wanted, [*keys, "_up"])
        found = _keep_wanted(opened, Window.partitionBy(*keys, "_up").orderBy("_p"))

    hits = found.select(*keys, "_total", "_p", F.explode("_wanted").alias("_w"))
    picks = [F.max("_total").alias("_total")]
    for i in range(len(percents)):
        for side in ("lo", "hi"):
            match = (F.col("_w.i") == i) & (F.col("_w.side") == side)
            picks.append(F.max(F.when(match, F.col("_p"))).alias(f"_{side}{i}"))
    out = hits.groupBy(*keys).agg(*picks)
    if not keys:
        out = out.where("_total is not null")
    return out.select(*keys, *interpolated(percents))


def _bucketed(counted: DataFrame, keys: list[str], extra: list[Column], shift: int) -> DataFrame:
    names = [*keys, *(["_up"] if extra else [])]
    if shift == 0:
        return counted.select(*keys, *extra, F.col("_v").alias("_p"), "_n")
    cut = counted.select(*keys, *extra, F.shiftright("_v", shift).alias("_p"), "_n")
    return cut.groupBy(*names, "_p").agg(F.sum("_n").alias("_n"))


def _ranks(total: Column, percents: list[int]) -> Column:
    wanted = []
    for i, p in enumerate(percents):
        low = floor_div((total - 1) * p, 100)
        for side, rank in (("lo", low), ("hi", F.least(low + 1, total - 1))):
            wanted.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.alias("rank")))
    return F.array(*wanted)


def _keep_wanted(df: DataFrame, ordered) -> DataFrame:
    """Keep buckets that contain a wanted rank, with ranks counted from the bucket's start."""
    before = F.coalesce(
        F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = df.withColumn("_before", before)
    inside = F.filter(
        "_wanted",
        lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("_n")),
    )
    relative = F.transform(
        inside,
        lambda w: F.struct(
            w["i"].alias("i"), w["side"].alias("side"), (w["rank"] - F.col("_before")).alias("rank")
        ),
    )
    return placed.withColumn("_wanted", relative).where(F.size("_wanted") > 0)


def _interpolate(i: int, percent: int) -> Column:
    weight = ((F.col("_total") - 1) * percent) % 100
    return F.col(f"_lo{i}") * (100 - weight) + F.col(f"_hi{i}") * weight
