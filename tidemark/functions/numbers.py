"""Exact integer arithmetic on decimal values.

Rounding an already rounded average moves ties, and double sums depend on the order in which
partitions are merged. Values are therefore taken as whole units of their last decimal place
and every statistic is derived from exact integer sums.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SUM_TYPE = "decimal(38,0)"


def units(value: Column, scale: int) -> Column:
    """The decimal value as a whole number of its last place (cents for scale 2)."""
    return (value * F.lit(10**scale)).cast("bigint")


def from_units(whole: Column, places: int = 2) -> Column:
    return (whole.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-places))).cast(
        f"decimal(20,{places})"
    )


def floor_div(num: Column, den: Column | int) -> Column:
    return F.call_function("div", num, den if isinstance(den, Column) else F.lit(den))


def round_div(num: Column, den: Column | int) -> Column:
    """num / den for den > 0, rounded half away from zero, in integers."""
    den = den if isinstance(den, Column) else F.lit(den)
    return F.signum(num).cast("bigint") * floor_div(F.abs(num) * 2 + den, den * 2)


def power_sums(whole: Column, prefix: str = "") -> list[Column]:
    """Partial-aggregable count, sum and sum of squares of whole units."""
    wide = whole.cast("decimal(19,0)")
    return [
        F.count(whole).alias(f"{prefix}n"),
        F.sum(wide.cast("decimal(28,0)")).alias(f"{prefix}s"),
        F.sum((wide * wide).cast(SUM_TYPE)).alias(f"{prefix}ss"),
    ]


def mean_units(n: Column, s: Column, drop: int = 1) -> Column:
    """Average in units, rounded; ``drop`` is 10**(digits to remove).

    Sums that fit a long, the usual case, take the long form of the same division.
    """
    small = F.abs(s) < F.lit(10**18).cast("decimal(19,0)")
    return F.when(small, round_div(s.cast("bigint"), n * drop)).otherwise(
        round_div(s, n.cast("decimal(19,0)") * drop)
    )


def spread(n: Column, s: Column, ss: Column) -> Column:
    """Sample deviation in units as a double; null for one row.

    In long arithmetic while n*ss fits. Beyond, the squares are re-centred on the whole part of
    the mean before multiplying by n, so the exact form n*D - r*r fits 38 digits far longer
    than n*ss would. Past that, the same quantity is taken in double, which no longer cancels
    because D is already centred.
    """
    fits = n.cast("double") * ss.cast("double") < 9e18
    as_long = n * ss.cast("bigint") - s.cast("bigint") * s.cast("bigint")
    nd = n.cast("decimal(19,0)")
    q = floor_div(s, nd).cast("decimal(19,0)")
    r = (s - q * nd).cast("decimal(19,0)")
    centred = (
        ss - (q * s).cast(SUM_TYPE) * 2 + (q * q).cast(SUM_TYPE) * nd
    ).cast(SUM_TYPE)
    exact = (F.try_multiply(nd, centred) - r * r).cast("double")
    rough = n.cast("double") * centred.cast("double") - r.cast("double") * r.cast("double")
    squares = F.when(fits, as_long.cast("double")).otherwise(F.coalesce(exact, rough))
    pairs = n.cast("double") * (n.cast("double") - 1)
    return F.when(n > 1, F.sqrt(squares / pairs))


def stddev_units(n: Column, s: Column, ss: Column, drop: int = 1) -> Column:
    """Sample deviation in units, rounded half up."""
    return F.floor(spread(n, s, ss) / drop + 0.5)
