"""Size-checked joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; stops counting just past the bound."""
    return df.limit(rows + 1).count() <= rows


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when it is small enough, otherwise for Spark to decide."""
    return F.broadcast(df) if is_small(df, rows) else df


def on_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null keys are equal too; the keys of ``left`` remain."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def beside(df: DataFrame, single: DataFrame) -> DataFrame:
    """Every row of ``df`` with the columns of a frame that has exactly one row."""
    return df.join(F.broadcast(single), F.lit(True))


def keep_matching(big: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows of ``big`` early when the wanted keys are few enough to broadcast.

    Beyond the bound ``big`` is returned as it is: nearly everything is wanted then, and the
    join that follows drops the rest without shuffling ``big`` once more.
    """
    names = wanted.select(*keys).distinct()
    if is_small(names):
        return big.join(F.broadcast(names), keys, "left_semi")
    return big
