"""Run summaries against targets, bands and earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.joins import checked
from tidemark.functions.numbers import from_units, round_div

# Latency targets in ms and the largest error share of the load scenarios.
PROJECT_TARGETS = (("p50_ms", 300.0), ("p95_ms", 500.0), ("p99_ms", 800.0), ("error_share", 0.01))
LOOKUP_TARGETS = (("p50_ms", 50.0), ("p95_ms", 100.0), ("p99_ms", 200.0), ("error_share", 0.01))

# Fixed values: (stat, pass bound, warn bound); below the first passes, above the second fails.
BANDS = (
    ("p50_ms", 500.0, 700.0, False),
    ("p95_ms", 800.0, 1200.0, False),
    ("error_share", 0.01, 0.05, False),
    ("hit_ratio", 0.8, 0.6, True),
    ("concurrent_users", 50.0, 30.0, True),
)
# Fixed values: (segment, stat, bound) per query tier.
TIER_TARGETS = (
    ("pk_lookup", "p95_ms", 100.0),
    ("pk_lookup", "p99_ms", 200.0),
    ("device_filter", "p95_ms", 200.0),
    ("device_filter", "p99_ms", 400.0),
    ("time_range", "p95_ms", 400.0),
    ("time_range", "p99_ms", 600.0),
    ("stats_agg", "p95_ms", 500.0),
    ("stats_agg", "p99_ms", 800.0),
)
# Fixed values: (stat, warning bound, critical bound, whether high values are good).
LEVELS = (
    ("p95_ms", 400.0, 500.0, False),
    ("error_share", 0.005, 0.01, False),
    ("hit_ratio", 0.7, 0.5, True),
    ("connection_share", 0.8, 0.9, False),
)
HIGHER_IS_BETTER = ("requests", "requests_per_second", "hit_ratio")
MINOR_CHANGE = 10


def targets_table(spark: SparkSession, targets=PROJECT_TARGETS) -> DataFrame:
    return spark.createDataFrame(list(targets), "stat string, bound double")


def tier_targets(spark: SparkSession, targets=TIER_TARGETS) -> DataFrame:
    return spark.createDataFrame(list(targets), "segment string, stat string, bound double")


def long_summary(summary: DataFrame, by: list[str], stats: list[str]) -> DataFrame:
    """One row per group and statistic."""
    cells = [F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats]
    return summary.select(*by, F.inline(F.array(*cells)))


def slo_verdict(summary: DataFrame, by: list[str], targets: DataFrame) -> DataFrame:
    """Every statistic that has a target, with a strict verdict.

    Targets that name a column of ``by`` hold for its groups only.
    """
    rows = long_summary(summary, by, [c for c in summary.columns if c not in by])
    on = ["stat", *[k for k in by if k in targets.columns]]
    return rows.join(checked(targets), on).withColumn(
        "verdict", F.when(F.col("value") < F.col("bound"), "pass").otherwise("fail")
    )


def _graded(rows: DataFrame, grades: tuple, names: tuple[str, str, str]) -> DataFrame:
    verdict: Column = F.lit(None).cast("string")
    value = F.col("value")
    good, middle, bad = names
    for stat, first, second, high_is_good in grades:
        if high_is_good:
            grade = F.when(value >= first, good).when(value >= second, middle).otherwise(bad)
        else:
            grade = F.when(value <= first, good).when(value <= second, middle).otherwise(bad)
        verdict = F.when(F.col("stat") == stat, grade).otherwise(verdict)
    return rows.withColumn("grade", verdict).where("grade is not null and value is not null")


def banded(summary: DataFrame, by: list[str]) -> DataFrame:
    """pass, warn or fail by the published bands."""
    stats = [g[0] for g in BANDS if g[0] in summary.columns]
    return _graded(long_summary(summary, by, stats), BANDS, ("pass", "warn", "fail"))


def alert_level(summary: DataFrame, by: list[str]) -> DataFrame:
    """ok, warning or critical by the published alert levels."""
    stats = [g[0] for g in LEVELS if g[0] in summary.columns]
    return _graded(long_summary(summary, by, stats), LEVELS, ("ok", "warning", "critical"))


def compare_runs(rows: DataFrame, by: list[str], base: str, current: str) -> DataFrame:
    """Change of every statistic between two runs, in percent of the first.

    ``rows`` is a long summary with a ``run`` column. Worse by more than ten percent is a
    regression. Without a base value, or with zero, there is no change to state.
    """
    wide = (
        rows.where(F.col("run").isin(base, current))
        .groupBy(*by, "stat")
        .agg(
            F.max(F.when(F.col("run") == base, F.col("value"))).alias("base"),
            F.max(F.when(F.col("run") == current, F.col("value"))).alias("current"),
        )
    )
    b, c = (F.col(n).cast("decimal(18,6)") * 1_000_000 for n in ("base", "current"))
    b, c = b.cast("decimal(19,0)"), c.cast("decimal(19,0)")
    ten_thousandths = round_div((c - b) * 1_000_000 * F.sign(b).cast("int"), F.abs(b))
    delta = F.when(b != 0, from_units(ten_thousandths, 4))
    improved = F.when(F.col("stat").isin(*HIGHER_IS_BETTER), delta > 0).otherwise(delta < 0)
    return wide.withColumn("delta_percent", delta).withColumn(
        "verdict",
        F.when(delta.isNull(), "N/A")
        .when(improved, "improved")
        .when(F.abs(delta) > MINOR_CHANGE, "regression")
        .otherwise("minor"),
    )
