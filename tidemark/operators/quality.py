"""Constraint checks, quality summaries and reconciliation after a load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.joins import beside
from tidemark.spec import MAX_ENTITY_LENGTH, MAX_TYPE_LENGTH, MAX_UNIT_LENGTH, READING_TYPES

VALUE_LIMIT = "100000000"


def violations(types: tuple[str, ...] = READING_TYPES) -> Column:
    """Names of the broken constraints of a row, empty for a good one."""
    checks = {
        "id_null": F.col("id").isNull(),
        "device_null": F.col("device_id").isNull(),
        "device_length": F.length("device_id") > MAX_ENTITY_LENGTH,
        "timestamp_null": F.col("ts").isNull(),
        "type_null": F.col("reading_type").isNull(),
        "type_length": F.length("reading_type") > MAX_TYPE_LENGTH,
        "type_unknown": ~F.col("reading_type").isin(*types),
        "value_null": F.col("value").isNull(),
        "value_range": F.abs("value") >= F.lit(VALUE_LIMIT).cast("decimal(10,0)"),
        "unit_null": F.col("unit").isNull(),
        "unit_length": F.length("unit") > MAX_UNIT_LENGTH,
        "metadata_null": F.col("metadata").isNull(),
    }
    named = F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])
    return F.array_compact(named)


def flag_readings(df: DataFrame, types: tuple[str, ...] = READING_TYPES) -> DataFrame:
    return df.withColumn("violations", violations(types))


def check_readings(
    df: DataFrame, types: tuple[str, ...] = READING_TYPES
) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy every constraint, quarantined rows with the broken ones)."""
    flagged = flag_readings(df, types)
    good = flagged.where(F.size("violations") == 0).drop("violations")
    return good, flagged.where(F.size("violations") > 0)


def quality_summary(df: DataFrame, places: int = 6) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("value").isNull() | F.col("reading_type").isNull()).alias("null_values"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.sum(F.col("value").cast("decimal(28,6)")).alias("sum_value"),
        F.count_if(F.col("value") != F.round("value", places)).alias("changed_by_rounding"),
        F.try_divide(
            F.sum(F.col("value").cast("decimal(28,6)")).cast("double"),
            F.count("value").cast("double"),
        ).alias("avg_value"),
    )


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row comparing row and device counts of a source with its copy."""

    def summary(df: DataFrame, side: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias(f"{side}_rows"),
            F.count_distinct("device_id").alias(f"{side}_devices"),
        )

    both = beside(summary(source, "source"), summary(target, "target"))
    return both.withColumn(
        "matches",
        (F.col("source_rows") == F.col("target_rows"))
        & (F.col("source_devices") == F.col("target_devices")),
    )
