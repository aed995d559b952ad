"""Predicates on and changes of the JSON attributes, and schema changes on stored rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.synth import attributes_json


def json_text(path: str) -> Column:
    """The attribute at a dotted path as text, or null."""
    return F.get_json_object("metadata", "$." + path)


def json_eq(df: DataFrame, path: str, value: str) -> DataFrame:
    return df.where(json_text(path) == value)


def json_num_lt(df: DataFrame, path: str, bound: int | str) -> DataFrame:
    """Text that is no number counts as absent instead of failing the job."""
    number = json_text(path).try_cast("decimal(38,10)")
    return df.where(number < F.lit(str(bound)).cast("decimal(38,10)"))


def json_has(df: DataFrame, key: str) -> DataFrame:
    """The top-level key exists, also with a null value."""
    return df.where(F.array_contains(F.json_object_keys("metadata"), key))


def low_attr_counts(df: DataFrame, path: str, bound: int | str) -> DataFrame:
    return json_num_lt(df, path, bound).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("reading_count")
    )


def add_metadata(df: DataFrame) -> DataFrame:
    """Give rows from before the column existed an empty document."""
    if "metadata" not in df.columns:
        return df.withColumn("metadata", F.lit("{}"))
    return df.withColumn("metadata", F.coalesce("metadata", F.lit("{}")))


def backfill_metadata(df: DataFrame, seed: int = 42) -> DataFrame:
    """Random attributes where there are none; existing documents stay untouched."""
    return df.withColumn(
        "metadata", F.when(F.col("metadata").isNull(), attributes_json(seed)).otherwise(F.col("metadata"))
    )


def merge_metadata(df: DataFrame, device_id: str, patch: str) -> DataFrame:
    """Merge top-level keys into one device's documents; the patch wins.

    Values are kept as variants, so numbers, booleans and nested documents survive.
    """
    kind = "map<string,variant>"
    fresh = F.from_json(F.lit(patch), kind)
    old = F.coalesce(F.from_json("metadata", kind), F.create_map().cast(kind))
    names = list(json.loads(patch))
    kept = F.map_filter(old, lambda k, v: ~k.isin(names)) if names else old
    merged = F.to_json(F.map_concat(kept, fresh))
    return df.withColumn(
        "metadata", F.when(F.col("device_id") == device_id, merged).otherwise(F.col("metadata"))
    )


def widen_value(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with value as decimal(15,6), one row counting values that changed)."""
    wide = F.col("value").cast("decimal(15,6)")
    changed = df.agg(F.count_if(~F.col("value").eqNullSafe(wide)).alias("changed"))
    return df.withColumn("value", wide), changed
