"""A copy of the readings in buckets of their id, for lookups that do not move readings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.spec import READING_COLUMNS

def write_buckets(df: DataFrame, path: str, buckets: int, key: str = "id") -> DataFrame:
    """Writes the readings once, dealt and sorted by ``key``, and opens them.

    Joins on the key then shuffle the other side alone, into as many parts as there are
    buckets, and merge with the files as they lie. Spark prefers the side with more parts, so
    there should be no fewer buckets than ``spark.sql.shuffle.partitions``.
    """
    name = _name()
    rows = df.select(*READING_COLUMNS).repartition(buckets, key)
    writer = rows.write.bucketBy(buckets, key).sortBy(key).option("path", path)
    writer.format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def open_buckets(spark: SparkSession, path: str, buckets: int, key: str = "id") -> DataFrame:
    """Buckets written by another session, which its catalog does not know."""
    name, schema = _name(), spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def _name() -> str:
    return f"readings_by_key_{uuid.uuid4().hex}"
