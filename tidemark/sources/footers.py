"""Answers from metadata: Parquet footers and manifests instead of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.snapshots import Snapshots

V1_SOURCES = "spark.sql.sources.useV1SourceList"
PUSHDOWN = "spark.sql.parquet.aggregatePushdown"


def read_footers(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files by the reader that takes counts and extremes from footers.

    Counts, and extremes of whole numbers, doubles, booleans and dates, without filters or by
    partition columns alone, are answered by one footer a file; anything else reads as usual.
    The pushdown is decided when a query is planned, so it stays switched on.
    """
    spark.conf.set(PUSHDOWN, "true")
    old = spark.conf.get(V1_SOURCES)
    kept = [s for s in old.split(",") if s.strip().lower() != "parquet"]
    spark.conf.set(V1_SOURCES, ",".join(kept))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(V1_SOURCES, old)


def footer_summary(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row: ``row_count, least, greatest`` of a whole-number column, from footers."""
    found = read_footers(spark, path).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(column).alias("least"), F.max(column).alias("greatest")
    )
    # files without rows have no footer statistics, and their count comes as null
    return found.withColumn("row_count", F.greatest("row_count", F.lit(0).cast("long")))


def source_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``table_name, estimated_rows, bytes`` per path: rows by footers, bytes as files have them."""
    out = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        size = files.option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length").alias("bytes"))
        rows = read_footers(spark, path).agg(F.count(F.lit(1)).alias("estimated_rows"))
        row = rows.join(F.broadcast(size), F.lit(True)).select(
            F.lit(name).alias("table_name"),
            F.greatest("estimated_rows", F.lit(0).cast("long")).alias("estimated_rows"),
            F.coalesce("bytes", F.lit(0)).alias("bytes"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def manifest_summary(table: Snapshots, columns: list[str], version: int | None = None) -> DataFrame:
    """One row: ``row_count``, and ``least_<c>, greatest_<c>`` of each range column.

    Files hold their exact extremes, so these are the table's, whatever the columns' type.
    """
    ends = []
    for c in columns:
        ends += [F.min(F.col("low")[c]).alias(f"least_{c}"), F.max(F.col("high")[c]).alias(f"greatest_{c}")]
    rows = F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count")
    return table.manifest(version).agg(rows, *ends)


def manifest_lag(table: Snapshots, bucket_of: Snapshots, bucket: str = "hour") -> DataFrame:
    """Newest reading, newest rollup bucket and the seconds between, from two manifests."""
    newest = manifest_summary(table, ["ts"]).select(F.col("greatest_ts").alias("latest_data"))
    built = manifest_summary(bucket_of, [bucket]).select(F.col(f"greatest_{bucket}").alias("latest_bucket"))
    lag = (F.unix_micros("latest_data") - F.unix_micros("latest_bucket")) / 1_000_000
    return newest.join(F.broadcast(built), F.lit(True)).withColumn("lag_seconds", lag)
