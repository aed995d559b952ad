"""Rollups of readings that arrive continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.joins import beside
from tidemark.operators.rollups import hourly_by_window
from tidemark.plans.maintenance import build, write_rollup_by_date
from tidemark.session import use_utc
from tidemark.sources.readings import as_readings, utc_schema
from tidemark.spec import READING_COLUMNS, ReadingsSpec


def stream_readings(
    spark: SparkSession, path: str, spec: ReadingsSpec, pattern: str = "*.parquet", files: int | None = None
) -> DataFrame:
    """Parquet files that appear under ``path`` as a stream of readings."""
    use_utc(spark)
    schema = utc_schema(spark.read.option("pathGlobFilter", pattern).parquet(path).schema)
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return as_readings(reader.parquet(path), spec)


def _start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def continuous_hourly(
    readings: DataFrame, path: str, checkpoint: str, late_days: int = 7, every: str | None = None
) -> StreamingQuery:
    """Append each hour's rollup once no reading of it can arrive any more.

    The refresh look-back is the allowed lateness: later rows are dropped, as an incremental
    refresh would not see them either.
    """
    rollup = hourly_by_window(readings.withWatermark("ts", f"{late_days} days"))
    return _start(rollup.writeStream.format("parquet").option("path", path), checkpoint, every)


def continuous_daily(
    readings: DataFrame,
    store: str,
    path: str,
    checkpoint: str,
    late_days: int = 30,
    every: str | None = None,
) -> StreamingQuery:
    """Keep a daily rollup with exact percentiles up to date.

    Exact percentiles cannot be kept in streaming state. Each batch is stored by day, and the
    days it touched are recomputed from the store and replace their partitions. A repeated
    batch writes the same partitions again. Rows older than the look-back are stored, but do
    not reopen their day.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        by_day = batch.select(*READING_COLUMNS, F.to_date("ts").alias("day"))
        (
            by_day.withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "batch")
            .parquet(store)
        )
        stored = spark.read.parquet(store).where(F.col("batch") <= batch_id)
        touched = stored.where(F.col("batch") == batch_id).select("day").distinct()
        edge = stored.where(F.col("batch") < batch_id).agg(
            F.date_sub(F.max("day"), late_days).alias("edge")
        )
        open_days = beside(touched, edge).where("edge is null or day >= edge")
        rows = stored.join(open_days.select("day"), "day", "left_semi")
        write_rollup_by_date(build("daily", rows.select(*READING_COLUMNS)), "day", path)

    return _start(readings.writeStream.foreachBatch(absorb), checkpoint, every)
