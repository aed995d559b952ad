"""Month-partitioned physical layout, retention and published rollup versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import paths
from tidemark.spec import READING_COLUMNS


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.trunc("ts", "month"))


def write_layout(
    df: DataFrame, path: str, partitions: int | None = None, rows_per_file: int = 20_000_000
) -> None:
    """Organise readings once for device + time, time and id lookups.

    Ranges over (month, device, time, id) keep each month in few files and cut a hot device
    into time slices instead of one huge partition. Sorted files give tight min/max statistics
    on device and time; bloom filters serve device and id lookups.
    """
    keys = ["month", "device_id", "ts", "id"]
    ranged = with_month(df.select(*READING_COLUMNS))
    ranged = ranged.repartitionByRange(*([partitions] if partitions else []), *keys)
    writer = (
        ranged.sortWithinPartitions("month", "device_id", F.desc("ts"), F.desc("id"))
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .option("parquet.bloom.filter.enabled#device_id", "true")
    )
    if dict(df.dtypes)["id"] == "bigint":
        writer = writer.option("parquet.bloom.filter.enabled#id", "true")
    writer.partitionBy("month").parquet(path)


def repartition_by_month(spark: SparkSession, src: str, dst: str) -> DataFrame:
    """Copy a readings table into month partitions and fail unless all rows arrived."""
    source = spark.read.parquet(src)
    write_layout(source, dst)
    copied = spark.read.parquet(dst)
    before, after = source.count(), copied.count()
    if before != after:
        raise ValueError(f"copied {after} of {before} rows; keep {src}")
    return copied


def kept_months(df: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """Rows whose month is within retention; prunes partitions of the month layout."""
    edge = F.add_months(F.trunc(F.lit(as_of).cast("timestamp"), "month"), -months)
    return df.where(F.col("month") >= edge)


def drop_expired(spark: SparkSession, path: str, as_of: str, months: int = 12) -> list[str]:
    """Delete the folders of months before retention; returns the dropped months."""
    edge = spark.range(1).select(
        F.add_months(F.trunc(F.lit(as_of).cast("timestamp"), "month"), -months).cast("string")
    ).first()[0]
    dropped = []
    for name in paths.folders(spark, path):
        if name.startswith("month=") and name[len("month="):] < edge:
            paths.drop_folder(spark, f"{path}/{name}")
            dropped.append(name[len("month="):])
    return dropped


def publish_rollup(df: DataFrame, path: str, view: str | None = None, keep: int = 2) -> str:
    """Write a rollup as a new version and switch readers to it once it is complete.

    A version counts only when its success marker exists, so readers see the old one until the
    new one is whole, also when the job dies half way. The last ``keep`` versions stay for
    queries that are still running.
    """
    spark = df.sparkSession
    versions = _versions(spark, path)
    target = f"{path}/version={max(versions, default=0) + 1:010d}"
    df.write.mode("overwrite").parquet(target)
    for old in sorted(v for v in versions if _complete(spark, path, v))[: -(keep - 1) or None]:
        paths.drop_folder(spark, f"{path}/version={old:010d}")
    if view:
        read_rollup(spark, path).createOrReplaceTempView(view)
    return target


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version."""
    done = [v for v in _versions(spark, path) if _complete(spark, path, v)]
    if not done:
        raise ValueError(f"no published version under {path}")
    return spark.read.parquet(f"{path}/version={max(done):010d}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [
        int(n.split("=")[1]) for n in paths.folders(spark, path) if n.startswith("version=")
    ]


def _complete(spark: SparkSession, path: str, version: int) -> bool:
    return paths.exists(spark, f"{path}/version={version:010d}/_SUCCESS")
