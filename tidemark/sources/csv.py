"""Bulk load of headerless CSV readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import shared_folder, use_utc
from tidemark.spec import READING_COLUMNS

# Column order and time format of the load files.
CSV_SCHEMA = (
    "device_id string, ts timestamp, reading_type string, value decimal(10,2), unit string, "
    "_corrupt string"
)
CSV_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def load_csv(
    spark: SparkSession, path: str, start_id: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(readings with ids from ``start_id``, lines that did not parse).

    Ids follow file order and leave gaps only where a line did not parse. The typed rows are
    written once to the shared folder with the partition that read them and their place in it.
    The rows per partition there give each partition its first id, so no row is ever ordered
    globally, and a lost executor cannot renumber rows.
    """
    use_utc(spark)
    raw = spark.read.schema(CSV_SCHEMA).csv(
        path,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord="_corrupt",
        timestampFormat=CSV_TIME_FORMAT,
    )
    place = F.monotonically_increasing_id()
    staged_path = shared_folder(spark, "csv-load")
    raw.select(
        "*",
        F.shiftright(place, 33).alias("_part"),
        place.bitwiseAND((1 << 33) - 1).alias("_row"),
    ).write.parquet(staged_path)
    staged = spark.read.parquet(staged_path)
    good = staged.where("_corrupt is null")
    bad = staged.where("_corrupt is not null").select(F.col("_corrupt").alias("line"))

    ordered = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        staged.groupBy("_part")
        .agg(F.max("_row").alias("_rows"))
        .select("_part", F.coalesce(F.sum(F.col("_rows") + 1).over(ordered), F.lit(0)).alias("_first"))
    )
    # One row per input split: Spark picks the join by its size.
    numbered = good.join(firsts, "_part").withColumn(
        "id", F.col("_first") + F.col("_row") + F.lit(start_id)
    )
    return numbered.withColumn("metadata", F.lit("{}")).select(*READING_COLUMNS), bad


def append_readings(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
