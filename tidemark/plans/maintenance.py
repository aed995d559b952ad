"""Refresh jobs for the rollups, and checks that a rollup is fresh and right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.joins import beside
from tidemark.operators import rollups as R
from tidemark.operators.filters import between_ts, moment
from tidemark.sources.layout import publish_rollup
from tidemark.sources.paths import drop_folder, folders
from tidemark.sources.snapshots import Snapshots

BUCKET = {"hourly": "hour", "daily": "day"}
KEYS = {"hourly": R.HOURLY_KEY, "daily": R.DAILY_KEY, "global": R.GLOBAL_KEY}
# Days that an incremental refresh looks back.
LOOK_BACK_DAYS = {"hourly": 7, "daily": 30}


def build(kind: str, df: DataFrame) -> DataFrame:
    """Recompute one rollup; the daily one first measures which groups are large."""
    if kind == "hourly":
        return R.hourly_rollup(df)
    if kind == "daily":
        return R.daily_rollup(df, R.large_daily_groups(df))
    if kind == "global":
        return R.global_rollup(df)
    raise ValueError(f"unknown rollup {kind}")


def refresh(df: DataFrame, base: str, kind: str | None = None) -> dict[str, str]:
    """Fully refresh one or all rollups; readers keep the old version until each is done."""
    return {
        k: publish_rollup(build(k, df), f"{base}/{k}") for k in ([kind] if kind else KEYS)
    }


def refresh_global(df: DataFrame) -> DataFrame:
    return R.global_rollup(df)


def cutoff(as_of: str | Column, days: int, bucket: str) -> Column:
    """Start of the bucket that lies ``days`` before ``as_of``: boundary buckets stay whole."""
    return F.date_trunc(bucket, moment(as_of) - F.make_dt_interval(F.lit(days)))


def refresh_hourly(old: DataFrame, df: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return _refreshed("hourly", old, df, as_of, days)


def refresh_daily(old: DataFrame, df: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return _refreshed("daily", old, df, as_of, days)


def _refreshed(kind: str, old: DataFrame, df: DataFrame, as_of: str, days: int) -> DataFrame:
    edge = cutoff(as_of, days, BUCKET[kind])
    kept = old.where(F.col(BUCKET[kind]) < edge)
    return kept.unionByName(build(kind, between_ts(df, frm=edge)))


def write_rollup_by_date(rollup: DataFrame, bucket: str, path: str) -> None:
    """Replace exactly the bucket dates that ``rollup`` holds, other dates stay untouched.

    Rebalancing gathers each date in few files and splits a date that is too large for one.
    """
    (
        rollup.withColumn("bucket_date", F.to_date(bucket))
        .hint("rebalance", "bucket_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket_date")
        .parquet(path)
    )


def refresh_recent_dates(
    df: DataFrame, path: str, kind: str, as_of: str, days: int | None = None
) -> None:
    """Incremental refresh of a table written by ``write_rollup_by_date``.

    Reads only the readings of the look-back and rewrites only their dates. The cutoff is
    aligned to a day, so that no date is replaced by part of it. Dates of the look-back that
    have no readings any more are dropped; there is a folder a date, so the list is short.
    """
    edge = cutoff(as_of, LOOK_BACK_DAYS[kind] if days is None else days, "day")
    recent = between_ts(df, frm=edge)
    write_rollup_by_date(build(kind, recent), BUCKET[kind], path)
    there = {str(r["d"]) for r in recent.select(F.to_date("ts").alias("d")).distinct().collect()}
    first = str(df.sparkSession.range(1).select(F.to_date(edge).alias("d")).first()["d"])
    for name in folders(df.sparkSession, path):
        date = name.removeprefix("bucket_date=")
        if name.startswith("bucket_date=") and first <= date and date not in there:
            drop_folder(df.sparkSession, f"{path}/{name}")


def refresh_snapshot(table: Snapshots, rollup: DataFrame, bucket: str) -> int:
    """A whole rollup, by bucket date, as the next version; readers keep the one they pinned."""
    return table.replace(rollup.withColumn("bucket_date", F.to_date(bucket)), F.lit(True))


def refresh_recent_snapshot(
    table: Snapshots, df: DataFrame, kind: str, as_of: str, days: int | None = None
) -> int:
    """Incremental refresh of a rollup kept in versions.

    Reads the readings of the look-back, from the start of its first day, and replaces all
    files of its dates in one commit, so dates without readings any more are gone as well and
    nobody sees some dates refreshed and others not.
    """
    edge = cutoff(as_of, LOOK_BACK_DAYS[kind] if days is None else days, "day")
    recent = build(kind, between_ts(df, frm=edge))
    recent = recent.withColumn("bucket_date", F.to_date(BUCKET[kind]))
    return table.replace(recent, F.col("part") >= F.to_date(edge))


def read_rollup_by_date(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket_date")


def rollup_lag(df: DataFrame, rollup: DataFrame, bucket: str = "hour") -> DataFrame:
    newest = df.agg(F.max("ts").alias("latest_data"))
    built = rollup.agg(F.max(bucket).alias("latest_bucket"))
    return beside(newest, built).select(
        "latest_data",
        "latest_bucket",
        ((F.unix_micros("latest_data") - F.unix_micros("latest_bucket")) / 1_000_000).alias(
            "lag_seconds"
        ),
    )


def rollup_status(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, one row each."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        out = row if out is None else out.unionByName(row)
    return out


def rollup_diff(expected: DataFrame, rollup: DataFrame, kind: str) -> DataFrame:
    """Keys whose rows differ between a recomputed rollup and a stored one; none when equal."""
    keys = KEYS[kind]
    values = [c for c in expected.columns if c not in keys]
    left = expected.select(*keys, F.struct(*values).alias("_expected"))
    right = rollup.select(*keys, F.struct(*values).alias("_stored"))
    joined = left.join(right, keys, "full_outer").where(
        ~F.col("_expected").eqNullSafe(F.col("_stored"))
    )
    return joined.select(
        *keys,
        F.when(F.col("_stored").isNull(), "missing")
        .when(F.col("_expected").isNull(), "surplus")
        .otherwise("different")
        .alias("difference"),
    )
