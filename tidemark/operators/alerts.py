"""Alert rules over metric series: a condition must hold for a while before it fires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.joins import checked
from tidemark.functions.ordered import islands
from tidemark.operators.telemetry import counter_rate, histogram_quantile

# Rule, threshold, hold seconds, severity, component. All fire above the threshold.
RULES = (
    ("HighIOWait", 0.20, 120, "warning", "disk"),
    ("CPUHighUsage", 0.90, 120, "warning", "cpu"),
    ("MemoryPressure", 0.0, 120, "warning", "memory"),
    ("HighLatency", 0.5, 120, "warning", "api"),
    ("HighErrorRate", 0.01, 60, "critical", "api"),
    ("PoolExhaustion", 160.0, 120, "warning", "postgres"),
    ("RedisMemoryPressure", 0.90, 120, "warning", "redis"),
)
RULES_SCHEMA = "rule string, threshold double, hold_seconds int, severity string, component string"
CACHE_BYTES = 512 * 1024 * 1024


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULES_SCHEMA)


def alerts(series: DataFrame, rules: DataFrame) -> DataFrame:
    """Firing intervals of every rule and series.

    ``series(rule, series, ts, value)`` holds one value per evaluation. A run of evaluations
    above the threshold fires once it has lasted the hold time. Runs are islands, so a long
    series is cut by day and never ordered in one task.
    """
    judged = series.join(checked(rules), "rule").withColumn(
        "_on", (F.col("value") > F.col("threshold")).cast("int")
    )
    keys = ["rule", "series"]
    runs = islands(judged, keys, ["ts", "_on"], F.col("_prev._on") != F.col("_on"))
    held = (
        runs.where("_on = 1")
        .groupBy(*keys, "island", "severity", "component", "hold_seconds")
        .agg(F.max("ts").alias("last_true"), F.max("value").alias("peak"))
    )
    lasted = F.unix_micros("last_true") - F.unix_micros("island")
    return held.where(lasted >= F.col("hold_seconds").cast("bigint") * 1_000_000).select(
        *keys,
        "severity",
        "component",
        F.col("island").alias("pending_since"),
        F.timestamp_micros(
            F.unix_micros("island") + F.col("hold_seconds").cast("bigint") * 1_000_000
        ).alias("firing_since"),
        "last_true",
        "peak",
    )


def rule_series(samples: DataFrame, slide: int = 5) -> DataFrame:
    """The series of all rules from raw samples, evaluated every ``slide`` seconds.

    There is one series per label set, so hosts never add up; only the pool's connections are
    summed, quantiles leave out ``le`` and the error ratio ``status``.
    """

    def labelled(*without: str) -> DataFrame:
        """Samples with their label set, but for some labels, as one more label."""
        pairs = F.filter(F.map_entries("labels"), lambda e: ~e["key"].isin(*without))
        told = F.array_sort(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])))
        return samples.withColumn(
            "labels", F.map_concat("labels", F.create_map(F.lit("_set"), F.concat_ws(",", told)))
        )

    def cpu(mode: str) -> DataFrame:
        return counter_rate(
            labelled("mode"), "node_cpu_seconds_total", ["_set"], 120, slide,
            F.col("labels")["mode"] == mode,
        )

    def gauge(metric: str) -> DataFrame:
        return (
            labelled()
            .where(F.col("metric") == metric)
            .groupBy(F.col("labels")["_set"].alias("_set"), "ts")
            .agg(F.max("value").alias("v"))
        )

    def named(rule: str, df: DataFrame, value) -> DataFrame:
        ts = "window_start" if "window_start" in df.columns else "ts"
        return df.select(
            F.lit(rule).alias("rule"), F.col("_set").alias("series"), F.col(ts).alias("ts"),
            value.alias("value"),
        )

    swap = gauge("node_memory_SwapTotal_bytes").join(
        gauge("node_memory_SwapFree_bytes").withColumnRenamed("v", "free"), ["_set", "ts"]
    )
    buckets = counter_rate(
        labelled("le"), "http_request_duration_seconds_bucket", ["_set", "le"], 120, slide
    )
    latency = histogram_quantile(buckets, 0.95, ["window_start", "_set"], "rate")
    total = counter_rate(labelled("status"), "http_requests_total", ["_set", "status"], 60, slide)
    errors = total.groupBy("window_start", "_set").agg(
        F.sum(F.when(F.col("status").startswith("5"), F.col("rate")).otherwise(0.0)).alias("bad"),
        F.sum("rate").alias("all"),
    )
    pool = gauge("pg_stat_activity_count").groupBy("ts").agg(F.sum("v").alias("v"))
    return (
        named("HighIOWait", cpu("iowait"), F.col("rate"))
        .unionByName(named("CPUHighUsage", cpu("idle"), 1 - F.col("rate")))
        .unionByName(named("MemoryPressure", swap, F.col("v") - F.col("free")))
        .unionByName(named("HighLatency", latency, F.col("quantile")))
        .unionByName(named("HighErrorRate", errors, F.try_divide("bad", "all")))
        .unionByName(named("PoolExhaustion", pool.withColumn("_set", F.lit("")), F.col("v")))
        .unionByName(
            named(
                "RedisMemoryPressure",
                gauge("redis_memory_used_bytes"),
                F.col("v") / F.lit(float(CACHE_BYTES)),
            )
        )
    ).where("value is not null")
