"""Windowed metrics of a request log that arrives continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.telemetry import LATENCY_BOUNDS, is_error, paned
from tidemark.streaming.rollups import _start


def window_metrics(log: DataFrame, seconds: int = 300, slide: int = 60) -> DataFrame:
    """Counts, errors, reuse and the latency histogram per sliding window and endpoint.

    The same function serves a batch and a stream; a stream needs a watermark on ``ts``.
    """
    totals = {
        "requests": F.count(F.lit(1)),
        "errors": F.count_if(is_error()),
        "hits": F.count_if(F.col("cache_status") == "HIT"),
        "misses": F.count_if(F.col("cache_status") == "MISS"),
    }
    for i, b in enumerate(LATENCY_BOUNDS):
        within = F.col("duration_ms") <= F.lit(str(b * 1000)).cast("decimal(20,3)")
        totals[f"le_{i}"] = F.count_if(within)
    counted = paned(log, ["endpoint"], seconds, slide, totals)
    return counted.select(
        "*",
        (F.col("errors") / F.col("requests")).alias("error_ratio"),
        F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_ratio"),
    )


def continuous_metrics(
    log: DataFrame,
    path: str,
    checkpoint: str,
    late: str = "10 minutes",
    seconds: int = 300,
    slide: int = 60,
    every: str | None = None,
) -> StreamingQuery:
    """Append each window's metrics once it is closed."""
    metrics = window_metrics(log.withWatermark("ts", late), seconds, slide)
    return _start(metrics.writeStream.format("parquet").option("path", path), checkpoint, every)
