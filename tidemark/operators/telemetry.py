"""Analytics over request logs and metric samples.

Log columns: ``ts, request_id, method, endpoint, status, duration_ms, size_bytes, key, rows``,
``duration_ms`` a decimal. Sample columns: ``ts, metric, labels map<string,string>, le, value``.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import beside, checked, on_same
from tidemark.functions.numbers import power_sums, units
from tidemark.functions.ordered import previous
from tidemark.functions.percentiles import exact_percentiles

# Histogram bounds in seconds and bytes.
LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
SIZE_BOUNDS = (100, 1000, 10000, 100000, 1000000, 10000000)

SUMMARY_PERCENTS = [50, 90, 95, 99]

# A sketch of this size errs by 0.33 % of rank in 99 of 100 cases; three times that is allowed.
SKETCH_SIZE = 800
SKETCH_ERROR = 0.01


def is_error() -> Column:
    return F.col("status").between(500, 599)


def windowed(df: DataFrame, seconds: int) -> DataFrame:
    """Add ``window_start`` of the window that the row falls into."""
    return df.withColumn("window_start", F.window("ts", f"{seconds} seconds")["start"])


def paned(df: DataFrame, by: list[str], seconds: int, slide: int | None, totals: dict[str, Column]) -> DataFrame:
    """Totals per window and ``by``: counts or sums, taken once per pane and added up.

    A pane is the longest stretch that both lengths are multiples of. Rows are aggregated to
    panes; only pane totals are repeated for the windows that hold them, so a window of 120
    seconds every 5 repeats 24 numbers a pane and no row. Serves streams with a watermark, too.
    """
    pane = gcd(seconds, slide or seconds)
    panes = df.groupBy(F.window("ts", f"{pane} seconds").alias("_pane"), *by).agg(
        *[total.alias(name) for name, total in totals.items()]
    )
    if not slide or slide == seconds:
        return panes.select(F.col("_pane.start").alias("window_start"), *by, *totals)
    windows = F.window(F.col("_pane"), f"{seconds} seconds", f"{slide} seconds")
    summed = panes.groupBy(windows.alias("_window"), *by).agg(*[F.sum(n).alias(n) for n in totals])
    return summed.select(F.col("_window.start").alias("window_start"), *by, *totals)


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))


def _histogram(df: DataFrame, measure: Column, bounds: tuple, by: list[str], total: str) -> DataFrame:
    """Cumulative count per bound, with +Inf, and the sum and count of all observations."""
    cells = df.withColumn("_m", measure).groupBy(*by).agg(
        *[F.count_if(F.col("_m") <= F.lit(str(b)).cast("decimal(20,6)")).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count("_m").alias("observations"),
        F.sum("_m").cast("double").alias(total),
    )
    rows = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
        for i, b in enumerate(bounds)
    ]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("observations").alias("cumulative")))
    return cells.select(*by, "observations", total, F.inline(F.array(*rows)))


def latency_histogram(log: DataFrame, by: tuple[str, ...] = ("method", "endpoint")) -> DataFrame:
    seconds = (F.col("duration_ms").cast("decimal(20,3)") / 1000).cast("decimal(20,6)")
    return _histogram(log, seconds, LATENCY_BOUNDS, list(by), "seconds")


def size_histogram(log: DataFrame, by: tuple[str, ...] = ("method", "endpoint")) -> DataFrame:
    """Responses without a body are not observed."""
    sent = log.where(F.col("size_bytes") > 0)
    return _histogram(sent, F.col("size_bytes").cast("decimal(20,0)"), SIZE_BOUNDS, list(by), "bytes")


def histogram_quantile(hist: DataFrame, q: float, by: list[str], count: str = "cumulative") -> DataFrame:
    """Quantile estimate by linear interpolation in the first bucket that reaches the rank.

    A rank in the +Inf bucket gives the largest finite bound; an empty histogram gives null.
    """
    ordered = Window.partitionBy(*by).orderBy("le")
    cells = hist.select(
        *by,
        "le",
        F.col(count).alias("_cum"),
        F.lag("le", 1, 0.0).over(ordered).alias("_low"),
        F.coalesce(F.lag(count).over(ordered), F.lit(0)).alias("_before"),
        F.max(count).over(Window.partitionBy(*by)).alias("_total"),
    ).withColumn("_rank", F.lit(q) * F.col("_total"))
    first = cells.groupBy(*by).agg(
        F.min_by(
            F.struct("le", "_cum", "_low", "_before", "_total", "_rank"),
            F.when(F.col("_cum") >= F.col("_rank"), F.col("le")),
        ).alias("c")
    )
    part = F.try_divide(F.col("c._rank") - F.col("c._before"), F.col("c._cum") - F.col("c._before"))
    inside = F.col("c._low") + (F.col("c.le") - F.col("c._low")) * part
    return first.select(
        *by,
        F.when(F.col("c._total") == 0, F.lit(None).cast("double"))
        .when(F.col("c.le") == float("inf"), F.col("c._low"))
        .otherwise(inside)
        .alias("quantile"),
    )


def hit_ratio(log: DataFrame, seconds: int = 300, slide: int | None = None) -> DataFrame:
    """Cache hits of hits and misses per window; null when a window has neither."""
    hits = F.count_if(F.col("cache_status") == "HIT")
    misses = F.count_if(F.col("cache_status") == "MISS")
    counted = paned(log, [], seconds, slide, {"hits": hits, "misses": misses})
    return counted.withColumn("hit_ratio", F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")))


def error_ratio(log: DataFrame, seconds: int = 300, slide: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Share of 5xx responses per window that has requests."""
    totals = {"errors": F.count_if(is_error()), "requests": F.count(F.lit(1))}
    counted = paned(log, by or [], seconds, slide, totals)
    return counted.withColumn("error_ratio", F.col("errors") / F.col("requests"))


def _label(name: str) -> Column:
    return F.col("labels")[name].alias(name)


def series_key() -> Column:
    """One text per label set, whatever the order of the map."""
    pairs = F.transform(F.map_entries("labels"), lambda e: F.concat_ws("\u0001", e["key"], e["value"]))
    return F.concat_ws("\u0002", "metric", F.array_sort(pairs), F.col("le").cast("string"))


def counter_increase(samples: DataFrame, metric: str) -> DataFrame:
    """Samples of a counter with what it grew since the previous sample of its series.

    A counter that fell was reset and has grown by its new value. A first sample has no growth.
    """
    series = samples.where(F.col("metric") == metric).withColumn("_series", series_key())
    with_prev = previous(series, ["_series"], ["ts"], ["ts", "value"])
    fell = F.col("value") < F.col("_prev.value")
    return with_prev.withColumn(
        "increase",
        F.when(F.col("_prev").isNull(), F.lit(None))
        .when(fell, F.col("value"))
        .otherwise(F.col("value") - F.col("_prev.value")),
    ).drop("_prev", "_series")


def counter_rate(
    samples: DataFrame, metric: str, by: list[str], seconds: int = 300, slide: int | None = None, where: Column | None = None
) -> DataFrame:
    """Growth per second of each label combination in each window, reset-aware."""
    grown = counter_increase(samples, metric)
    if where is not None:
        grown = grown.where(where)
    names = [_label(b) if b != "le" else F.col("le") for b in by]
    rows = grown.where("increase is not null").select("ts", *names, "increase")
    summed = paned(rows, by, seconds, slide, {"rate": F.sum("increase")})
    return summed.withColumn("rate", F.col("rate") / seconds)


def ratio_of(samples: DataFrame, num: str, den: str, by: list[str], seconds: int = 300) -> DataFrame:
    """Quotient of two counter rates per window and label combination; null when idle."""
    keys = ["window_start", *by]
    top = counter_rate(samples, num, by, seconds).withColumnRenamed("rate", "num")
    bottom = counter_rate(samples, den, by, seconds).withColumnRenamed("rate", "den")
    return top.join(bottom, keys).withColumn("ratio", F.try_divide("num", "den"))


def share_of(samples: DataFrame, part: str, rest: str, by: list[str], seconds: int = 300) -> DataFrame:
    """part / (part + rest) of two counter rates, such as buffer hits against reads."""
    both = ratio_of(samples, part, rest, by, seconds)
    return both.withColumn("ratio", F.try_divide(F.col("num"), F.col("num") + F.col("den")))


def mean_from_hist(samples: DataFrame, base: str, by: list[str], seconds: int = 300) -> DataFrame:
    """Mean observation and observed amount per second, from a histogram's sum and count."""
    means = ratio_of(samples, f"{base}_sum", f"{base}_count", by, seconds)
    return means.select("window_start", *by, F.col("num").alias("per_second"), F.col("ratio").alias("mean"))


def wait_per_operation(samples: DataFrame, by: list[str], seconds: int = 60) -> DataFrame:
    """Disk reads and writes per second and the milliseconds that one of them waited."""

    def of(operation: str) -> DataFrame:
        both = ratio_of(
            samples, f"node_disk_{operation}_time_seconds_total", f"node_disk_{operation}s_completed_total",
            by, seconds,
        )
        return both.select(
            "window_start", *by, F.lit(operation).alias("operation"),
            F.col("den").alias("per_second"), (F.col("ratio") * 1000).alias("wait_ms"),
        )

    return of("read").unionByName(of("write"))


def gauge_last(samples: DataFrame, metric: str, by: list[str]) -> DataFrame:
    rows = samples.where(F.col("metric") == metric).select("ts", "value", *[_label(b) for b in by])
    return rows.groupBy(*by).agg(
        F.max_by("value", "ts").alias("latest"), F.max("value").alias("peak")
    )


def gauge_share(samples: DataFrame, metric: str, limit: float | str) -> DataFrame:
    """Sum of a gauge per sample time as a share of a limit, given or itself a gauge."""
    used = samples.where(F.col("metric") == metric).groupBy("ts").agg(F.sum("value").alias("used"))
    if isinstance(limit, str):
        bound = samples.where(F.col("metric") == limit).groupBy("ts").agg(F.max("value").alias("bound"))
        used = used.join(bound, "ts")
    else:
        used = used.withColumn("bound", F.lit(float(limit)))
    return used.withColumn("share", F.try_divide("used", "bound"))


def run_summary(log: DataFrame, by: list[str], percents: list[int] | None = None) -> DataFrame:
    """Request count, rate, error share and latency statistics per group, exact.

    A group is often one endpoint with most of the log, so percentiles come from counts per
    distinct duration rather than from gathered rows.
    """
    percents = percents or SUMMARY_PERCENTS
    kind = log.schema["duration_ms"].dataType
    step = float(10**kind.scale)
    whole = units(F.col("duration_ms"), kind.scale)
    sums = log.groupBy(*by).agg(
        *power_sums(whole)[:2],
        F.count(F.lit(1)).alias("requests"),
        F.count_if(is_error()).alias("errors"),
        F.min("duration_ms").alias("_min"),
        F.max("duration_ms").alias("_max"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000).alias("_span"),
    )
    ranks = exact_percentiles(log, by, whole, percents, kind.precision)
    both = on_same(sums, ranks, by, "left") if by else beside(sums, ranks)
    return both.select(
        *by,
        "requests",
        "errors",
        (F.col("errors") / F.col("requests")).alias("error_share"),
        F.try_divide(F.col("requests").cast("double"), F.col("_span")).alias("requests_per_second"),
        (F.col("s").cast("double") / F.col("n") / step).alias("avg_ms"),
        F.col("_min").cast("double").alias("min_ms"),
        F.col("_max").cast("double").alias("max_ms"),
        *[(F.col(f"p{p}_x100") / (100 * step)).alias(f"p{p}_ms") for p in percents],
    )


def segment_latency(log: DataFrame, segment: Column, percents: list[int] | None = None) -> DataFrame:
    return run_summary(log.withColumn("segment", segment), ["segment"], percents)


def by_heat(log: DataFrame, hot: DataFrame) -> DataFrame:
    """Mark requests of the devices listed in ``hot``."""
    listed = checked(hot.select("device_id").withColumn("_hot", F.lit(True)))
    marked = log.join(listed, "device_id", "left")
    return marked.withColumn("heat", F.when(F.col("_hot"), "hot").otherwise("cold")).drop("_hot")


def by_third(log: DataFrame) -> DataFrame:
    """Mark the first, second and last third of the run as cold, warm and hot."""
    span = log.agg(F.unix_micros(F.min("ts")).alias("_a"), F.unix_micros(F.max("ts")).alias("_b"))
    at = (F.unix_micros("ts") - F.col("_a")) * 3
    length = F.col("_b") - F.col("_a")
    phase = F.when(at < length, "cold").when(at < length * 2, "warm").otherwise("hot")
    return beside(log, span).withColumn("phase", phase).drop("_a", "_b")


def range_class(seconds: Column) -> Column:
    """Class of a requested time range."""
    return F.when(seconds <= 3600, "1h").when(seconds <= 86400, "24h").otherwise("7d")


def query_tier() -> Column:
    """Tier of a parsed request by what it asks for: an id, a device's time range, a device, or neither."""
    return (
        F.when(F.col("mode") == "id", "pk_lookup")
        .when(F.col("device_id").isNull(), "stats_agg")
        .when(F.col("from_ts").isNotNull() | F.col("to_ts").isNotNull(), "time_range")
        .otherwise("device_filter")
    )


def concurrent_users(log: DataFrame, by: list[str], seconds: int, user: str = "device_id") -> DataFrame:
    """The most distinct users that were active in one window of each group."""
    active = windowed(log, seconds).groupBy(*by, "window_start").agg(F.count_distinct(user).alias("_users"))
    return active.groupBy(*by).agg(F.max("_users").alias("concurrent_users"))


def latency_sketches(log: DataFrame, by: list[str], seconds: int = 86400) -> DataFrame:
    """A quantile sketch of the durations, in their smallest unit, per window and group.

    Sketches of any windows unite to the sketch of all their requests (``sketched_quantiles``).
    """
    whole = units(F.col("duration_ms"), log.schema["duration_ms"].dataType.scale).cast("bigint")
    rows = windowed(log.where("duration_ms is not null"), seconds)
    return rows.groupBy("window_start", *by).agg(F.kll_sketch_agg_bigint(whole, SKETCH_SIZE).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, by: list[str], percents: list[int] | None = None) -> DataFrame:
    """Requests and estimated percentiles per group, in the smallest unit of the durations.

    The share of requests below an estimate is off by less than ``SKETCH_ERROR``, whatever
    windows were united.
    """
    united = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("_all"))
    return united.select(
        *by,
        F.kll_sketch_get_n_bigint("_all").alias("requests"),
        *[
            F.kll_sketch_get_quantile_bigint("_all", F.lit(p / 100)).alias(f"p{p}")
            for p in percents or SUMMARY_PERCENTS
        ],
    )


def mix_share(log: DataFrame, kind: str = "endpoint") -> DataFrame:
    """Share of each request kind."""
    counts = log.groupBy(kind).agg(F.count(F.lit(1)).alias("requests"))
    total = log.agg(F.count(F.lit(1)).alias("_total"))
    share = F.col("requests") / F.col("_total")
    return beside(counts, total).select(kind, "requests", share.alias("share"))


def load_steps(log: DataFrame, seconds: int = 30, p95_ms: float = 2000, errors: float = 0.10) -> DataFrame:
    """One row per load step with its rate and whether it passed."""
    steps = run_summary(windowed(log, seconds), ["window_start"], [95])
    passed = (F.col("p95_ms") < p95_ms) & (F.col("error_share") < errors)
    return steps.select(
        "window_start",
        "requests",
        (F.col("requests") / seconds).alias("rate"),
        "error_share",
        "p95_ms",
        passed.alias("passed"),
    )


def load_ceiling(log: DataFrame, seconds: int = 30, p95_ms: float = 2000, errors: float = 0.10) -> DataFrame:
    """The last step before the first failing one, with the highest rate sustained until then."""
    steps = load_steps(log, seconds, p95_ms, errors)
    failed = steps.agg(F.min(F.when(~F.col("passed"), F.col("window_start"))).alias("first_failure"))
    held = beside(steps, failed).where(
        F.col("first_failure").isNull() | (F.col("window_start") < F.col("first_failure"))
    )
    return held.agg(
        F.count(F.lit(1)).alias("steps_held"),
        F.max("window_start").alias("last_step"),
        F.max_by("rate", "window_start").alias("last_rate"),
        F.max("rate").alias("highest_rate"),
    )


def probe_rollup(checks: DataFrame) -> DataFrame:
    """Overall status per probe: any failure degrades, a failed database is fatal."""
    bad = F.col("status") != "healthy"
    return checks.groupBy("probe_ts").agg(
        F.when(F.bool_or(bad & (F.col("dependency") == "database")), "unhealthy")
        .when(F.bool_or(bad), "degraded")
        .otherwise("healthy")
        .alias("status"),
        F.max("latency_ms").alias("slowest_ms"),
    )


def availability(checks: DataFrame) -> DataFrame:
    """Share of healthy probes per dependency and hour."""
    return (
        checks.withColumn("hour", F.date_trunc("hour", "probe_ts"))
        .groupBy("dependency", "hour")
        .agg(
            F.count(F.lit(1)).alias("probes"),
            F.count_if(F.col("status") == "healthy").alias("healthy"),
        )
        .withColumn("availability", F.col("healthy") / F.col("probes"))
    )
