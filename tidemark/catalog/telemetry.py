"""Registered queries over request logs and metric samples derived from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.catalog.tables import READINGS_SQL, REQUESTS_SQL, events, plain, requests_at
from tidemark.operators import alerts as K
from tidemark.operators import reuse as U
from tidemark.operators import telemetry as T
from tidemark.operators import verdicts as V
from tidemark.operators.aggregates import top_devices
from tidemark.operators.filters import slow_requests
from tidemark.functions.ordered import gap_islands
from tidemark.session import written

CATALOG: dict = {}


def log(s, d) -> DataFrame:
    """Requests of the event table: endpoint, status, latency and size."""
    k = F.get_json_object("metadata", "$.k").cast("int")
    return events(s, d).select(
        "ts",
        (F.col("id") - 1).alias("request_id"),
        F.lit("GET").alias("method"),
        F.col("reading_type").alias("endpoint"),
        F.when(F.col("reading_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("duration_ms"),
        (k * 1000).cast("bigint").alias("size_bytes"),
        F.concat_ws(":", "device_id", "reading_type").alias("key"),
        k.alias("rows"),
        "device_id",
    )


LOG_SQL = READINGS_SQL.strip() + """,
log AS (
  SELECT ts, id - 1 AS request_id, 'GET' AS method, reading_type AS endpoint,
         CASE WHEN reading_type = 'error' THEN 500 ELSE 200 END AS status, cents, value AS duration_ms,
         CAST(json_extract_string(metadata, '$.k') AS INTEGER) * 1000 AS size_bytes,
         device_id || ':' || reading_type AS key,
         CAST(json_extract_string(metadata, '$.k') AS INTEGER) AS rows, device_id
  FROM readings)"""

SCRAPE = 600


def samples(s, d) -> DataFrame:
    """Counters per endpoint scraped every ten minutes and restarted every midnight, and gauges."""
    base = log(s, d).withColumn(
        "at", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / SCRAPE) * SCRAPE + SCRAPE)
    ).withColumn("day", F.to_date("ts"))
    cents = (F.col("duration_ms") * 100).cast("bigint")
    bounds = [*T.LATENCY_BOUNDS, float("inf")]
    operations = {"read": F.col("rows") >= 40, "write": F.col("rows") < 40}
    counts = base.groupBy("endpoint", "status", "day", "at").agg(
        F.count(F.lit(1)).alias("http_requests_total"),
        F.sum(cents).alias("http_request_duration_seconds_sum"),
        F.count(F.lit(1)).alias("http_request_duration_seconds_count"),
        F.sum("rows").alias("pg_stat_database_blks_hit"),
        F.sum(F.lit(100) - F.col("rows")).alias("pg_stat_database_blks_read"),
        *[F.count_if(is_op).alias(f"node_disk_{op}s_completed_total") for op, is_op in operations.items()],
        *[F.sum(F.when(is_op, cents).otherwise(0)).alias(f"node_disk_{op}_time_seconds_total")
          for op, is_op in operations.items()],
        *[F.count_if(cents <= b * 100000).alias(f"le{i}") for i, b in enumerate(bounds)],
    )
    running = Window.partitionBy("endpoint", "day").orderBy("at")
    plain_names = [c for c in counts.columns[4:] if not c.startswith("le")]
    cells = [F.struct(F.lit(n).alias("metric"), F.lit(None).cast("double").alias("le"),
                      F.sum(n).over(running).cast("double").alias("value")) for n in plain_names]
    cells += [F.struct(F.lit("http_request_duration_seconds_bucket").alias("metric"), F.lit(float(b)).alias("le"),
                       F.sum(f"le{i}").over(running).cast("double").alias("value")) for i, b in enumerate(bounds)]
    labels = F.create_map(F.lit("endpoint"), F.col("endpoint"), F.lit("status"), F.col("status").cast("string"))
    counters = counts.select("at", labels.alias("labels"), F.array(*cells).alias("cells")).select(
        F.col("at").alias("ts"), "labels", F.inline("cells"))
    gauges = log(s, d).select(
        "ts", F.create_map(F.lit("endpoint"), F.col("endpoint"), F.lit("device"), F.col("device_id")).alias("labels"),
        F.lit(None).cast("double").alias("le"),
        F.inline(F.array(
            F.struct(F.lit("http_requests_in_flight").alias("metric"), F.col("rows").cast("double").alias("value")),
            F.struct(F.lit("pg_settings_max_connections").alias("metric"), (F.col("rows") + 100).cast("double").alias("value")),
        )))
    return counters.unionByName(gauges)


def counters_sql(cells: dict[str, str]) -> str:
    """Cumulative values per endpoint and day, and their growth with the midnight restart."""
    sums = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in cells.items())
    runs = ", ".join(f"sum({n}) OVER (PARTITION BY endpoint, day ORDER BY scraped_at) AS {n}" for n in cells)
    grown = ", ".join(
        f"CASE WHEN lag({n}) OVER w IS NULL THEN NULL WHEN {n} < lag({n}) OVER w THEN {n} ELSE {n} - lag({n}) OVER w END AS {n}"
        for n in cells)
    return f"""
scraped AS (SELECT endpoint, status, CAST(ts AS DATE) AS day,
    to_timestamp(CAST(epoch_us(ts) // 1000000 // {SCRAPE} * {SCRAPE} + {SCRAPE} AS DOUBLE))::TIMESTAMP AS scraped_at, {sums} FROM log GROUP BY ALL),
cumulated AS (SELECT endpoint, status, day, scraped_at, {runs} FROM scraped),
grown AS (SELECT endpoint, status, scraped_at, {grown} FROM cumulated WINDOW w AS (PARTITION BY endpoint ORDER BY scraped_at))"""


def bucket_sql(seconds: int, col: str = "ts") -> str:
    return f"to_timestamp(CAST(epoch_us({col}) // 1000000 // {seconds} * {seconds} AS DOUBLE))::TIMESTAMP"


def add(name: str, query, sql: str | None, prefix: str = LOG_SQL) -> None:
    CATALOG[name] = (query, f"WITH {prefix} {sql}" if sql else None)


def pct(p: int, a: str = "vals") -> str:
    i, f = f"((len({a}) - 1) * {p}) // 100", f"(((len({a}) - 1) * {p}) % 100)"
    return f"({a}[{i} + 1] * (100 - {f}) + {a}[least({i} + 2, len({a}))] * {f}) / CAST(10000 AS DOUBLE)"


def summary_sql(by: str, source: str = "log") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
grouped AS (SELECT {keys}count(*) AS requests, count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS errors,
    CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
    CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000 AS span, list_sort(list(cents)) AS vals
  FROM {source} {group}),
summary AS (SELECT {keys}requests, errors, CAST(errors AS DOUBLE) / requests AS error_share,
    requests / nullif(span, 0) AS requests_per_second, avg_ms, min_ms, max_ms,
    {pct(50)} AS p50_ms, {pct(90)} AS p90_ms, {pct(95)} AS p95_ms, {pct(99)} AS p99_ms FROM grouped)"""


def _no_inf(df: DataFrame) -> DataFrame:
    return df.withColumn("le", F.when(F.col("le") < float("inf"), F.col("le")))


# Keys and reuse
add("request_keys", lambda s, d: requests_at(s, d).where("error_code is null").select("request_id", U.request_key().alias("key")),
    """SELECT request_id, CASE WHEN mode = 'id' THEN 'sensor:id:' || row_id ELSE
    'sensor:' || device_id || ':readings:' || n || CASE WHEN reading_type <> '' THEN ':' || reading_type ELSE '' END
    || coalesce(':' || CAST(epoch_us(from_ts) // 1000000 AS VARCHAR), '') || coalesce(':' || CAST(epoch_us(to_ts) // 1000000 AS VARCHAR), '') END AS key
    FROM checked WHERE error_param IS NULL""", f"{READINGS_SQL.strip()}, {REQUESTS_SQL.strip()}")
add("request_keys_unambiguous", lambda s, d: requests_at(s, d).where("error_code is null").select("request_id", U.unambiguous_key().alias("key")),
    """SELECT request_id, CASE WHEN mode = 'id' THEN 'id:' || row_id ELSE concat('device:', device_id, ':', n, ':', reading_type, ':',
    CAST(epoch_us(from_ts) AS VARCHAR), ':', CAST(epoch_us(to_ts) AS VARCHAR)) END AS key
    FROM checked WHERE error_param IS NULL""", f"{READINGS_SQL.strip()}, {REQUESTS_SQL.strip()}")


def reuse_sql(key: str, ttl: int) -> str:
    return f"""RECURSIVE {LOG_SQL},
keyed AS (SELECT request_id, {key} AS key, epoch_us(ts) AS t, status, rows FROM log),
fillable AS (SELECT key, t, min(request_id) AS id FROM keyed WHERE status = 200 AND rows > 0 GROUP BY key, t),
fills AS (SELECT key, min(t) AS t FROM fillable GROUP BY key UNION ALL
  SELECT f.key, min(x.t) AS t FROM fills f JOIN fillable x ON x.key = f.key AND x.t >= f.t + {ttl}000000 GROUP BY f.key, f.t),
opened AS (SELECT key, t, id FROM fills JOIN fillable USING (key, t)),
judged AS (SELECT k.request_id, k.key, CASE WHEN max(o.t) IS NOT NULL AND k.t < max(o.t) + {ttl}000000 THEN 'HIT' ELSE 'MISS' END AS cache_status
  FROM keyed k LEFT JOIN opened o ON o.key = k.key AND (o.t < k.t OR (o.t = k.t AND o.id < k.request_id))
  GROUP BY k.request_id, k.key, k.t)"""


add("cache_reuse", lambda s, d: U.ttl_status(log(s, d).withColumn("key", F.col("endpoint")), 900).select("request_id", "key", "cache_status"),
    "SELECT * FROM judged", reuse_sql("endpoint", 900))
add("cache_reuse_by_device", lambda s, d: U.ttl_status(log(s, d), 86400).select("request_id", "key", "cache_status"),
    "SELECT * FROM judged", reuse_sql("key", 86400))
add("cache_reuse_default", lambda s, d: U.ttl_status(log(s, d).withColumn("key", F.lit("all")), 30).select("request_id", "key", "cache_status"),
    "SELECT * FROM judged", reuse_sql("'all'", 30))
add("hit_ratio", lambda s, d: plain(T.hit_ratio(U.ttl_status(log(s, d).withColumn("key", F.col("endpoint")), 900), 3600)),
    f"""SELECT {bucket_sql(3600)} AS window_start, count(*) FILTER (WHERE cache_status = 'HIT') AS hits,
    count(*) FILTER (WHERE cache_status = 'MISS') AS misses,
    CAST(count(*) FILTER (WHERE cache_status = 'HIT') AS DOUBLE) / count(*) AS hit_ratio
    FROM judged JOIN log USING (request_id) GROUP BY 1""", reuse_sql("endpoint", 900))

# Counts, histograms, rates
add("request_counts", lambda s, d: T.request_counts(log(s, d)),
    "SELECT method, endpoint, status, count(*) AS requests FROM log GROUP BY ALL")
LAT_LE = ", ".join(str(b) for b in T.LATENCY_BOUNDS)
SIZE_LE = ", ".join(str(b) for b in T.SIZE_BOUNDS)


def hist_sql(measure: str, bounds: str, total: str, where: str = "true") -> str:
    """Measure in whole small units; bounds given in the same units with their label."""
    return f"""
base AS (SELECT method, endpoint, {measure} AS m FROM log WHERE {where}),
totals AS (SELECT method, endpoint, count(*) AS observations, {total} FROM base GROUP BY ALL),
les AS (SELECT unnest([{bounds}, NULL])::DOUBLE AS le),
hist AS (SELECT t.method, t.endpoint, t.observations, {total.split(' AS ')[-1]}, le,
    (SELECT count(*) FROM base b WHERE b.endpoint = t.endpoint AND b.method = t.method AND (le IS NULL OR b.m <= le * {{scale}})) AS cumulative
  FROM totals t, les)"""


LAT_HIST = hist_sql("cents", LAT_LE, "CAST(sum(m) AS DOUBLE) / 100000 AS seconds").replace("{scale}", "100000")
SIZE_HIST = hist_sql("size_bytes", SIZE_LE, "CAST(sum(m) AS DOUBLE) AS bytes", "size_bytes > 0").replace("{scale}", "1")
add("latency_histogram", lambda s, d: _no_inf(T.latency_histogram(log(s, d))), f", {LAT_HIST} SELECT * FROM hist")
add("size_histogram", lambda s, d: _no_inf(T.size_histogram(log(s, d))), f", {SIZE_HIST} SELECT * FROM hist")


def quantile_sql(q: float, keys: str = "endpoint", cum: str = "cumulative", source: str = "hist") -> str:
    return f"""
cells AS (SELECT {keys}, coalesce(le, 'Infinity'::DOUBLE) AS le, {cum} AS cum, max({cum}) OVER (PARTITION BY {keys}) AS total,
    coalesce(lag(le) OVER (PARTITION BY {keys} ORDER BY coalesce(le, 'Infinity'::DOUBLE)), 0) AS low,
    coalesce(lag({cum}) OVER (PARTITION BY {keys} ORDER BY coalesce(le, 'Infinity'::DOUBLE)), 0) AS before FROM {source}),
firsts AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY le) AS rk FROM cells WHERE cum >= CAST({q} AS DOUBLE) * total),
quantiles AS (SELECT {keys}, CASE WHEN total = 0 THEN NULL WHEN le = 'Infinity'::DOUBLE THEN low
    ELSE low + (le - low) * ((CAST({q} AS DOUBLE) * total - before) / CAST(cum - before AS DOUBLE)) END AS quantile FROM firsts WHERE rk = 1)"""


for q in (50, 95, 99):
    add(f"histogram_quantile_p{q}", lambda s, d, q=q: T.histogram_quantile(T.latency_histogram(log(s, d), ("endpoint",)), q / 100, ["endpoint"]),
        f", {LAT_HIST}, {quantile_sql(q / 100)} SELECT * FROM quantiles")
LE_CELLS = {f"le{i}": (f"count(*) FILTER (WHERE cents <= {b} * 100000)") for i, b in enumerate(T.LATENCY_BOUNDS)} | {"le12": "count(*)"}
RATE_HIST = counters_sql(LE_CELLS) + """,
hist AS (""" + " UNION ALL ".join(
    f"SELECT {bucket_sql(3600, 'scraped_at')} AS window_start, endpoint, {b if b is not None else 'NULL'}::DOUBLE AS le, sum(le{i}) / 3600 AS rate FROM grown WHERE le{i} IS NOT NULL GROUP BY ALL"
    for i, b in enumerate([*T.LATENCY_BOUNDS, None])) + ")"
add("windowed_quantile", lambda s, d: plain(T.histogram_quantile(
        T.counter_rate(samples(s, d), "http_request_duration_seconds_bucket", ["endpoint", "le"], 3600), 0.95, ["window_start", "endpoint"], "rate")),
    f", {RATE_HIST}, {quantile_sql(0.95, 'window_start, endpoint', 'rate')} SELECT * FROM quantiles")
for seconds in (600, 3600):
    add(f"request_rate_{seconds}s", lambda s, d, n=seconds: plain(T.counter_rate(samples(s, d), "http_requests_total", ["endpoint"], n)),
        f", {counters_sql({'n': 'count(*)'})} SELECT {bucket_sql(seconds, 'scraped_at')} AS window_start, endpoint, sum(n) / {seconds} AS rate FROM grown WHERE n IS NOT NULL GROUP BY ALL")
add("mean_latency", lambda s, d: plain(T.mean_from_hist(samples(s, d), "http_request_duration_seconds", ["endpoint"], 3600)),
    f""", {counters_sql({'c': 'count(*)', 'v': 'sum(cents)'})} SELECT {bucket_sql(3600, 'scraped_at')} AS window_start, endpoint,
    sum(v) / 3600 AS per_second, (sum(v) / 3600) / nullif(sum(c) / 3600, 0) AS mean FROM grown WHERE c IS NOT NULL GROUP BY ALL""")
add("block_hit_share", lambda s, d: plain(T.share_of(samples(s, d), "pg_stat_database_blks_hit", "pg_stat_database_blks_read", [], 3600)),
    f""", {counters_sql({'h': 'sum(rows)', 'r': 'sum(100 - rows)'})} SELECT {bucket_sql(3600, 'scraped_at')} AS window_start,
    sum(h) / 3600 AS num, sum(r) / 3600 AS den, (sum(h) / 3600) / nullif(sum(h) / 3600 + sum(r) / 3600, 0) AS ratio
    FROM grown WHERE h IS NOT NULL GROUP BY ALL""")
add("gauge_last", lambda s, d: T.gauge_last(samples(s, d), "http_requests_in_flight", ["device"]),
    "SELECT device_id AS device, CAST(arg_max(rows, ts) AS DOUBLE) AS latest, CAST(max(rows) AS DOUBLE) AS peak FROM log GROUP BY 1")
add("gauge_share", lambda s, d: plain(T.gauge_share(samples(s, d), "http_requests_in_flight", 200.0)),
    "SELECT ts, CAST(sum(rows) AS DOUBLE) AS used, CAST(200 AS DOUBLE) AS bound, CAST(sum(rows) AS DOUBLE) / 200 AS share FROM log GROUP BY ts")
add("gauge_of_gauge", lambda s, d: plain(T.gauge_share(samples(s, d), "http_requests_in_flight", "pg_settings_max_connections")),
    """SELECT ts, CAST(sum(rows) AS DOUBLE) AS used, CAST(max(rows) + 100 AS DOUBLE) AS bound,
    CAST(sum(rows) AS DOUBLE) / CAST(max(rows) + 100 AS DOUBLE) AS share FROM log GROUP BY ts""")
OPERATIONS = {f"{k}{op[0]}": f"{a} FILTER (WHERE rows {test} 40)" for op, test in (("read", ">="), ("write", "<"))
              for k, a in (("n", "count(*)"), ("t", "sum(cents)"))}
add("wait_per_operation", lambda s, d: plain(T.wait_per_operation(samples(s, d), ["endpoint"], 3600)),
    ", " + counters_sql({k: f"coalesce({e}, 0)" for k, e in OPERATIONS.items()}) + " UNION ALL ".join(
        f""" SELECT {bucket_sql(3600, 'scraped_at')} AS window_start, endpoint, '{op}' AS operation, sum(n{op[0]}) / 3600 AS per_second,
        (sum(t{op[0]}) / 3600) / nullif(sum(n{op[0]}) / 3600, 0) * 1000 AS wait_ms FROM grown WHERE nr IS NOT NULL GROUP BY 1, 2"""
        for op in ("read", "write")))
for seconds, slide in ((3600, 900), (120, 5)):
    add(f"request_rate_{seconds}s_every_{slide}s", lambda s, d, n=seconds, k=slide: plain(T.counter_rate(samples(s, d), "http_requests_total", ["endpoint"], n, k)),
        f""", {counters_sql({'n': 'count(*)'})} SELECT {bucket_sql(slide, 'scraped_at')} - INTERVAL (g * {slide}) SECOND AS window_start, endpoint,
        sum(n) / {seconds} AS rate FROM grown, (SELECT unnest(range({seconds // slide})) AS g) WHERE n IS NOT NULL GROUP BY ALL""")
for seconds, slide in ((300, None), (3600, 900)):
    start = bucket_sql(seconds) if not slide else f"{bucket_sql(slide)} - INTERVAL (g * {slide}) SECOND"
    more = "" if not slide else f", (SELECT unnest(range({seconds // slide})) AS g)"
    add(f"error_ratio_{seconds}s", lambda s, d, n=seconds, k=slide: plain(T.error_ratio(log(s, d), n, k)),
        f"""SELECT {start} AS window_start, count(*) FILTER (WHERE status >= 500) AS errors, count(*) AS requests,
        CAST(count(*) FILTER (WHERE status >= 500) AS DOUBLE) / count(*) AS error_ratio FROM log{more} GROUP BY 1""")

# Summaries, segments, verdicts
add("run_summary", lambda s, d: T.run_summary(log(s, d), ["endpoint"]), f", {summary_sql('endpoint')} SELECT * FROM summary")
add("run_summary_total", lambda s, d: T.run_summary(log(s, d), []), f", {summary_sql('')} SELECT * FROM summary")
add("slow_requests", lambda s, d: plain(slow_requests(log(s, d), 100, 5)),
    "SELECT endpoint, count(*) AS slow, max(duration_ms) AS slowest_ms FROM log WHERE cents >= 10000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
HOT = "hot AS (SELECT device_id FROM log GROUP BY 1 ORDER BY count(*) DESC, device_id LIMIT 20)"
add("latency_hot_cold", lambda s, d: T.segment_latency(T.by_heat(log(s, d), top_devices(log(s, d), 20)), F.col("heat")),
    f""", {HOT}, marked AS (SELECT log.*, CASE WHEN hot.device_id IS NULL THEN 'cold' ELSE 'hot' END AS segment FROM log LEFT JOIN hot USING (device_id)),
    {summary_sql('segment', 'marked')} SELECT * FROM summary""")
add("latency_by_third", lambda s, d: T.segment_latency(T.by_third(log(s, d)), F.col("phase")),
    f""", ends AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) - epoch_us(min(ts)) AS b FROM log),
    marked AS (SELECT log.*, CASE WHEN (epoch_us(ts) - a) * 3 < b THEN 'cold' WHEN (epoch_us(ts) - a) * 3 < b * 2 THEN 'warm' ELSE 'hot' END AS segment FROM log, ends),
    {summary_sql('segment', 'marked')} SELECT * FROM summary""")
add("latency_by_range", lambda s, d: T.segment_latency(log(s, d), T.range_class(F.col("size_bytes") * 2)),
    f""", marked AS (SELECT *, CASE WHEN size_bytes * 2 <= 3600 THEN '1h' WHEN size_bytes * 2 <= 86400 THEN '24h' ELSE '7d' END AS segment FROM log),
    {summary_sql('segment', 'marked')} SELECT * FROM summary""")


def by_tier(s, d) -> DataFrame:
    """Latency of the requests by tier; a request for neither an id nor a device reads the statistics."""
    asked = requests_at(s, d).where("error_code IS NULL OR error_param = 'id or device_id'")
    tiers = asked.select("request_id", T.query_tier().alias("tier"))
    return T.segment_latency(log(s, d).join(tiers, "request_id"), F.col("tier"))


TIER_SQL = f""", {REQUESTS_SQL.strip()}, marked AS (SELECT log.*, CASE WHEN mode = 'id' THEN 'pk_lookup' WHEN NOT by_device THEN 'stats_agg'
      WHEN from_ts IS NOT NULL OR to_ts IS NOT NULL THEN 'time_range' ELSE 'device_filter' END AS segment
      FROM log JOIN checked USING (request_id) WHERE error_param IS NULL OR error_param = 'id or device_id'),
    {summary_sql('segment', 'marked')}"""
add("latency_by_tier", by_tier, f"{TIER_SQL} SELECT * FROM summary")
add("tier_verdicts", lambda s, d: V.slo_verdict(by_tier(s, d), ["segment"], V.tier_targets(s)),
    f"""{TIER_SQL}, long AS (SELECT segment, unnest(['p95_ms', 'p99_ms']) AS stat, unnest([p95_ms, p99_ms]) AS value FROM summary),
    targets(segment, stat, bound) AS (VALUES {', '.join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in V.TIER_TARGETS)})
    SELECT segment, stat, value, bound, CASE WHEN value < bound THEN 'pass' ELSE 'fail' END AS verdict FROM long JOIN targets USING (segment, stat)""")
USERS_SQL = """, users AS (SELECT endpoint, day, count(DISTINCT device_id) AS n FROM (SELECT *, CAST(ts AS DATE) AS day FROM log) GROUP BY ALL)"""
add("user_bands", lambda s, d: V.banded(T.concurrent_users(log(s, d), ["endpoint"], 86400), ["endpoint"]),
    f"""{USERS_SQL} SELECT endpoint, 'concurrent_users' AS stat, CAST(max(n) AS DOUBLE) AS value,
    CASE WHEN max(n) >= 50 THEN 'pass' WHEN max(n) >= 30 THEN 'warn' ELSE 'fail' END AS grade FROM users GROUP BY endpoint""")

# Quantiles of any period from daily sketches
SPANS = (("first_week", "2024-01-01", "2024-01-08"), ("one_day", "2024-01-10", "2024-01-11"), ("all", "2000-01-01", "2100-01-01"))


def sketched(s, d) -> DataFrame:
    """Whether the share of requests below each estimate is near the asked one, per period."""
    rows, out = log(s, d), None
    days = written(T.latency_sketches(rows, ["endpoint"]), "latency-sketches")
    for name, start, end in SPANS:
        estimates = T.sketched_quantiles(
            days.where((F.col("window_start") >= start) & (F.col("window_start") < end)), ["endpoint"], [50, 95, 99])
        within = rows.where((F.col("ts") >= start) & (F.col("ts") < end))
        judged = within.withColumn("_x", (F.col("duration_ms") * 100).cast("bigint")).join(F.broadcast(estimates), "endpoint")
        near = F.lit(True)
        for p in (50, 95, 99):
            below, upto = (F.count_if(c) / F.count(F.lit(1)) for c in (F.col("_x") < F.col(f"p{p}"), F.col("_x") <= F.col(f"p{p}")))
            near = near & (below - T.SKETCH_ERROR <= p / 100) & (upto + T.SKETCH_ERROR >= p / 100)
        part = judged.groupBy("endpoint", "requests").agg(near.alias("near")).select(
            F.lit(name).alias("period"), "endpoint", "requests", "near")
        out = part if out is None else out.unionByName(part)
    return out


add("period_quantiles_estimated", sketched, ", spans(period, a, b) AS (VALUES " + ", ".join(
    f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in SPANS) + """)
    SELECT period, endpoint, count(*) AS requests, true AS near FROM log, spans WHERE ts >= a AND ts < b GROUP BY ALL""")
add("traffic_mix", lambda s, d: T.mix_share(log(s, d)),
    "SELECT endpoint, count(*) AS requests, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM log) AS share FROM log GROUP BY 1")
TARGETS = (("p50_ms", 35.0), ("p95_ms", 150.0), ("p99_ms", 230.0), ("error_share", 0.01))
LONG = """long AS (SELECT endpoint, unnest(['p50_ms', 'p95_ms', 'p99_ms', 'error_share']) AS stat,
  unnest([p50_ms, p95_ms, p99_ms, error_share]) AS value FROM summary)"""
add("slo_verdicts", lambda s, d: V.slo_verdict(T.run_summary(log(s, d), ["endpoint"]), ["endpoint"], V.targets_table(s, TARGETS)),
    f""", {summary_sql('endpoint')}, {LONG}, targets(stat, bound) AS (VALUES ('p50_ms', 35.0::DOUBLE), ('p95_ms', 150.0), ('p99_ms', 230.0), ('error_share', 0.01))
    SELECT stat, endpoint, value, bound, CASE WHEN value < bound THEN 'pass' ELSE 'fail' END AS verdict FROM long JOIN targets USING (stat)""")
add("slo_bands", lambda s, d: V.banded(T.run_summary(log(s, d), ["endpoint"]), ["endpoint"]),
    f""", {summary_sql('endpoint')}, {LONG}, bands(stat, a, b) AS (VALUES ('p50_ms', 500.0::DOUBLE, 700.0::DOUBLE), ('p95_ms', 800.0, 1200.0), ('error_share', 0.01, 0.05))
    SELECT stat, endpoint, value, CASE WHEN value <= a THEN 'pass' WHEN value <= b THEN 'warn' ELSE 'fail' END AS grade FROM long JOIN bands USING (stat)""")
add("alert_levels", lambda s, d: V.alert_level(T.run_summary(log(s, d), ["endpoint"]), ["endpoint"]),
    f""", {summary_sql('endpoint')}, {LONG}, bands(stat, a, b) AS (VALUES ('p95_ms', 400.0::DOUBLE, 500.0::DOUBLE), ('error_share', 0.005, 0.01))
    SELECT stat, endpoint, value, CASE WHEN value <= a THEN 'ok' WHEN value <= b THEN 'warning' ELSE 'critical' END AS grade FROM long JOIN bands USING (stat)""")
RUN_STATS = ["requests", "error_share", "min_ms", "p50_ms", "p95_ms", "max_ms"]


def _compared(s, d):
    both = log(s, d).withColumn("run", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "first").otherwise("second"))
    rows = V.long_summary(T.run_summary(both, ["run", "endpoint"]), ["run", "endpoint"], RUN_STATS)
    return plain(V.compare_runs(rows, ["endpoint"], "first", "second"))


add("run_comparison", _compared,
    f""", marked AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'first' ELSE 'second' END AS run FROM log),
    {summary_sql('run, endpoint', 'marked')},
    long AS (SELECT run, endpoint, unnest({RUN_STATS}) AS stat, unnest([requests, error_share, min_ms, p50_ms, p95_ms, max_ms]) AS value FROM summary),
    wide AS (SELECT endpoint, stat, max(value) FILTER (WHERE run = 'first') AS base, max(value) FILTER (WHERE run = 'second') AS current FROM long GROUP BY ALL),
    whole AS (SELECT *, CAST(round(base * 1000000) AS HUGEINT) AS b, CAST(round(current * 1000000) AS HUGEINT) AS c FROM wide),
    delta AS (SELECT *, CASE WHEN b <> 0 THEN CAST(sign(c - b) * ((2 * abs(c - b) * 1000000 + b) // (2 * b)) AS BIGINT) / CAST(10000 AS DOUBLE) END AS delta_percent FROM whole)
    SELECT endpoint, stat, base, current, delta_percent, CASE WHEN delta_percent IS NULL THEN 'N/A'
      WHEN (stat = 'requests' AND delta_percent > 0) OR (stat <> 'requests' AND delta_percent < 0) THEN 'improved'
      WHEN abs(delta_percent) > 10 THEN 'regression' ELSE 'minor' END AS verdict FROM delta""")
STEP_SQL = f""", marked AS (SELECT *, {bucket_sql(21600)} AS window_start FROM log), {summary_sql('window_start', 'marked')},
    steps AS (SELECT window_start, requests, CAST(requests AS DOUBLE) / 21600 AS rate, error_share, p95_ms, p95_ms < 200 AND error_share < 0.35 AS passed FROM summary)"""
add("load_steps", lambda s, d: plain(T.load_steps(log(s, d), 21600, 200, 0.35)), f"{STEP_SQL} SELECT * FROM steps")
add("load_ceiling", lambda s, d: plain(T.load_ceiling(log(s, d), 21600, 200, 0.35)),
    f"""{STEP_SQL}, held AS (SELECT * FROM steps WHERE window_start < coalesce((SELECT min(window_start) FROM steps WHERE NOT passed), TIMESTAMP '9999-01-01'))
    SELECT count(*) AS steps_held, max(window_start) AS last_step, arg_max(rate, window_start) AS last_rate, max(rate) AS highest_rate FROM held""")


# Probes: every request probes one of three dependencies, unhealthy when it was slow
def probes(s, d):
    rows = log(s, d).withColumn("probe_ts", F.date_trunc("minute", "ts"))
    named = F.when(F.col("endpoint") == "view", "database").when(F.col("endpoint") == "click", "cache").otherwise("queue")
    return rows.select("probe_ts", named.alias("dependency"),
                       F.when(F.col("duration_ms") > 100, "unhealthy").otherwise("healthy").alias("status"),
                       F.col("duration_ms").cast("double").alias("latency_ms"))


PROBES_SQL = """, checks AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS probe_ts,
    CASE endpoint WHEN 'view' THEN 'database' WHEN 'click' THEN 'cache' ELSE 'queue' END AS dependency,
    CASE WHEN cents > 10000 THEN 'unhealthy' ELSE 'healthy' END AS status, duration_ms AS latency_ms
    FROM log)"""
add("probe_status", lambda s, d: plain(T.probe_rollup(probes(s, d))),
    f"""{PROBES_SQL} SELECT probe_ts, CASE WHEN bool_or(status <> 'healthy' AND dependency = 'database') THEN 'unhealthy'
    WHEN bool_or(status <> 'healthy') THEN 'degraded' ELSE 'healthy' END AS status, max(latency_ms) AS slowest_ms FROM checks GROUP BY 1""")
add("availability", lambda s, d: plain(T.availability(probes(s, d))),
    f"""{PROBES_SQL} SELECT dependency, date_trunc('hour', probe_ts)::TIMESTAMP AS hour, count(*) AS probes,
    count(*) FILTER (WHERE status = 'healthy') AS healthy, CAST(count(*) FILTER (WHERE status = 'healthy') AS DOUBLE) / count(*) AS availability
    FROM checks GROUP BY ALL""")

# Alerts and islands
ALERT_RULES = (("HighErrorRate", 0.2, 7200, "critical", "api"), ("HighLatency", 40.0, 7200, "warning", "api"))


def alert_series(s, d):
    hourly = T.windowed(log(s, d), 3600)
    errors = hourly.groupBy("window_start").agg((F.count_if(T.is_error()) / F.count(F.lit(1))).alias("value"))
    slow = hourly.groupBy("window_start", "endpoint").agg(
        (F.sum((F.col("duration_ms") * 100).cast("bigint")).cast("double") / F.count(F.lit(1)) / 100).alias("value"))
    return errors.select(F.lit("HighErrorRate").alias("rule"), F.lit("").alias("series"), F.col("window_start").alias("ts"), "value").unionByName(
        slow.select(F.lit("HighLatency").alias("rule"), F.col("endpoint").alias("series"), F.col("window_start").alias("ts"), "value"))


add("alerts", lambda s, d: plain(K.alerts(alert_series(s, d), K.rules_table(s, ALERT_RULES))),
    f""", hourly AS (SELECT *, {bucket_sql(3600)} AS h FROM log),
    series AS (SELECT 'HighErrorRate' AS rule, '' AS series, h AS ts, CAST(count(*) FILTER (WHERE status >= 500) AS DOUBLE) / count(*) AS value FROM hourly GROUP BY h
      UNION ALL SELECT 'HighLatency', endpoint, h, CAST(sum(cents) AS DOUBLE) / count(*) / 100 FROM hourly GROUP BY endpoint, h),
    rules(rule, threshold, hold, severity, component) AS (VALUES ('HighErrorRate', 0.2::DOUBLE, 7200, 'critical', 'api'), ('HighLatency', 40.0, 7200, 'warning', 'api')),
    judged AS (SELECT *, value > threshold AS is_on FROM series JOIN rules USING (rule)),
    runs AS (SELECT *, row_number() OVER (PARTITION BY rule, series ORDER BY ts) - row_number() OVER (PARTITION BY rule, series, is_on ORDER BY ts) AS g FROM judged)
    SELECT rule, series, severity, component, min(ts) AS pending_since, min(ts) + INTERVAL 2 HOUR AS firing_since, max(ts) AS last_true, max(value) AS peak
    FROM runs WHERE is_on GROUP BY rule, series, severity, component, hold, g HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= CAST(hold AS BIGINT) * 1000000""")

# All seven rules: two hosts scraped every 15 seconds on a clock that passes 60 times as fast
RULE_BOUNDS = (0.1, 0.5, 1.0, 2.5)


def rule_samples(s, d) -> DataFrame:
    """Counters, restarted with every day of the events, and gauges of two hosts."""
    fast = F.floor(F.unix_seconds("ts") / 900) * 15 + 15
    base = log(s, d).withColumn("at", F.timestamp_seconds(fast)).withColumn("day", F.to_date("ts")).withColumn(
        "host", F.concat(F.lit("h"), F.col("request_id") % 2))
    cents = (F.col("duration_ms") * 100).cast("bigint")
    bad = (F.col("status") == 500) & (F.col("rows") < 5)
    scraped = base.groupBy("host", "day", "at").agg(
        F.max("rows").alias("top"), F.min("rows").alias("low"),
        F.count_if(bad).alias("n503"), F.count_if(~bad).alias("n200"),
        *[F.count_if(cents <= b * 10000).alias(f"le{i}") for i, b in enumerate(RULE_BOUNDS)],
        F.count(F.lit(1)).alias(f"le{len(RULE_BOUNDS)}"))
    running = Window.partitionBy("host", "day").orderBy("at")

    def cell(metric: str, value, le=None, **labels: str):
        pairs = [x for k, v in {"instance": F.col("host"), **{k: F.lit(v) for k, v in labels.items()}}.items() for x in (F.lit(k), v)]
        return F.struct(F.lit(metric).alias("metric"), F.create_map(*pairs).alias("labels"),
                        F.lit(le).cast("double").alias("le"), value.cast("double").alias("value"))

    waited = F.floor(F.col("top") / 20)
    cells = [
        cell("node_cpu_seconds_total", F.sum(waited).over(running), mode="iowait"),
        cell("node_cpu_seconds_total", F.sum(15 - F.floor(F.col("top") * 15 / 100)).over(running), mode="idle"),
        cell("node_memory_SwapTotal_bytes", F.lit(100)),
        cell("node_memory_SwapFree_bytes", F.lit(100) - (F.col("top") > 50).cast("int")),
        cell("http_requests_total", F.sum("n200").over(running), status="200"),
        cell("http_requests_total", F.sum("n503").over(running), status="503"),
        cell("pg_stat_activity_count", F.col("top"), state="active"),
        cell("pg_stat_activity_count", F.col("low"), state="idle"),
        cell("redis_memory_used_bytes", F.col("top") * 5400000),
        *[cell("http_request_duration_seconds_bucket", F.sum(f"le{i}").over(running), b)
          for i, b in enumerate([*RULE_BOUNDS, float("inf")])],
    ]
    return scraped.select(F.col("at").alias("ts"), F.array(*cells).alias("cells")).select("ts", F.inline("cells"))


def rule_evaluations(s, d) -> DataFrame:
    return K.rule_series(written(rule_samples(s, d), "rule-samples"))


RULE_COUNTERS = {"iowait": "top // 20", "idle": "15 - top * 15 // 100", "n503": "n503", "n200": "n200"} | {
    f"le{i}": f"le{i}" for i in range(len(RULE_BOUNDS) + 1)}


def _over(cell: str, seconds: int, more: str = "") -> str:
    """Growth of a counter in every window, from its scrapes."""
    return (f"SELECT {bucket_sql(5, 'scraped_at')} - INTERVAL (g * 5) SECOND AS ts, host, {more}sum({cell}) / {seconds} AS rate "
            f"FROM rule_grown, (SELECT unnest(range({seconds // 5})) AS g) WHERE {cell} IS NOT NULL GROUP BY ALL")


RULE_SERIES_SQL = f""",
scrapes AS (SELECT 'h' || CAST(request_id % 2 AS VARCHAR) AS host, CAST(ts AS DATE) AS day,
    to_timestamp(CAST(epoch_us(ts) // 1000000 // 900 * 15 + 15 AS DOUBLE))::TIMESTAMP AS scraped_at,
    max(rows) AS top, min(rows) AS low, count(*) FILTER (WHERE status = 500 AND rows < 5) AS n503,
    count(*) FILTER (WHERE NOT (status = 500 AND rows < 5)) AS n200, count(*) AS le{len(RULE_BOUNDS)},
    {', '.join(f"count(*) FILTER (WHERE cents <= {b} * 10000) AS le{i}" for i, b in enumerate(RULE_BOUNDS))} FROM log GROUP BY ALL),
rule_counts AS (SELECT host, day, scraped_at, {', '.join(f"CAST(sum({e}) OVER (PARTITION BY host, day ORDER BY scraped_at) AS DOUBLE) AS {n}" for n, e in RULE_COUNTERS.items())} FROM scrapes),
rule_grown AS (SELECT host, scraped_at, {', '.join(f"CASE WHEN lag({n}) OVER w IS NULL THEN NULL WHEN {n} < lag({n}) OVER w THEN {n} ELSE {n} - lag({n}) OVER w END AS {n}" for n in RULE_COUNTERS)}
  FROM rule_counts WINDOW w AS (PARTITION BY host ORDER BY scraped_at)),
hist AS ({' UNION ALL '.join(_over(f"le{i}", 120, f"{b}::DOUBLE AS le, ") for i, b in enumerate([*RULE_BOUNDS, "'Infinity'"]))}),
{quantile_sql(0.95, 'ts, host', 'rate')},
served AS (SELECT b.ts, b.host, b.rate AS bad, g.rate AS good FROM ({_over('n503', 60)}) b JOIN ({_over('n200', 60)}) g USING (ts, host)),
series AS (SELECT 'HighIOWait' AS rule, 'instance=' || host AS series, ts, rate AS value FROM ({_over('iowait', 120)})
  UNION ALL SELECT 'CPUHighUsage', 'instance=' || host, ts, 1 - rate FROM ({_over('idle', 120)})
  UNION ALL SELECT 'MemoryPressure', 'instance=' || host, scraped_at, CASE WHEN top > 50 THEN 1 ELSE 0 END FROM scrapes
  UNION ALL SELECT 'HighLatency', 'instance=' || host, ts, quantile FROM quantiles WHERE quantile IS NOT NULL
  UNION ALL SELECT 'HighErrorRate', 'instance=' || host, ts, bad / nullif(bad + good, 0) FROM served WHERE bad + good > 0
  UNION ALL SELECT 'PoolExhaustion', '', scraped_at, CAST(sum(top + low) AS DOUBLE) FROM scrapes GROUP BY scraped_at
  UNION ALL SELECT 'RedisMemoryPressure', 'instance=' || host, scraped_at, CAST(top * 5400000 AS DOUBLE) / {K.CACHE_BYTES} FROM scrapes)"""
RULE_ALERTS_SQL = RULE_SERIES_SQL + f""",
rules(rule, threshold, hold, severity, component) AS (VALUES {', '.join(f"('{n}', {t}::DOUBLE, {h}, '{v}', '{c}')" for n, t, h, v, c in K.RULES)}),
judged AS (SELECT *, value > threshold AS is_on FROM series JOIN rules USING (rule)),
runs AS (SELECT *, row_number() OVER (PARTITION BY rule, series ORDER BY ts) - row_number() OVER (PARTITION BY rule, series, is_on ORDER BY ts) AS g FROM judged),
fired AS (SELECT rule, series, severity, component, min(ts) AS pending_since, min(ts) + to_seconds(hold) AS firing_since, max(ts) AS last_true, max(value) AS peak
  FROM runs WHERE is_on GROUP BY rule, series, severity, component, hold, g HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= CAST(hold AS BIGINT) * 1000000)"""
add("rule_evaluations", lambda s, d: plain(rule_evaluations(s, d)), f"{RULE_SERIES_SQL} SELECT rule, series, ts, CAST(value AS DOUBLE) AS value FROM series")
add("rule_alerts", lambda s, d: plain(K.alerts(written(rule_evaluations(s, d), "evaluations"), K.rules_table(s))),
    f"{RULE_ALERTS_SQL} SELECT * FROM fired")
add("activity_islands", lambda s, d: plain(gap_islands(events(s, d), ["device_id"], ["ts", "id"], 43200)
        .groupBy("device_id", "island").agg(F.max("ts").alias("island_end"), F.count(F.lit(1)).alias("reading_count"))),
    """, marked AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 43200000000 THEN 0 ELSE 1 END AS opens FROM readings WINDOW w AS (PARTITION BY device_id ORDER BY ts, id)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY device_id ORDER BY ts, id) AS g FROM marked)
    SELECT device_id, min(ts) AS island, max(ts) AS island_end, count(*) AS reading_count FROM numbered GROUP BY device_id, g""", READINGS_SQL.strip())
