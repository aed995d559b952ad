"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Readings are first organised on disk, as a service would hold them, and the refreshes and
request tables then read that layout. Each query runs once untimed, so that code generation is
not measured, and then ``BENCH_RUNS`` times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.catalog import tables  # noqa: E402
from tidemark.catalog import telemetry as C  # noqa: E402
from tidemark.operators import aggregates as A  # noqa: E402
from tidemark.operators import latest as L  # noqa: E402
from tidemark.operators import requests as Q  # noqa: E402
from tidemark.operators import reuse as U  # noqa: E402
from tidemark.operators import rollups as R  # noqa: E402
from tidemark.operators import telemetry as T  # noqa: E402
from tidemark.operators.filters import between_ts  # noqa: E402
from tidemark.plans import maintenance as M  # noqa: E402
from tidemark.session import get_session, shared_folder, written  # noqa: E402
from tidemark.sources.layout import write_layout  # noqa: E402
from tidemark.sources.readings import read_layout  # noqa: E402
from tidemark.sources.synth import synth_readings  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, job, warm: bool = True) -> None:
        if warm:
            job()
        took = []
        for _ in range(RUNS if warm else 1):
            start = time.perf_counter()
            job()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)

    def organised(name, df, parts=None):
        path = shared_folder(spark, name)
        timed(f"organise_{name}", lambda: write_layout(df, path, parts), warm=False)
        return read_layout(spark, path)

    items = organised("lineitem", tables.lineitems(spark, sf), int(cpus))
    readings = organised("events", tables.events(spark, sf), int(cpus))
    orders = organised("orders", tables.orders(spark, sf), int(cpus))
    log = C.log(spark, sf)
    reqs = Q.validate_requests(written(tables.requests(spark, sf), "request-table"))

    timed("hourly_refresh_lineitem", lambda: run(R.hourly_rollup(items)))
    timed("daily_refresh_lineitem", lambda: run(M.build("daily", items)))
    timed("daily_unbounded_lineitem", lambda: run(R.daily_rollup(items)))
    timed("global_refresh_lineitem", lambda: run(R.global_rollup(items)))
    timed("hourly_refresh_events", lambda: run(R.hourly_rollup(readings)))
    timed("daily_refresh_events", lambda: run(M.build("daily", readings)))
    timed("entity_stats_lineitem", lambda: run(R.entity_stats(items)))
    timed("latest_per_supplier", lambda: run(L.latest_per_entity(items, 10)))
    timed("latest_of_device", lambda: run(L.latest(readings, tables.DEVICE, 10)))
    timed(
        "one_month_orders",
        lambda: run(A.row_count(between_ts(orders, "1998-03-01 00:00:00", "1998-03-31 00:00:00"))),
    )
    timed("lookup_by_id", lambda: run(Q.lookup_ids(reqs, readings)))
    timed("latest_for_requests", lambda: run(Q.batch_latest(reqs, readings)))
    timed("top_devices", lambda: run(A.top_devices(items, 100)))
    timed("reads_per_device", lambda: run(A.reads_per_device_dist(items)))
    timed("run_summary", lambda: run(T.run_summary(log, ["endpoint"])))
    timed("latency_histogram", lambda: run(T.latency_histogram(log)))
    timed("error_ratio", lambda: run(T.error_ratio(log)))
    timed("cache_reuse", lambda: run(U.ttl_status(log, 86400)))
    made = synth_readings(spark, 2_000_000, partitions=int(cpus))
    timed("generate_2m_readings", lambda: run(made))
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
