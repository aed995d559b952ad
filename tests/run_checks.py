"""Compare registered queries with their SQL: ``python tests/run_checks.py [sf] [name...]``."""

from __future__ import annotations

import sys
import tempfile
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tidemark.session import get_session  # noqa: E402


def main() -> int:
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark = get_session("checks", "local[8]", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls, bad = oracle_sql(), 0
    for name, query in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            result = compare(df, con, sqls[name]) if name in sqls else f"rows {df.count()} (no SQL)"
        except Exception as e:  # noqa: BLE001
            result = "FAILED " + str(e)[:900]
            if len(wanted) == 1:
                traceback.print_exc()
        ok = result is None or result.endswith("(no SQL)")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
