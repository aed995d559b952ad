"""Cache reuse against a request-by-request replay."""

from __future__ import annotations

import datetime
import random

import pytest

from tidemark.operators.reuse import ttl_status

SCHEMA = "ts timestamp, request_id bigint, key string, status int, rows int"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def replay(rows, ttl):
    filled, out = {}, {}
    for ts, rid, key, status, n in sorted(rows, key=lambda r: (r[0], r[1])):
        if key is None:
            out[rid] = None
        elif key in filled and ts < filled[key] + datetime.timedelta(seconds=ttl):
            out[rid] = "HIT"
        else:
            out[rid] = "MISS"
            if 200 <= status < 300 and n > 0:
                filled[key] = ts
    return out


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def run(spark, rows, ttl, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["request_id"]: r["cache_status"] for r in ttl_status(df, ttl, **kw).collect()}


def test_edges(spark):
    rows = [
        (at(0), 1, "a", 200, 5),
        (at(29.999999), 2, "a", 200, 5),
        (at(30), 3, "a", 200, 5),  # exactly ttl after the fill
        (at(0), 4, "empty", 200, 0),
        (at(1), 5, "empty", 200, 0),
        (at(2), 6, "empty", 500, 3),
        (at(3), 7, "empty", 200, 1),
        (at(4), 8, "empty", 500, 0),
        (at(0), 9, None, 400, 0),
        (at(5), 10, "same", 200, 1),
        (at(5), 11, "same", 200, 1),
    ]
    got = run(spark, rows, 30)
    assert got == replay(rows, 30)
    assert [got[i] for i in (1, 2, 3)] == ["MISS", "HIT", "MISS"]
    assert [got[i] for i in (4, 5, 6, 7, 8)] == ["MISS", "MISS", "MISS", "MISS", "HIT"]


@pytest.mark.parametrize("fold", [4096, 3])
@pytest.mark.parametrize("pace", [0.4, 6, 40])
def test_busy_key_matches_replay(spark, fold, pace):
    """With a fold bound of 3 every island takes the chunked way, across parent chunks."""
    rng = random.Random(int(pace * 10))
    rows, t = [], 0.0
    for i in range(6000):
        t += rng.expovariate(1 / pace)
        key = "hot" if rng.random() < 0.8 else f"k{rng.randint(0, 3)}"
        status = 200 if rng.random() < 0.9 else 500
        rows.append((at(round(t, 3)), i, key, status, rng.randint(0, 3)))
    ttl = 1 if pace < 1 else 30
    assert run(spark, rows, ttl, fold_instants=fold) == replay(rows, ttl)


def test_regular_traffic_over_many_chunks(spark):
    """Evenly spaced requests never let chains merge; one second ttl spans several parents."""
    rows = [(at(i * 0.7), i, "hot", 200, 1) for i in range(30000)]
    assert run(spark, rows, 1, fold_instants=10) == replay(rows, 1)
