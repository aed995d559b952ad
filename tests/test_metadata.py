"""Answers from footers and manifests, and lookups in buckets: what the plans do and do not read."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidemark.catalog.tables import events, requests_at
from tidemark.operators import requests as B
from tidemark.sources import footers as Q
from tidemark.sources.buckets import open_buckets, write_buckets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_and_extremes_come_from_footers(spark, sf):
    text = plan(Q.footer_summary(spark, f"{sf}/events.parquet", "event_id"))
    assert re.search(r"PushedAggregation: \[COUNT\(\*\), MIN\(event_id\), MAX\(event_id\)\]", text)
    assert spark.conf.get(Q.V1_SOURCES).count("parquet") == 1
    assert "PushedAggregation" not in plan(spark.read.parquet(f"{sf}/events.parquet").agg(F.max("event_id")))


def test_other_aggregates_still_read_rows(spark, sf):
    df = Q.read_footers(spark, f"{sf}/events.parquet")
    want = spark.read.parquet(f"{sf}/events.parquet")
    for f in (F.max("ts"), F.sum("value"), F.count_distinct("user_id")):
        assert df.agg(f).first()[0] == want.agg(f).first()[0]
    assert df.where("event_id < 10").count() == want.where("event_id < 10").count()


def test_an_empty_table(spark, folder):
    spark.range(0).write.parquet(folder + "/none")
    assert Q.footer_summary(spark, folder + "/none", "id").first()[:] == (0, None, None)


def ancestors(text, leaf):
    """Lines above a leaf of a printed plan, up to its root."""
    lines = text.splitlines()
    depth = lambda line: len(re.match(r"[\s:+\-|]*", line).group())
    (at,) = [i for i, x in enumerate(lines) if leaf in x]
    out, now = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < now:
            out.append(line)
            now = depth(line)
    return out


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(B, "BROADCAST_ROWS", 10)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_readings_in_buckets_are_not_exchanged(spark, sf, folder, no_broadcast):
    held = write_buckets(events(spark, sf), folder + "/ids", 12)
    again = open_buckets(spark, folder + "/ids", 12)
    want = sorted(map(repr, B.lookup_ids(requests_at(spark, sf), events(spark, sf)).collect()))
    for readings in (held, again):
        found = B.lookup_ids(requests_at(spark, sf), readings)
        above = ancestors(plan(found), "Bucketed: true")
        assert any("SortMergeJoin" in line for line in above)
        assert not any("Exchange" in line for line in above)
        assert sorted(map(repr, found.collect())) == want
    loose = plan(B.lookup_ids(requests_at(spark, sf), spark.read.parquet(folder + "/ids")))
    assert "Bucketed: true" not in loose
