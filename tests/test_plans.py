"""Physical plans of the operators that must hold at scale."""

from __future__ import annotations

import pytest

from tidemark.catalog import tables
from tidemark.functions import joins
from tidemark.operators import aggregates as A
from tidemark.operators import latest as L
from tidemark.operators import requests as Q
from tidemark.operators import rollups as R
from tidemark.operators.filters import by_type, last_interval


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_is_top_k(spark, sf):
    text = plan(L.latest(tables.orders(spark, sf), "customer-000000007", 10))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_latest_per_entity_limits_before_the_shuffle(spark, sf):
    text = plan(L.latest_per_entity(tables.events(spark, sf), 3))
    before, _, after = text.partition("Exchange")
    assert "WindowGroupLimit" in before and "Partial" in after and "WindowGroupLimit" in after


def test_scan_reads_only_needed_columns(spark, sf):
    assert "ReadSchema: struct<user_id:bigint>" in plan(A.top_devices(tables.events(spark, sf), 5))
    text = plan(R.hourly_rollup(tables.lineitems(spark, sf)))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    names = {c.split(":")[0] for c in schema.split(",")}
    assert names == {"l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate"}


def test_time_and_type_filters_reach_the_scan(spark, sf):
    df = tables.events(spark, sf)
    for query in (last_interval(df, tables.AS_OF, 7, "day"), A.daily_avg_recent(df, tables.AS_OF, 7)):
        pushed = plan(query).split("PushedFilters: [")[1].split("]")[0]
        assert "GreaterThanOrEqual(ts," in pushed
    typed = plan(by_type(df, "view")).split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(event_type,view)" in typed


@pytest.mark.parametrize("name", ["daily", "lookup", "latest"])
def test_no_cartesian_or_nested_loop(spark, sf, name):
    df = tables.events(spark, sf)
    parsed = tables.requests_at(spark, sf)
    built = {
        "daily": lambda: R.daily_rollup(df),
        "lookup": lambda: Q.lookup_ids(parsed, df),
        "latest": lambda: Q.batch_latest(parsed, df),
    }[name]()
    text = plan(built)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_rollups_combine_before_the_shuffle(spark, sf):
    for df in (R.hourly_rollup(tables.events(spark, sf)), R.global_rollup(tables.events(spark, sf))):
        assert "partial_sum" in plan(df)


def test_broadcast_only_when_small(spark):
    wanted = spark.range(50).withColumnRenamed("id", "k")
    big = spark.range(1000).withColumnRenamed("id", "k")
    assert joins.is_small(wanted, 50) and not joins.is_small(wanted, 49)
    assert joins.keep_matching(big, wanted, ["k"]).count() == 50
    assert joins.checked(wanted, 49) is wanted
