"""Request rules, and set-at-a-time answers against answering one request at a time."""

from __future__ import annotations

import datetime
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import latest as L
from tidemark.operators import requests as Q
from tidemark.operators.reuse import request_key, unambiguous_key
from tidemark.plans.answers import answer_requests

REQ = "request_id bigint, id string, device_id string, `limit` string, reading_type string, `from` string, `to` string"
READ = "id bigint, device_id string, ts timestamp, reading_type string, value decimal(10,2), unit string, metadata string"
T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
OK = None

CASES = [
    (dict(id="42"), OK),
    (dict(id="+7"), OK),
    (dict(id="-5"), "id"),
    (dict(id="0"), "id"),
    (dict(id="abc"), "id"),
    (dict(id=" 1"), "id"),
    (dict(id="1 "), "id"),
    (dict(id="9223372036854775808"), "id"),
    (dict(id="1", device_id="a"), "id,device_id"),
    (dict(), "id or device_id"),
    (dict(id="", device_id=""), "id or device_id"),
    (dict(id="5", limit="0", **{"from": "bad"}), OK),
    (dict(device_id="a", limit="0"), "limit"),
    (dict(device_id="a", limit="-1"), "limit"),
    (dict(device_id="a", limit="501"), "limit"),
    (dict(device_id="a", limit="1"), OK),
    (dict(device_id="a", limit="500"), OK),
    (dict(device_id="a", limit="10abc"), OK),
    (dict(device_id="a", limit="abc"), OK),
    (dict(device_id="a", limit="99999999999999999999"), OK),
    (dict(device_id="a", **{"from": "not-a-date"}), "from"),
    (dict(device_id="a", **{"from": "2025-12-01"}), "from"),
    (dict(device_id="a", **{"from": "2025-12-01T00:00:00"}), "from"),
    (dict(device_id="a", **{"from": "2025-13-01T00:00:00Z"}), "from"),
    (dict(device_id="a", **{"from": "2025-12-01T00:00:00Z\n"}), "from"),
    (dict(device_id="a", **{"from": "2025-12-01T00:00:00.123Z"}), OK),
    (dict(device_id="a", to="bad-time"), "to"),
    (dict(device_id="a", **{"from": "2025-12-02T00:00:00Z", "to": "2025-12-01T00:00:00Z"}), "from, to"),
    (dict(device_id="a", **{"from": "2025-12-01T02:00:00+02:00", "to": "2025-12-01T00:00:00Z"}), OK),
    (dict(device_id="a" * 50), OK),
    (dict(device_id="a" * 51), "device_id"),
    (dict(device_id="sensor 1"), "device_id"),
    (dict(device_id="sensor@1"), "device_id"),
    (dict(device_id="sensor.1"), "device_id"),
    (dict(device_id="sensor/1"), "device_id"),
    (dict(device_id="sensor-1_B"), OK),
    (dict(device_id="sensor-1\n"), "device_id"),
    (dict(device_id="a", reading_type="t" * 30), OK),
    (dict(device_id="a", reading_type="t" * 31), "reading_type"),
    (dict(device_id="a", reading_type="air-temp"), "reading_type"),
    (dict(device_id="a", reading_type="air_temp"), "reading_type"),
    (dict(device_id="a", reading_type="air temp"), "reading_type"),
    (dict(device_id="a", reading_type="Temp2"), OK),
    (dict(device_id="a", reading_type="temp\n"), "reading_type"),
]


def table(spark, cases):
    names = ("id", "device_id", "limit", "reading_type", "from", "to")
    return spark.createDataFrame([(i, *(c.get(n) for n in names)) for i, c in enumerate(cases)], REQ)


def test_validation(spark):
    out = {r["request_id"]: r for r in Q.validate_requests(table(spark, [c for c, _ in CASES])).collect()}
    got = [out[i]["error_param"] for i in range(len(CASES))]
    assert got == [want for _, want in CASES]
    assert all((r["error_code"] == "INVALID_PARAMETER") == (r["error_param"] is not None) for r in out.values())
    limits = {CASES[i][0].get("limit"): out[i]["limit"] for i in out if out[i]["mode"] == "device"}
    assert limits["10abc"] == 10 and limits["abc"] == 10 and limits[None] == 10


def test_request_keys(spark):
    both = "2025-01-15T10:00:00Z"
    cases = [
        dict(device_id="sensor-1", limit="10"),
        dict(device_id="sensor-1", limit="10", reading_type="temperature"),
        dict(device_id="sensor-1", limit="10", **{"from": both}),
        dict(device_id="sensor-1", limit="10", to=both),
        dict(id="42"),
    ]
    parsed = Q.validate_requests(table(spark, cases)).orderBy("request_id")
    plain = [r[0] for r in parsed.select(request_key()).collect()]
    assert plain == [
        "sensor:sensor-1:readings:10",
        "sensor:sensor-1:readings:10:temperature",
        "sensor:sensor-1:readings:10:1736935200",
        "sensor:sensor-1:readings:10:1736935200",
        "sensor:id:42",
    ]
    assert len({r[0] for r in parsed.select(unambiguous_key()).collect()}) == 5


def some_readings(rng, n=1500):
    """Whole-minute times, so that many readings share an instant; one device has most."""
    out = []
    for i in range(n):
        device = "hot" if rng.random() < 0.7 else f"d{rng.randint(0, 5)}"
        ts = T0 + datetime.timedelta(minutes=rng.randint(0, 600))
        kind = rng.choice(["temperature", "humidity"])
        out.append((i + 1, device, ts, kind, Decimal(rng.randint(-500, 500)) / 100, "u", '{"k":1}' if i % 3 else "{}"))
    return out


def one_by_one(rows, case):
    def at(text):
        return datetime.datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None

    frm, to = at(case.get("from")), at(case.get("to"))
    kept = [
        r
        for r in rows
        if r[1] == case["device_id"]
        and (not case.get("reading_type") or r[3] == case["reading_type"])
        and (frm is None or r[2] >= frm)
        and (to is None or r[2] <= to)
    ]
    kept.sort(key=lambda r: (r[2], r[0]), reverse=True)
    return [r[0] for r in kept[: int(case.get("limit") or 10)]]


@pytest.mark.parametrize("bucket", [60, 3600, 10**9])
def test_batch_latest_equals_one_by_one(spark, bucket):
    rng = random.Random(bucket)
    rows = some_readings(rng)
    cases = []
    for _ in range(250):
        case = dict(device_id=rng.choice(["hot", "hot", "d1", "d2", "nobody"]), limit=str(rng.choice([1, 3, 10, 500])))
        if rng.random() < 0.4:
            case["reading_type"] = rng.choice(["temperature", "humidity", "other"])
        a, b = sorted(rng.randint(-20, 620) for _ in range(2))
        for bound, minute in (("from", a), ("to", b)):
            if rng.random() < 0.6:
                case[bound] = (T0 + datetime.timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ")
        cases.append(case)
    cases += [dict(cases[0])] * 20
    parsed = Q.validate_requests(table(spark, cases))
    hits = Q.batch_latest(parsed, spark.createDataFrame(rows, READ), bucket).collect()
    got = {i: [] for i in range(len(cases))}
    for r in sorted(hits, key=lambda r: r["rn"]):
        got[r["request_id"]].append(r["id"])
        assert r["rn"] == len(got[r["request_id"]])
    assert got == {i: one_by_one(rows, c) for i, c in enumerate(cases)}


def test_outcomes_and_documents(spark):
    rows = some_readings(random.Random(5), 200)
    cases = [
        dict(device_id="hot", limit="2"),
        dict(device_id="unknown"),
        dict(device_id="unknown", to="2024-01-01T00:00:00Z"),
        dict(id="7"),
        dict(id="99999"),
        dict(id="x"),
        dict(device_id="hot", limit="501"),
        dict(),
        dict(id="1", device_id="hot"),
    ]
    outcomes, documents = answer_requests(table(spark, cases), spark.createDataFrame(rows, READ))
    got = {r["request_id"]: r["outcome"] for r in outcomes.collect()}
    bad = "INVALID_PARAMETER"
    assert got == {0: "OK", 1: "DEVICE_NOT_FOUND", 2: "OK", 3: "OK", 4: "READING_NOT_FOUND", 5: bad, 6: bad, 7: bad, 8: bad}
    docs = {r["request_id"]: json.loads(r["document"]) for r in documents.collect()}
    assert sorted(docs) == [0, 2, 3]
    assert docs[2] == {"data": [], "meta": {"count": 0, "limit": 10, "device_id": "unknown", "reading_type": ""}}
    want = one_by_one(rows, cases[0])
    assert [d["id"] for d in docs[0]["data"]] == [str(i) for i in want]
    by_id = {r[0]: r for r in rows}
    first = docs[0]["data"][0]
    assert first["timestamp"] == by_id[want[0]][2].strftime("%Y-%m-%dT%H:%M:%SZ")
    assert first["value"] == float(by_id[want[0]][4])
    for d in docs[0]["data"]:
        # An empty attribute document is left out.
        assert d.get("metadata") == ({"k": 1} if (int(d["id"]) - 1) % 3 else None)
    assert docs[3]["meta"] == {"id": "7"} and docs[3]["data"]["id"] == "7"


def test_latest_limits(spark):
    df = spark.createDataFrame(some_readings(random.Random(1), 50), READ)
    for n in (0, -1, 501):
        with pytest.raises(ValueError):
            L.latest(df, "hot", n)


def test_paging_keeps_ties(spark):
    rows = [(i, "d", T0, "t", Decimal(1), "u", "{}") for i in range(1, 8)]
    df = spark.createDataFrame(rows, READ)
    seen, cursor = [], None
    for _ in range(4):
        page = (
            L.latest(df, "d", 2) if cursor is None else L.page_before(df, "d", "2024-01-01 00:00:00", cursor, 2)
        ).collect()
        seen += [r["id"] for r in page]
        cursor = seen[-1]
    assert seen == [7, 6, 5, 4, 3, 2, 1]


def test_lookup_of_a_repeated_id(spark):
    df = spark.createDataFrame(some_readings(random.Random(2), 50), READ)
    parsed = Q.validate_requests(table(spark, [dict(id="3")] * 40 + [dict(id="77")]))
    out = Q.lookup_ids(parsed, df)
    assert out.where("outcome = 'OK' and device_id is not null").count() == 40
    assert out.where(F.col("outcome") == "READING_NOT_FOUND").count() == 1


def test_only_reached_hours_are_opened(spark):
    """Of a device with 40 hours of readings, a question opens the hours that its limit can reach."""
    readings = spark.range(4000).select(
        F.lit("d").alias("device_id"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("reading_type"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 36).alias("ts"),  # 100 an hour
    )
    at = lambda h: T0 + datetime.timedelta(hours=h)
    questions = spark.createDataFrame(
        [("d", "", None, at(20.5), 120), ("d", "x", at(3), at(8), 500), ("d", "x", None, at(1000), 1)],
        "device_id string, series string, from_ts timestamp, to_ts timestamp, _most int",
    )
    hours = Q.reached_hours(questions, readings).collect()
    base = 1704067200 // 3600
    opened = {(r["series"], r["bucket"] - base) for r in hours if r["_open"]}
    assert opened == {("", h) for h in (20, 19, 18)} | {("x", 39)} | {("x", h) for h in range(9)}
    empty = {(r["series"], r["bucket"] - base): r["_in"] for r in hours if not r["_open"]}
    assert empty[("x", 1000)] == 0 and ("y", 5) not in empty
    offsets = {(r["series"], r["bucket"] - base): (r["_offset"], r["_total"]) for r in hours}
    assert offsets[("", 20)] == (1900, 4000) and offsets[("x", 8)] == (1550, 2000)


def test_documents_from_texts_equal_those_from_records(spark, sf):
    from tidemark.catalog.tables import events, requests_at

    parsed, readings = requests_at(spark, sf), events(spark, sf)
    records = Q.to_documents(parsed, Q.batch_latest(parsed, readings))
    texts = Q.batch_latest(parsed, Q.with_text(readings), carried=["text"])
    assert texts.columns == ["request_id", "rn", "id", "device_id", "text"]
    assert sorted(records.collect()) == sorted(Q.to_documents(parsed, texts).collect())


def hits_of(spark, parsed, readings, listed):
    if listed:
        out = Q.batch_latest(parsed, readings, listed="text").collect()
        return sorted((r["request_id"], i + 1, t) for r in out for i, t in enumerate(r["text"]))
    out = Q.batch_latest(parsed, readings, carried=["text"]).collect()
    return sorted((r["request_id"], r["rn"], r["text"]) for r in out)


@pytest.mark.parametrize("bounds", [("from", "to"), ("from",)])
def test_lists_equal_rows(spark, monkeypatch, bounds):
    """Also where a list runs into the next block, and where blocks are copied."""
    monkeypatch.setattr(Q, "BLOCK", 500)
    monkeypatch.setattr(Q, "CROWD", 3)
    rng = random.Random(len(bounds))
    rows = some_readings(rng) + [(9000 + i, "d1", None, "humidity", Decimal(i), "u", None) for i in range(3)]
    cases = [dict(device_id="hot", limit="500", to="2024-01-01T05:00:00Z")] if "to" in bounds else []
    for _ in range(120):
        case = dict(device_id=rng.choice(["hot", "hot", "d1", "nobody"]), limit=str(rng.choice([1, 10, 300, 500])))
        if rng.random() < 0.4:
            case["reading_type"] = rng.choice(["temperature", "other"])
        a, b = sorted(rng.randint(-20, 620) for _ in range(2))
        for bound, minute in (("from", a), ("to", b)):
            if bound in bounds and rng.random() < 0.7:
                case[bound] = (T0 + datetime.timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ")
        cases.append(case)
    parsed = Q.validate_requests(table(spark, cases))
    readings = Q.with_text(spark.createDataFrame(rows, READ))
    want = hits_of(spark, parsed, readings, listed=False)
    assert want and hits_of(spark, parsed, readings, listed=True) == want
    lists = Q.batch_latest(parsed, readings, listed="text")
    assert lists.count() == len(cases)


def test_documents_of_repeated_and_null_request_ids(spark):
    """Requests of one id share their readings; those without an id have none."""
    rows = some_readings(random.Random(8), 200)
    cases = [
        dict(device_id="hot", limit="3"),
        dict(device_id="d1", limit="2"),
        dict(device_id="hot", limit="4", to="2024-01-01T05:00:00Z"),
        dict(device_id="nobody", to="2024-01-01T05:00:00Z"),
        dict(device_id="nobody"),
        dict(device_id="hot", reading_type="humidity"),
        dict(device_id="hot", limit="2", **{"from": "2024-01-01T01:00:00Z"}),
        dict(id="7"),
    ]
    ids = {0: 1, 1: 1, 2: 2, 3: 3, 4: 1, 5: None, 6: None, 7: 2}
    request_id = F.create_map(*[F.lit(v) for kv in ids.items() for v in kv])[F.col("request_id")].cast("bigint")
    parsed = Q.validate_requests(table(spark, cases).withColumn("request_id", request_id))
    readings = Q.with_text(spark.createDataFrame(rows, READ))
    by_rows = Q.to_documents(parsed, Q.batch_latest(parsed, readings, carried=["text"])).collect()
    by_lists = Q.to_documents(parsed, Q.batch_latest(parsed, readings, listed="text")).collect()
    assert sorted(map(repr, by_lists)) == sorted(map(repr, by_rows))
    sizes = sorted((str(r["request_id"]), json.loads(r["document"])["meta"]["count"]) for r in by_lists)
    assert sizes == [("1", 5), ("1", 5), ("1", 5), ("2", 4), ("3", 0), ("None", 0)]


def test_documents_are_not_shuffled(spark, sf):
    """The texts of a request, up to 500, stay where its list is cut."""
    from tidemark.catalog.request_tables import CATALOG

    plan = CATALOG["response_documents"][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(request_id" not in plan
