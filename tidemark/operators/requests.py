"""Lookups for a whole table of requests at once.

A request table has text columns ``request_id, id, device_id, limit, reading_type, from, to``;
null and empty text both mean absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import BROADCAST_ROWS, checked, keep_matching, on_same
from tidemark.functions.text import (
    DEVICE_PATTERN,
    TYPE_PATTERN,
    leading_long,
    matches,
    rfc3339,
    rfc3339_text,
    strict_long,
)
from tidemark.session import written
from tidemark.spec import READING_COLUMNS

DEFAULT_LIMIT = 10
MAX_LIMIT = 500
RECORD = READING_COLUMNS[2:]
BLOCK = 1000
CROWD = 5000


def validate_requests(req: DataFrame) -> DataFrame:
    """Parsed requests with ``error_code`` and ``error_param`` of the first broken rule."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("id", "device_id", "reading_type", "from", "to")}
    by_id = text["id"] != ""
    by_device = text["device_id"] != ""
    row_id = strict_long(text["id"])
    limit = leading_long(F.col("limit"), DEFAULT_LIMIT)
    frm, to = rfc3339(text["from"]), rfc3339(text["to"])
    lookup = by_id & ~by_device
    broken = (
        F.when(by_id & by_device, "id,device_id")
        .when(~by_id & ~by_device, "id or device_id")
        .when(lookup & (row_id.isNull() | (row_id < 1)), "id")
        .when(lookup, F.lit(None))
        .when((limit < 1) | (limit > MAX_LIMIT), "limit")
        .when((text["from"] != "") & frm.isNull(), "from")
        .when((text["to"] != "") & to.isNull(), "to")
        .when(frm > to, "from, to")
        .when(~matches(text["device_id"], DEVICE_PATTERN), "device_id")
        .when((text["reading_type"] != "") & ~matches(text["reading_type"], TYPE_PATTERN), "reading_type")
    )
    parsed = req.select(
        "request_id",
        F.when(lookup, "id").when(by_device & ~by_id, "device").alias("mode"),
        F.when(lookup, row_id).alias("id"),
        F.when(by_device, text["device_id"]).alias("device_id"),
        F.when(by_device, limit).alias("limit"),
        F.when(by_device & (text["reading_type"] != ""), text["reading_type"]).alias("reading_type"),
        F.when(by_device, frm).alias("from_ts"),
        F.when(by_device, to).alias("to_ts"),
        broken.alias("error_param"),
    )
    return parsed.withColumn(
        "error_code", F.when(F.col("error_param").isNotNull(), "INVALID_PARAMETER")
    )


def lookup_ids(parsed: DataFrame, readings: DataFrame) -> DataFrame:
    """Every request by id alone with its reading, ``OK``, ``READING_NOT_FOUND`` or its error.

    Readings meet each wanted id once, however often it is requested, and are not shuffled
    while the ids are few enough to broadcast. The least and greatest wanted id bound the scan.
    """
    asked = parsed.where("mode = 'id'")
    wanted = asked.where("error_code is null").select("id").distinct()
    ids = wanted.agg(F.count("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    inside = F.col("id").between(ids["low"], ids["high"]) if ids["n"] else F.lit(False)
    listed = F.broadcast(wanted) if ids["n"] <= BROADCAST_ROWS else wanted
    found = readings.select(*READING_COLUMNS).where(inside).join(listed, "id")
    hits = found.select(F.col("id").alias("_id"), *READING_COLUMNS[1:], F.lit(True).alias("_hit"))
    valid = F.when(F.col("error_code").isNull(), F.col("id"))
    return (
        asked.select("request_id", "id", "error_code", valid.alias("_want"))
        .join(hits, F.col("_want") == F.col("_id"), "left")
        .select(
            "request_id",
            "id",
            F.coalesce(
                "error_code", F.when(F.col("_hit"), "OK").otherwise("READING_NOT_FOUND")
            ).alias("outcome"),
            *READING_COLUMNS[1:],
        )
    )


def _series(readings: DataFrame) -> DataFrame:
    """Each reading under its own type and, as ``series`` '', under its device alone."""
    return readings.select("*", F.explode(_both()).alias("series"))


def _both() -> Column:
    return F.array_distinct(F.array(F.lit(""), F.col("reading_type")))


def _bucket(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds)


def batch_latest(
    parsed: DataFrame,
    readings: DataFrame,
    bucket_seconds: int = 3600,
    carried: list[str] | None = None,
    listed: str | None = None,
) -> DataFrame:
    """The newest ``limit`` readings of every valid device request, with their rank ``rn``.

    ``carried`` names the columns of ``readings`` that come with the id, if not a whole record.
    Requests without ``to`` share one ranking of at most 500 readings per series. Requests with
    ``to`` are answered by position, so that many requests on one busy device never meet all
    of its readings; see ``_spans``. They count the readings of every hour, but take no more
    of them than the hours that some request can reach. The parsed requests are written once,
    because several steps read them.

    With ``listed``, a column of ``readings``, the answer is instead one row per request, with
    the values of that column in the order of their ranks; see ``_lists``.
    """
    valid = parsed.where((F.col("mode") == "device") & F.col("error_code").isNull())
    asked = valid.select(
        "request_id",
        "device_id",
        F.coalesce("reading_type", F.lit("")).alias("series"),
        F.col("limit"),
        "from_ts",
        "to_ts",
    )
    asked = written(_with_alone(asked) if listed else asked, "requests")
    keys = ["device_id", "series"]
    carried = [listed] if listed else list(RECORD) if carried is None else carried
    readings = readings.select(*dict.fromkeys([*READING_COLUMNS[:4], *carried]))
    edge = asked.agg(F.unix_micros(F.max("to_ts")).alias("edge")).first()["edge"]
    latest = asked.where("to_ts is null")
    top = _top(keep_matching(_series(readings), latest, keys))
    if edge is None:
        return _lists(latest, top, None, None, listed) if listed else _newest(latest, top, carried)
    ended = asked.where("to_ts is not null")
    before = readings.where(F.col("ts") <= F.timestamp_micros(F.lit(edge)))
    spans, rows = _spans(ended, before, bucket_seconds, carried)
    if listed:
        return _lists(asked, top, spans, rows, listed)
    return _newest(latest, top, carried).unionByName(_bounded(ended, spans, rows, carried))


def _with_alone(asked: DataFrame) -> DataFrame:
    """Whether a request is the only one with its ``request_id``, which is not null."""
    counts = asked.groupBy("request_id").agg((F.count(F.lit(1)) == 1).alias("alone"))
    return asked.join(counts, "request_id", "left").withColumn(
        "alone", F.coalesce("alone", F.lit(False))
    )


def _top(series: DataFrame) -> DataFrame:
    order = Window.partitionBy("device_id", "series").orderBy(F.desc("ts"), F.desc("id"))
    return series.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= MAX_LIMIT)


def _newest(asked: DataFrame, top: DataFrame, carried: list[str]) -> DataFrame:
    inside = (F.col("rn") <= F.col("limit")) & (
        F.col("from_ts").isNull() | (F.col("ts") >= F.col("from_ts"))
    )
    return top.join(asked, ["device_id", "series"]).where(inside).select(
        "request_id", "rn", "id", "device_id", *carried
    )


def _lists(
    asked: DataFrame, top: DataFrame, spans: DataFrame | None, rows: DataFrame | None, listed: str
) -> DataFrame:
    """One row per request: its columns, ``alone``, and the ``listed`` values of its readings.

    The values of a series are gathered once, in blocks of ``BLOCK`` positions and the 500 that
    follow, so the list of a request lies in the block of its first position and is cut out of
    it where the two meet: the answers, many times the readings, are never shuffled. A block
    that more than ``CROWD`` requests want is copied for every so many of them.
    """
    question = ["device_id", "series", "from_ts", "to_ts"]
    place = ["device_id", "series", "_ended", "block"]
    number = F.col("limit").cast("bigint")
    wanted = asked.where("to_ts is null").select(
        "*",
        F.lit(False).alias("_ended"),
        F.lit(0).cast("bigint").alias("_after"),
        number.alias("_most"),
    )
    # Where the series were too many for ``keep_matching``, rows that nobody asks for end here.
    asked_for = wanted.select("device_id", "series").distinct()
    values = top.join(asked_for, ["device_id", "series"], "left_semi").select(
        "device_id",
        "series",
        F.lit(False).alias("_ended"),
        F.col("rn").cast("bigint").alias("pos"),
        "ts",
        listed,
    )
    if spans is not None:
        ended = on_same(asked.where("to_ts is not null"), spans, question, "left").select(
            *asked.columns,
            F.lit(True).alias("_ended"),
            "_after",
            F.least(F.col("_last") - F.col("_after"), number).alias("_most"),
        )
        wanted = wanted.unionByName(ended)
        values = values.unionByName(
            rows.select(
                "device_id",
                "series",
                F.lit(True).alias("_ended"),
                "pos",
                F.lit(None).cast("timestamp").alias("ts"),
                listed,
            )
        )
    block = F.floor(F.col("_after") / BLOCK)
    wanted = written(wanted.withColumn("block", block), "wanted")
    crowded = (
        wanted.groupBy(*place)
        .agg(F.ceil(F.count(F.lit(1)) / CROWD).alias("_copies"))
        .where("_copies > 1 and block is not null")
    )
    copies = F.coalesce("_copies", F.lit(1))
    own = F.floor((F.col("pos") - 1) / BLOCK)
    follows = (own > 0) & ((F.col("pos") - 1) % BLOCK < MAX_LIMIT)
    item = F.struct("pos", "ts", F.col(listed).alias("value"))
    blocks = (
        values.withColumn("block", F.explode(F.when(follows, F.array(own, own - 1)).otherwise(F.array(own))))
        .join(F.broadcast(crowded), place, "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
        .groupBy(*place, "_copy")
        .agg(F.sort_array(F.collect_list(item)).alias("_items"))
        .select(
            *place,
            "_copy",
            F.col("_items.pos").alias("_places"),
            F.col("_items.ts").alias("_stamps"),
            F.col("_items.value").alias("_values"),
        )
    )
    start = F.array_position("_places", F.col("_after") + 1).cast("int")
    most = F.col("_most").cast("int")
    since = F.size(F.filter(F.slice("_stamps", F.lit(1), most), lambda ts: ts >= F.col("from_ts")))
    most = F.when(F.col("_ended") | F.col("from_ts").isNull(), most).otherwise(since)
    none = F.array().cast(f"array<{top.schema[listed].dataType.simpleString()}>")
    return (
        wanted.join(F.broadcast(crowded), place, "left")
        .withColumn("_copy", F.pmod(F.xxhash64("request_id"), copies))
        .join(blocks, [*place, "_copy"], "left")
        .select(
            *asked.columns,
            F.when(start > 0, F.slice("_values", start, most)).otherwise(none).alias(listed),
        )
    )


def reached_hours(questions: DataFrame, readings: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Time buckets of the asked series that hold a reading or a bound of a question.

    ``questions(device_id, series, from_ts, to_ts, _most)``. ``_in`` readings lie in the bucket,
    ``_offset`` in later ones and ``_total`` in all. ``_open`` says that a question may need the
    bucket: going back from the bucket of its ``to``, fewer than ``_most`` readings were passed.
    Readings are only counted, per device, type and bucket before any shuffle.
    """
    keys = ["device_id", "series"]
    counts = (
        keep_matching(readings, questions, ["device_id"])
        .groupBy("device_id", "reading_type", _bucket("ts", bucket_seconds).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("_in"))
        .select("device_id", F.explode(_both()).alias("series"), "bucket", "_in")
        .join(questions.select(*keys).distinct(), keys, "left_semi")
    )
    bounds = F.array(
        F.struct(_bucket("to_ts", bucket_seconds).alias("bucket"), F.col("_most").alias("_most")),
        F.struct(_bucket("from_ts", bucket_seconds).alias("bucket"), F.lit(None).cast("int").alias("_most")),
    )
    bounds = questions.select(*keys, F.inline(bounds)).where("bucket is not null")
    hours = (
        counts.unionByName(bounds, allowMissingColumns=True)
        .groupBy(*keys, "bucket")
        .agg(F.coalesce(F.sum("_in"), F.lit(0)).alias("_in"), F.max("_most").alias("_most"))
    )
    whole = Window.partitionBy(*keys)
    back = whole.orderBy(F.desc("bucket"))
    placed = hours.withColumns({
        "_offset": F.coalesce(F.sum("_in").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_in").over(whole),
    })
    reach = F.max(F.col("_offset") + F.col("_in") + F.col("_most"))
    reach = reach.over(back.rowsBetween(Window.unboundedPreceding, 0))
    is_open = (F.col("_in") > 0) & F.coalesce(F.col("_offset") < reach, F.lit(False))
    return placed.select(*keys, "bucket", "_in", "_offset", "_total", is_open.alias("_open"))


def _spans(
    asked: DataFrame, readings: DataFrame, bucket_seconds: int, carried: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(positions that each question wants, readings at their positions), newest first.

    Bounds are placed between the readings as marks: a ``to`` mark before readings of the same
    instant, a ``from`` mark after them. Readings and marks alike are numbered within their
    (series, time bucket) behind the number of later readings, which ``reached_hours`` tells;
    only open buckets are read, broadcast against the readings while they are few. A ``from``
    mark in a closed bucket lies beyond its question's limit, wherever it is in the bucket. A
    question then wants the positions after its ``to`` mark, ``_after``, up to its limit and
    its ``from`` mark, ``_last``. Equal questions are answered once.
    """
    keys = ["device_id", "series"]
    question = [*keys, "from_ts", "to_ts"]
    questions = asked.groupBy(*question).agg(F.max("limit").alias("_most"))
    hours = written(reached_hours(questions, readings, bucket_seconds), "reached-hours")
    place = [*keys, "bucket", "_offset", "_total"]
    opened = checked(hours.where("_open").select(*place))
    bounds = F.array(
        F.struct(F.lit(0).alias("place"), F.col("to_ts").alias("ts")),
        F.struct(F.lit(2).alias("place"), F.col("from_ts").alias("ts")),
    )
    marks = (
        questions.select("*", F.inline(bounds))
        .where("ts is not null")
        .withColumn("bucket", _bucket("ts", bucket_seconds))
        .join(hours.select(*place), [*keys, "bucket"])
    )
    line = (
        _series(readings)
        .withColumn("bucket", _bucket("ts", bucket_seconds))
        .join(opened, [*keys, "bucket"])
        .withColumn("place", F.lit(1))
        .unionByName(marks, allowMissingColumns=True)
        .withColumn("_one", (F.col("place") == 1).cast("bigint"))
    )
    local = Window.partitionBy(*keys, "bucket").orderBy(F.desc("ts"), "place", F.desc("id"))
    placed = line.withColumn(
        "pos", F.sum("_one").over(local.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_offset")
    )
    last = F.least(F.col("_after") + F.col("_most"), F.coalesce("_upto", "_total"))
    spans = (
        placed.where("place <> 1")
        .groupBy(*question)
        .agg(
            F.max(F.when(F.col("place") == 0, F.col("pos"))).alias("_after"),
            F.max(F.when(F.col("place") == 2, F.col("pos"))).alias("_upto"),
            F.max("_total").alias("_total"),
            F.max("_most").alias("_most"),
        )
        .where(last > F.col("_after"))
        .select(*question, "_after", last.alias("_last"))
    )
    return spans, placed.where("place = 1").select(*keys, "pos", "id", *carried)


def _bounded(asked: DataFrame, spans: DataFrame, rows: DataFrame, carried: list[str]) -> DataFrame:
    """Questions pick their positions by equality, so the join emits exactly the result."""
    keys = ["device_id", "series"]
    question = [*keys, "from_ts", "to_ts"]
    positions = F.sequence(F.col("_after") + 1, F.col("_last"))
    picks = spans.select(*question, "_after", F.explode(positions).alias("pos"))
    answers = picks.join(rows, [*keys, "pos"]).withColumn(
        "rn", (F.col("pos") - F.col("_after")).cast("int")
    )
    who = asked.select(
        "request_id",
        *[F.col(c).alias(f"_{c}") for c in question],
        F.col("limit").alias("_limit"),
    )
    same = F.col("rn") <= F.col("_limit")
    for c in question:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return answers.join(who, same).select("request_id", "rn", "id", "device_id", *carried)


def request_outcome(parsed: DataFrame, hits: DataFrame) -> DataFrame:
    """Outcome and row count of every request that is not by id alone.

    No rows and no bound means that the device is unknown; no rows within bounds is a success.
    """
    counts = hits.groupBy("request_id").agg(F.count(F.lit(1)).alias("row_count"))
    unbounded = F.col("from_ts").isNull() & F.col("to_ts").isNull()
    return (
        parsed.where((F.col("mode") == "device") | F.col("mode").isNull())
        .join(counts, "request_id", "left")
        .select(
            "request_id",
            F.coalesce(
                "error_code",
                F.when(F.col("row_count").isNull() & unbounded, "DEVICE_NOT_FOUND").otherwise("OK"),
            ).alias("outcome"),
            F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"),
        )
    )


def _record() -> Column:
    empty = F.col("metadata").isNull() | (F.translate("metadata", " \t\r\n", "") == "{}")
    return F.struct(
        F.col("id").cast("string").alias("id"),
        "device_id",
        rfc3339_text(F.col("ts")).alias("timestamp"),
        "reading_type",
        F.col("value").cast("double").alias("value"),
        "unit",
        F.when(~empty, F.try_parse_json("metadata")).alias("metadata"),
    )


def with_text(readings: DataFrame) -> DataFrame:
    """Readings with the JSON ``text`` of their record, written once however often it is asked for."""
    return readings.withColumn("text", F.to_json(_record()))


def to_documents(parsed: DataFrame, hits: DataFrame) -> DataFrame:
    """One JSON document per successful device request, readings newest first.

    Hits bring the ``text`` of their records (``with_text``) or the records themselves. They
    come as rows, or as the lists of ``batch_latest``: a list is then its request's document,
    without a shuffle, unless the ``request_id`` is null or that of several requests.

    A document holds at most 500 readings by the request rules, so a group stays small.
    """
    valid = parsed.where((F.col("mode") == "device") & F.col("error_code").isNull())
    if "alone" not in hits.columns:
        text = F.col("text") if "text" in hits.columns else F.to_json(_record())
        return _documents(valid, hits.select("request_id", F.struct("rn", text.alias("text")).alias("item")))
    single = hits.where("alone").withColumnRenamed("series", "reading_type")
    documents = single.where(_known(F.size("text") > 0)).select("request_id", _document(F.col("text")))
    shared = valid.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    shared = shared.where("n > 1 or request_id is null").select("request_id")
    if shared.isEmpty():
        return documents
    several = hits.where(~F.col("alone")).select("request_id", F.posexplode("text").alias("rn", "text"))
    items = several.select("request_id", F.struct("rn", "text").alias("item"))
    rest = on_same(valid, shared, ["request_id"], "left_semi")
    return documents.unionByName(_documents(rest, items))


def _documents(valid: DataFrame, items: DataFrame) -> DataFrame:
    grouped = items.groupBy("request_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    texts = F.coalesce(F.col("items.text"), F.array().cast("array<string>"))
    return (
        valid.join(grouped, "request_id", "left")
        .where(_known(F.col("items").isNotNull()))
        .select("request_id", _document(texts))
    )


def _known(answered: Column) -> Column:
    return answered | F.col("from_ts").isNotNull() | F.col("to_ts").isNotNull()


def _document(texts: Column) -> Column:
    meta = F.struct(
        F.size(texts).cast("bigint").alias("count"),
        F.col("limit"),
        "device_id",
        F.coalesce("reading_type", F.lit("")).alias("reading_type"),
    )
    return F.concat(
        F.lit('{"data":['), F.array_join(texts, ","), F.lit('],"meta":'), F.to_json(meta), F.lit("}")
    ).alias("document")


def to_record_documents(found: DataFrame) -> DataFrame:
    """One JSON document per found id request."""
    record_id = F.struct(F.col("id").cast("string").alias("id"))
    return found.where("outcome = 'OK'").select(
        "request_id",
        F.to_json(F.struct(_record().alias("data"), record_id.alias("meta"))).alias("document"),
    )
