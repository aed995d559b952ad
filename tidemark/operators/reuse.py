"""Request keys, and which requests a cache with a fixed time to live would have answered."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import gap_islands, running_max
from tidemark.functions.ship import ship
from tidemark.session import written

ship(__name__)

MICROS = 1_000_000
FANOUT = 128
FOLD_INSTANTS = 4096
NEVER = -(2**62)


def request_key() -> Column:
    """Key text of a parsed request: device, limit, type and bounds, or the id."""
    bounds = [
        F.coalesce(F.concat(F.lit(":"), F.unix_seconds(c).cast("string")), F.lit(""))
        for c in ("from_ts", "to_ts")
    ]
    kind = F.coalesce(F.concat(F.lit(":"), F.col("reading_type")), F.lit(""))
    by_device = F.concat(
        F.lit("sensor:"), "device_id", F.lit(":readings:"), F.col("limit").cast("string"), kind, *bounds
    )
    by_id = F.concat(F.lit("sensor:id:"), F.col("id").cast("string"))
    return F.when(F.col("mode") == "id", by_id).when(F.col("mode") == "device", by_device)


def unambiguous_key() -> Column:
    """The same parts with a fixed slot each, so that different requests never share a key."""
    slots = [
        F.coalesce(c, F.lit(""))
        for c in (
            F.col("device_id"),
            F.col("limit").cast("string"),
            F.col("reading_type"),
            F.unix_micros("from_ts").cast("string"),
            F.unix_micros("to_ts").cast("string"),
        )
    ]
    by_device = F.concat_ws(":", F.lit("device"), *slots)
    by_id = F.concat(F.lit("id:"), F.col("id").cast("string"))
    return F.when(F.col("mode") == "id", by_id).when(F.col("mode") == "device", by_device)


# A fill opens a stretch of ``ttl`` in which the key's requests are hits; the next fill is the
# first fillable request after that stretch. Fillable requests at least one ttl apart always
# fill, so the key's time line falls into islands that start with a fill. In an island shorter
# than ttl that is the only one, and an island of few instants is folded as one short array.
# The others are cut into chunks of time. Within a chunk, the
# last fill is a step function of the moment from which filling is allowed again, and that
# moment lies less than one ttl into the chunk: the steps of its first ttl sum the chunk up.
# Summaries of neighbouring chunks are chained into larger chunks, up to one chain per island,
# and the states so found are handed down again. No task sees more of a busy key than the
# distinct fillable times of one chunk.

STEPS = "key string, island bigint, chunk bigint, at array<bigint>, last array<bigint>"
STATES = "key string, island bigint, chunk bigint, entry bigint"
LINE = ["key", "island"]


def _steps(at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of moments that end in the same last fill, only the latest is needed."""
    keep = np.append(last[1:] != last[:-1], True)
    return at[keep], last[keep]


def _chain_within(times: np.ndarray, start: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps of one chunk from its sorted fillable times."""
    after = np.searchsorted(times, times + ttl)
    follow = np.where(after < len(times), after, np.arange(len(times)))
    while (follow[follow] != follow).any():
        follow = follow[follow]
    last = times[follow]
    seen = min(len(times), int(np.searchsorted(times, start + ttl)) + 1)
    return _steps(times[:seen], last[:seen])


def _follow(entry: np.ndarray, ttl: int, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Last fills after a chunk, for the last fills before it."""
    place = np.searchsorted(at, entry + ttl)
    inside = place < len(at)
    return np.where(inside, last[np.minimum(place, len(at) - 1)], entry)


def _sorted_children(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    rows = pdf.sort_values("chunk")
    return [
        (int(c), np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64))
        for c, a, b in zip(rows["chunk"], rows["at"], rows["last"])
    ]


def _chain_fills(instants: DataFrame, ttl: int) -> DataFrame:
    """Fill times of long islands from their fillable ``instants(key, island, _t)``."""
    length = [ttl * FANOUT, ttl * FANOUT * FANOUT]
    chunked = instants.withColumn("chunk", F.floor(F.col("_t") / length[0]))

    def summarise(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        key, island, chunk = group
        times = np.sort(pdf["_t"].to_numpy(dtype=np.int64))
        at, last = _chain_within(times, int(chunk) * length[0], ttl)
        return pd.DataFrame({"key": [key], "island": [island], "chunk": [chunk], "at": [at], "last": [last]})

    def chain(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        key, island, parent = group
        children = _sorted_children(pdf)
        at, last = children[0][1], children[0][2]
        rest = children[1:]
        if rest and at[-1] < int(parent) * length[1] + ttl:
            # Filling may become possible only after the first chunk's last moment.
            at, last = np.append(at, rest[0][1][:1]), np.append(last, NEVER)
        for _, child_at, child_last in rest:
            last = _follow(last, ttl, child_at, child_last)
        at, last = _steps(at, last)
        return pd.DataFrame({"key": [key], "island": [island], "chunk": [parent], "at": [at], "last": [last]})

    def hand_down(key: str, island: int, children: list, entry: int) -> pd.DataFrame:
        chunks, entries = [], []
        state = np.array([entry], dtype=np.int64)
        for chunk, at, last in children:
            chunks.append(chunk)
            entries.append(int(state[0]))
            state = _follow(state, ttl, at, last)
        return pd.DataFrame({"key": key, "island": island, "chunk": chunks, "entry": entries})

    def over_island(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return hand_down(*group, _sorted_children(pdf), NEVER)

    def over_parent(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return hand_down(group[0], group[1], _sorted_children(pdf), int(pdf["entry"].iloc[0]))

    def fills(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_t"].to_numpy(dtype=np.int64))
        picked, place = [], int(np.searchsorted(times, int(pdf["entry"].iloc[0]) + ttl))
        while place < len(times):
            picked.append(times[place])
            place = int(np.searchsorted(times, times[place] + ttl))
        return pd.DataFrame({"key": group[0], "_t": np.array(picked, dtype=np.int64)})

    # Used on the way up and on the way down.
    small = written(chunked.groupBy(*LINE, "chunk").applyInPandas(summarise, STEPS), "reuse-steps")
    nested = small.withColumn("parent", F.floor(F.col("chunk") / FANOUT))
    large = nested.groupBy(*LINE, "parent").applyInPandas(chain, STEPS)
    large_states = large.groupBy(*LINE).applyInPandas(over_island, STATES)
    small_states = (
        nested.join(large_states.withColumnRenamed("chunk", "parent"), [*LINE, "parent"])
        .groupBy(*LINE, "parent")
        .applyInPandas(over_parent, STATES)
    )
    return (
        chunked.join(small_states, [*LINE, "chunk"])
        .groupBy(*LINE, "chunk")
        .applyInPandas(fills, "key string, _t bigint")
    )


def _folded_fills(instants: DataFrame, ttl: int) -> DataFrame:
    """Fill times of islands with a bounded number of instants."""
    start = F.struct(
        F.lit(NEVER).alias("last"), F.array().cast("array<bigint>").alias("fills")
    )

    def step(state: Column, t: Column) -> Column:
        filled = F.struct(t.alias("last"), F.concat(state["fills"], F.array(t)).alias("fills"))
        return F.when(t >= state["last"] + ttl, filled).otherwise(state)

    times = instants.groupBy(*LINE).agg(F.sort_array(F.collect_list("_t")).alias("times"))
    fills = F.aggregate("times", start, step, lambda state: state["fills"])
    return times.select("key", F.explode(fills).alias("_t"))


def ttl_status(
    log: DataFrame, ttl_seconds: int = 30, fold_instants: int = FOLD_INSTANTS
) -> DataFrame:
    """Add ``cache_status``: HIT within ``ttl`` of the key's last fill, otherwise MISS.

    A miss with a successful, non-empty result fills. Hits do not prolong a fill, and a request
    exactly ``ttl`` after the fill is a miss. Equal times are ordered by request id. Requests
    without a key have no status.
    """
    ttl, chunk = ttl_seconds * MICROS, ttl_seconds * FANOUT
    rows = log.where("key is not null").withColumn("_t", F.unix_micros("ts"))
    fillable = (
        rows.where(F.col("status").between(200, 299) & (F.col("rows") > 0))
        .groupBy("key", "ts", "_t")
        .agg(F.min("request_id").alias("request_id"))
    )
    found = gap_islands(fillable, ["key"], ["ts"], ttl_seconds, chunk)
    instants = written(found.withColumn("island", F.unix_micros("island")), "reuse-instants")
    spans = instants.groupBy(*LINE).agg(
        (F.max("_t") - F.col("island")).alias("_span"), F.count(F.lit(1)).alias("_n")
    )
    long = spans.where(F.col("_span") >= ttl)
    single = spans.where(F.col("_span") < ttl).select("key", F.col("island").alias("_t"))
    short_lists = long.where(F.col("_n") <= fold_instants).select(*LINE)
    fills = single.unionByName(_folded_fills(instants.join(short_lists, LINE, "left_semi"), ttl))
    busy = long.where(F.col("_n") > fold_instants).select(*LINE)
    if not busy.isEmpty():
        crowded = instants.join(busy, LINE, "left_semi").select(*LINE, "_t")
        fills = fills.unionByName(_chain_fills(crowded, ttl))
    filled = fills.join(instants, ["key", "_t"]).select(
        "key", "_t", "request_id", F.col("_t").alias("_filled")
    )
    marked = rows.join(filled, ["key", "_t", "request_id"], "left")
    seen = running_max(marked, ["key"], ["ts", "request_id"], F.col("_filled"), "_last", chunk)
    hit = F.col("_filled").isNull() & (F.col("_t") < F.col("_last") + ttl)
    judged = seen.withColumn("cache_status", F.when(hit, "HIT").otherwise("MISS"))
    keyless = log.where("key is null").withColumn("cache_status", F.lit(None).cast("string"))
    return judged.select(*keyless.columns).unionByName(keyless)
