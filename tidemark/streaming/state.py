"""Keyed state over streams: cache reuse and alerts that must hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemark.functions.joins import checked
from tidemark.functions.ship import ship
from tidemark.streaming.rollups import _start

ship(__name__)

MICROS = 1_000_000
#: Rows of one key that are handed back at once.
PIECE = 20_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class ReuseProcessor(StatefulProcessor):
    """Remembers per key until when the last fill answers; a timer forgets expired fills."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * MICROS

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Three arrays of numbers are all that is held of a key: a busy one has millions of rows.
        times, ids, fills = [], [], []
        for piece in rows:
            times.append(piece["t"].to_numpy(np.int64))
            ids.append(piece["request_id"].to_numpy(np.int64))
            fills.append((piece["fills"] == True).to_numpy(bool))  # noqa: E712  null fills nothing
        times, ids, fills = np.concatenate(times), np.concatenate(ids), np.concatenate(fills)
        order = np.lexsort((ids, times))
        until = before = self.until.get()[0] if self.until.exists() else None
        for start in range(0, len(order), PIECE):
            at, statuses = order[start : start + PIECE], []
            for t, fill in zip(times[at].tolist(), fills[at].tolist()):
                hit = until is not None and t < until
                statuses.append("HIT" if hit else "MISS")
                if fill and not hit:
                    until = t + self.ttl
            yield pd.DataFrame({"request_id": ids[at], "key": key[0], "cache_status": statuses})
        if until != before:
            self.until.update((until,))
            self.handle.registerTimer(until // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and self.until.get()[0] // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def reuse_stream(log: DataFrame, ttl_seconds: int = 30, late: str = "1 hour") -> DataFrame:
    """``cache_status`` of each request, as ``ttl_status`` gives it for a finished log."""
    rows = log.withWatermark("ts", late).select(
        "ts",
        "key",
        "request_id",
        F.unix_micros("ts").alias("t"),
        (F.col("status").between(200, 299) & (F.col("rows") > 0)).alias("fills"),
    )
    return rows.where("key is not null").groupBy("key").transformWithStateInPandas(
        statefulProcessor=ReuseProcessor(ttl_seconds),
        outputStructType="request_id bigint, key string, cache_status string",
        outputMode="Append",
        timeMode="EventTime",
    )


class HoldProcessor(StatefulProcessor):
    """Remembers per series since when its condition holds, and fires once it held enough."""

    def init(self, handle) -> None:
        self.run = handle.getValueState("run", "since bigint, fired boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("t")
        since, fired = self.run.get() if self.run.exists() else (None, False)
        out = []
        for t, holds, hold in zip(batch["t"], batch["holds"], batch["hold"]):
            if not holds:
                since, fired = None, False
                continue
            if since is None:
                since = int(t)
            if not fired and t - since >= hold:
                fired = True
                out.append((key[0], key[1], since, since + int(hold)))
        if since is None:
            self.run.clear()
        else:
            self.run.update((since, fired))
        yield pd.DataFrame(out, columns=["rule", "series", "pending", "firing"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter([])

    def close(self) -> None:
        pass


class OrderedHoldProcessor(StatefulProcessor):
    """Holds evaluations back until the watermark has passed them, then judges them by time.

    Evaluations wait in a list state. A timer at the newest of a batch takes out all that the
    watermark has passed, in the order of their time, whatever batch they came in; the run that
    they continue is remembered as (since, fired).
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "since bigint, fired boolean")
        self.waiting = handle.getListState("waiting", "t bigint, holds boolean, hold bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        new = list(zip(batch["t"].tolist(), batch["holds"].tolist(), batch["hold"].tolist()))
        self.waiting.appendList(new)
        self.handle.registerTimer(max(t for t, _, _ in new) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready = [x for x in held if x[0] <= passed]
        if len(ready) < len(held):
            self.waiting.put(held[len(ready):])
        else:
            self.waiting.clear()
        since, fired = self.run.get() if self.run.exists() else (None, False)
        out = []
        for t, holds, hold in ready:
            if not holds:
                since, fired = None, False
                continue
            since = t if since is None else since
            if not fired and t - since >= hold:
                fired = True
                out.append((key[0], key[1], since, since + hold))
        if since is None:
            self.run.clear()
        else:
            self.run.update((since, fired))
        yield pd.DataFrame(out, columns=["rule", "series", "pending", "firing"])

    def close(self) -> None:
        pass


def _judged(series: DataFrame, rules: DataFrame) -> DataFrame:
    return series.join(checked(rules), "rule").select(
        "rule",
        "series",
        "ts",
        F.unix_micros("ts").alias("t"),
        F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)).alias("holds"),
        (F.col("hold_seconds").cast("bigint") * MICROS).alias("hold"),
    )


def _as_alerts(fired: DataFrame) -> DataFrame:
    return fired.select(
        "rule",
        "series",
        F.timestamp_micros("pending").alias("pending_since"),
        F.timestamp_micros("firing").alias("firing_since"),
    )


def ordered_alert_stream(series: DataFrame, rules: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``alert_stream`` by event time: batches in any order within ``late`` give the batch result.

    An alert comes once the watermark has passed the evaluation that makes it fire. Rows without
    a rule of their own only move the watermark on.
    """
    judged = _judged(series.withWatermark("ts", late), rules)
    fired = judged.groupBy("rule", "series").transformWithStateInPandas(
        statefulProcessor=OrderedHoldProcessor(),
        outputStructType="rule string, series string, pending bigint, firing bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return _as_alerts(fired)


def alert_stream(series: DataFrame, rules: DataFrame) -> DataFrame:
    """A row when a series starts firing, for batches that come in the order of time."""
    fired = _judged(series, rules).groupBy("rule", "series").transformWithStateInPandas(
        statefulProcessor=HoldProcessor(),
        outputStructType="rule string, series string, pending bigint, firing bigint",
        outputMode="Append",
        timeMode="None",
    )
    return _as_alerts(fired)


def write_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return _start(df.writeStream.format("parquet").option("path", path), checkpoint, every)
