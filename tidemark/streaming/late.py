"""Continuous rollups by merging partials, with late rows set aside and merged by a correction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.joins import beside
from tidemark.plans.partials import PartialStore
from tidemark.session import written
from tidemark.sources.snapshots import Snapshots
from tidemark.spec import READING_COLUMNS
from tidemark.streaming.rollups import _start

STREAM, CORRECTION = "stream", "correction"
KEPT = ("values", "hours")


def late_table(spark: SparkSession, path: str) -> Snapshots:
    """Rows that came behind the watermark, in lots, one a batch."""
    return Snapshots(spark, path, "lot", ["ts"])


def continuous_partials(
    readings: DataFrame,
    store: PartialStore,
    late: Snapshots,
    checkpoint: str,
    late_days: int = 7,
    every: str | None = None,
    source: str = STREAM,
) -> StreamingQuery:
    """Merges each batch's partials into the store and sets its late rows aside.

    The watermark of a batch is the newest reading of the batches before it, less the allowed
    lateness. A row is late when its hour had ended by then: whoever took the rollup of that
    hour as final is not surprised by it, and nothing is dropped. A batch reads itself and one
    number of the store, never what is stored; percentiles stay exact, because days are kept as
    counts per value. Each table takes a batch once, also when the batch is repeated; ``source``
    tells the batches of several streams into one store apart.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        mark = (source, batch_id)
        if store.values.done(mark) and store.hours.done(mark) and late.done(mark):
            return
        edge = watermark(batch.sparkSession, store, late_days)
        closed = F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR") <= F.col("edge")
        marked = beside(batch.select(*READING_COLUMNS), edge)
        marked = marked.withColumn("late", F.coalesce(closed, F.lit(False))).drop("edge")
        rows = written(marked, "batch")
        behind = rows.where("late").drop("late").withColumn("lot", F.lit(late.newest() + 1))
        late.append(behind, mark)
        # hours last: they hold the watermark, which a repeated batch must find as it was
        store.merge(rows.where("not late").drop("late"), KEPT, mark)

    return _start(readings.writeStream.foreachBatch(absorb), checkpoint, every)


def watermark(spark: SparkSession, store: PartialStore, late_days: int) -> DataFrame:
    """One row, ``edge``: null before anything is stored."""
    if not store.hours.newest():
        return spark.range(1).select(F.lit(None).cast("timestamp").alias("edge"))
    newest = store.hours.manifest().agg(F.max("high.last_reading").alias("newest"))
    return newest.select((F.col("newest") - F.make_dt_interval(F.lit(late_days))).alias("edge"))


def correct(store: PartialStore, late: Snapshots) -> int:
    """Merges all late rows that no correction has merged; returns up to which lot that is.

    Partials add up, so corrected hours and days equal those of all rows in order.
    """
    if not late.newest():
        return -1
    upto = late.manifest().agg(F.max("part")).first()[0]
    if upto is None:
        return -1
    done = store.marks(CORRECTION)
    if upto > done:
        rows = late.read(lot=(done + 1, upto))
        store.merge(rows.select(*READING_COLUMNS), KEPT, (CORRECTION, upto))
    return upto
