"""Rollups kept as partial aggregates that merge, so a refresh reads new readings only.

A day's readings are stored as counts per distinct value of each (device, day, type): sums,
squares, extremes and percentiles all follow from them and stay exact when merged. Hours keep
their sums. Devices are numbered once, and a day's devices are bitmaps of these numbers beside
a sketch; bitmaps of any days unite to the exact number of distinct devices of that period.
All tables are snapshots: a merge appends the partials of the new readings and reads nothing
old, readers keep their version meanwhile, and compacting folds what has gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import beside, checked, on_same
from tidemark.functions.numbers import from_units, power_sums, units
from tidemark.functions.percentiles import (
    SMALL_GROUP,
    interpolated,
    large_groups,
    percentiles_of_counts,
    rank_columns,
    ranks_of_counts,
)
from tidemark.operators.rollups import (
    DAILY_KEY,
    GLOBAL_KEY,
    HOURLY_KEY,
    PERCENTS,
    STAT_NAMES,
    daily_columns,
    decimal_type,
    finish,
)
from tidemark.session import written
from tidemark.sources.snapshots import Snapshots

#: Rows of value counts that one task orders.
TASK_ROWS = 250_000
#: log2 of a sketch's registers: its standard error is 1.04 / sqrt(2^SKETCH).
SKETCH = 12


def value_partials(df: DataFrame) -> DataFrame:
    """Readings as counts per value: ``(daily key), v, rows, first_reading, last_reading``.

    ``v`` is the value in units of its last place, null for readings without one.
    """
    _, scale = decimal_type(df)
    daily = df.withColumn("day", F.date_trunc("day", "ts"))
    return daily.groupBy(*DAILY_KEY, units(F.col("value"), scale).alias("v")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("first_reading"),
        F.max("ts").alias("last_reading"),
    )


def hour_partials(df: DataFrame) -> DataFrame:
    """Readings as sums per hour: ``(hourly key), n, s, ss, low, high, rows, first, last``."""
    _, scale = decimal_type(df)
    v = units(F.col("value"), scale)
    return df.groupBy("device_id", F.date_trunc("hour", "ts").alias("hour"), "reading_type").agg(
        *power_sums(v),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("first_reading"),
        F.max("ts").alias("last_reading"),
    )


MERGED = {
    "rows": F.sum, "n": F.sum, "s": F.sum, "ss": F.sum, "low": F.min, "high": F.max,
    "first_reading": F.min, "last_reading": F.max,
}


def merge(partials: DataFrame, keys: list[str], by: list | None = None) -> DataFrame:
    """Partials of the same keys, or of a coarser key, as one; dealt by ``by`` if given.

    A number before the columns in ``by`` is that of the tasks.

    Rows dealt by a part of the keys need no second exchange for whatever groups by that part.
    """
    kinds = {f.name: f.dataType for f in partials.schema}
    if by:
        partials = partials.repartition(*by)
    return partials.groupBy(*keys).agg(
        *[f(c).cast(kinds[c]).alias(c) for c, f in MERGED.items() if c in kinds and c not in keys]
    )


def _sums_of_values() -> list:
    v, k = F.col("v").cast("decimal(19,0)"), F.col("rows").cast("decimal(19,0)")
    small = (F.abs("v") < 1 << 26) & (F.col("rows") < 1 << 10)  # then v * v * rows is a long
    low, high = F.lit((1 << 32) - 1).cast("bigint"), F.lit(1 << 32).cast("decimal(10,0)")
    total, squares = F.col("v") * F.col("rows"), F.col("v") * F.col("v") * F.col("rows")

    def whole(product, wide):
        """Sums of the upper and lower halves of long products, and of the wide ones apart."""
        upper = F.sum(F.when(small, F.shiftright(product, 32)))
        lower = F.sum(F.when(small, product.bitwiseAND(low)))
        halves = upper.cast("decimal(19,0)") * high + lower.cast("decimal(19,0)")
        apart = F.sum(F.when(~small, wide))
        both = F.coalesce(halves, F.lit(0)) + F.coalesce(apart, F.lit(0))
        return F.when(F.coalesce(upper, apart).isNotNull(), both.cast("decimal(38,0)"))

    return [
        F.sum(F.when(F.col("v").isNotNull(), F.col("rows")).otherwise(0)).alias("n"),
        whole(total, (v * k).cast("decimal(28,0)")).alias("s"),
        whole(squares, (v * v * k).cast("decimal(38,0)")).alias("ss"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.sum("rows").alias("_rows"),
        F.min("first_reading").alias("first_reading"),
        F.max("last_reading").alias("last_reading"),
    ]


def _rounded(sums, keys: list[str], names, kept: list[str], precision: int, scale: int) -> DataFrame:
    rows = "_rows" if "_rows" in sums.columns else "rows"
    value = lambda c: from_units(F.col(c), scale).cast(f"decimal({precision},{scale})")
    sums = sums.withColumnsRenamed({rows: "_rows"}).withColumns(
        {"_min": value("low"), "_max": value("high")}
    )
    return finish(sums, keys, names, kept, scale)


def hourly_of(partials: DataFrame, precision: int, scale: int) -> DataFrame:
    """The hourly rollup of merged hour partials."""
    return _rounded(partials, HOURLY_KEY, STAT_NAMES, [], precision, scale)


def daily_of(counted: DataFrame, precision: int, scale: int, large_rows: int = SMALL_GROUP) -> DataFrame:
    """The daily rollup of value counts, merged here if need be: one exchange on the daily key.

    Groups with more than ``large_rows`` distinct values never meet in one task: their ranks
    are located by value ranges and their sums folded before the shuffle.
    """
    pair = ["day", "reading_type"]  # few, so that looking for a large group shuffles little
    large = large_groups(counted, pair, large_rows)
    if large.isEmpty():
        return _daily_of_small(counted, precision, scale)
    large = large_groups(on_same(counted, checked(large), pair, "left_semi"), DAILY_KEY, large_rows)
    if large.isEmpty():
        return _daily_of_small(counted, precision, scale)
    small = _daily_of_small(on_same(counted, checked(large), DAILY_KEY, "left_anti"), precision, scale)
    held = on_same(counted, checked(large), DAILY_KEY, "left_semi")
    held = merge(held, [*DAILY_KEY, "v"])
    ranks = held.where("v is not null").select(*DAILY_KEY, F.col("v").alias("_v"), F.col("rows").alias("_n"))
    ranks = percentiles_of_counts(ranks, DAILY_KEY, list(PERCENTS), precision)
    stats = held.groupBy(*DAILY_KEY).agg(*_sums_of_values())
    stats = _rounded(stats, DAILY_KEY, STAT_NAMES, [], precision, scale)
    return small.unionByName(daily_columns(on_same(stats, ranks, DAILY_KEY, "left"), scale))


def _daily_of_small(counted: DataFrame, precision: int, scale: int) -> DataFrame:
    """Dealt over as many tasks as the rows need, so that a task's memory does not grow with them.

    Two at least: with one, Spark gathers the rows instead of dealing them by the key.
    """
    tasks = max(2, counted.count() // TASK_ROWS + 1)
    merged = merge(counted, [*DAILY_KEY, "v"], by=[tasks, *DAILY_KEY])
    placed = ranks_of_counts(merged, DAILY_KEY, F.col("v"), F.col("rows"), list(PERCENTS))
    sums = placed.groupBy(*DAILY_KEY).agg(
        *_sums_of_values(), *[F.max(c).alias(c) for c in rank_columns(len(PERCENTS))]
    )
    sums = sums.select("*", *interpolated(list(PERCENTS)))
    kept = [f"p{p}_x100" for p in PERCENTS]
    return daily_columns(_rounded(sums, DAILY_KEY, STAT_NAMES, kept, precision, scale), scale)


GLOBAL_NAMES = ("total_readings", "global_avg", "global_min", "global_max", "global_stddev")


def global_of(partials: DataFrame, devices: DataFrame, precision: int, scale: int) -> DataFrame:
    """The global rollup of hour partials and of the types' distinct devices."""
    merged = merge(partials, GLOBAL_KEY)
    held = on_same(merged, devices, GLOBAL_KEY, "left").withColumn(
        "active_devices", F.coalesce("active_devices", F.lit(0))
    )
    return _rounded(held, GLOBAL_KEY, GLOBAL_NAMES, ["active_devices"], precision, scale)


def number_devices(devices: DataFrame, known: DataFrame | None) -> DataFrame:
    """``device_id, number`` of devices that have none yet; numbers are unique, from 1 on.

    New devices are counted per partition behind the greatest number so far, written once, so
    numbers are fixed; a partition's numbers are consecutive and bitmaps of them stay dense.
    """
    new = devices.select("device_id").where("device_id is not null").distinct()
    last = None
    if known is not None:
        new = new.join(known, "device_id", "left_anti")
        last = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"))
    spark = devices.sparkSession
    last = last if last is not None else spark.range(1).select(F.lit(0).cast("long").alias("last"))
    dealt = written(new.withColumn("at", F.monotonically_increasing_id()), "new-devices")
    part = F.shiftright("at", 33)
    spans = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    before = F.sum("c").over(Window.orderBy("part")) - F.col("c")  # one row a partition
    spans = beside(spans.select("part", "first", before.alias("before")), last)
    numbered = dealt.withColumn("part", part).join(checked(spans), "part")
    return numbered.select(
        "device_id", (F.col("last") + F.col("before") + F.col("at") - F.col("first") + 1).alias("number")
    )


def device_days(df: DataFrame, numbers: DataFrame) -> DataFrame:
    """``day, reading_type, bucket, bits, sketch`` of the devices that read on each day.

    A bucket is a bitmap of 32,768 device numbers; the sketch is of the bucket's devices.
    """
    seen = df.select(F.to_date("ts").alias("day"), "reading_type", "device_id").distinct()
    held = seen.join(numbers, "device_id")
    return held.groupBy(
        "day", "reading_type", F.bitmap_bucket_number("number").alias("bucket")
    ).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"),
        F.hll_sketch_agg("number", SKETCH).alias("sketch"),
    )


def unite_days(days: DataFrame, keys: list[str]) -> DataFrame:
    return days.groupBy(*keys).agg(
        F.bitmap_or_agg("bits").alias("bits"), F.hll_union_agg("sketch").alias("sketch")
    )


def distinct_devices(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``active_devices`` of the days given, exact, per ``keys``: bitmaps unite, then count."""
    keys = keys or []
    united = days.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    counted = united.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("active_devices"))
    return counted.withColumn("active_devices", F.coalesce("active_devices", F.lit(0)))


def estimated_devices(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``estimated_devices`` per ``keys`` by uniting sketches."""
    united = days.groupBy(*(keys or [])).agg(F.hll_union_agg("sketch").alias("sketch"))
    estimate = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))
    return united.select(*(keys or []), estimate.alias("estimated_devices"))


@dataclass
class PartialStore:
    """The partial tables of one readings table under ``base``."""

    spark: SparkSession
    base: str
    precision: int = 15
    scale: int = 2

    def __post_init__(self):
        table = lambda name, part, *ranges: Snapshots(
            self.spark, f"{self.base}/{name}", part, list(ranges)
        )
        self.values = table("values", "month", "day", "device_id")
        self.hours = table("hours", "month", "hour", "device_id", "last_reading")
        self.days = table("device-days", "month", "day")
        self.devices = table("devices", "lot", "device_id")

    def merge(self, new: DataFrame, tables: tuple[str, ...] = ("values", "hours", "devices"),
              mark: tuple[str, int] | None = None) -> None:
        """Takes in readings that the tables have not seen: only these are read.

        Each table gets the partials of the new readings appended; of what is stored only the
        device numbers are read, to number devices that are new. ``tables`` names what a store
        keeps, if not everything. Under a ``mark`` (see ``Snapshots.commit``) a merge that was
        cut off can be repeated: tables that have it already take it no second time.
        """
        month = lambda df, c: df.withColumn("month", F.trunc(c, "month"))
        if "values" in tables:
            self.values.append(month(value_partials(new), "day"), mark)
        if "hours" in tables:
            self.hours.append(month(hour_partials(new), "hour"), mark)
        if "devices" in tables:
            self._merge_devices(new, month, mark)

    def _merge_devices(self, new: DataFrame, month, mark) -> None:
        if mark and self.days.done(mark):
            return
        known = self.devices.read() if self.devices.newest() else None
        fresh = written(number_devices(new, known), "numbered-devices")
        numbers = fresh if known is None else known.drop("lot").unionByName(fresh)
        # numbers first: days without them would name devices that nobody knows
        self.devices.append(fresh.withColumn("lot", F.lit(self.devices.newest() + 1)))
        self.days.append(month(device_days(new, numbers), "day"), mark)

    def marks(self, writer: str) -> int:
        """The last mark that every table kept here has of a writer; -1 for none."""
        kept = [t for t in (self.values, self.hours, self.days) if t.newest()]
        return min((t.mark_of(writer) for t in kept), default=-1)

    def compact(self) -> None:
        """Folds the partials that merges have appended into one row a key, month by month."""
        for table, keys in ((self.values, [*DAILY_KEY, "v"]), (self.hours, HOURLY_KEY)):
            if not table.newest():
                continue
            several = table.manifest().groupBy("part").count().where("count > 1")
            parts = [r["part"] for r in several.collect()]  # a row a month
            if parts:
                held = table.read().where(F.col("month").isin(parts))
                table.replace(merge(held, [*keys, "month"]).select(*held.columns), F.col("part").isin(parts))
        if not self.days.newest():
            return
        several = self.days.manifest().groupBy("part").count().where("count > 1")
        parts = [r["part"] for r in several.collect()]
        if parts:
            held = self.days.read().where(F.col("month").isin(parts))
            united = unite_days(held, ["day", "reading_type", "bucket", "month"])
            self.days.replace(united.select(*held.columns), F.col("part").isin(parts))

    def hourly(self, first=None, last=None) -> DataFrame:
        """The hourly rollup of all hours, or of those from ``first`` to ``last``."""
        held = self.hours.read(hour=(first, last)) if first or last else self.hours.read()
        return hourly_of(merge(held, HOURLY_KEY), self.precision, self.scale)

    def daily(self, first=None, last=None) -> DataFrame:
        """The daily rollup of all days, or of those from ``first`` to ``last``."""
        held = self.values.read(day=(first, last)) if first or last else self.values.read()
        return daily_of(held, self.precision, self.scale)

    def overall(self) -> DataFrame:
        devices = distinct_devices(self.days.read(), GLOBAL_KEY)
        return global_of(self.hours.read(), devices, self.precision, self.scale)

    def distinct_devices(self, first=None, last=None) -> DataFrame:
        """One row: the exact number of devices that read from day ``first`` to ``last``."""
        return distinct_devices(self.days.read(day=(first, last)))
