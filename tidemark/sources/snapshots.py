"""Tables of immutable files in versions: a manifest per version says which files it has.

A version is committed by creating its log entry, which succeeds for one writer only. Readers
pin a version and keep its files, whatever is appended, replaced or compacted meanwhile. The
manifest holds each file's part (a month or a date) and the least and greatest value of chosen
columns, so a lookup opens only the files whose ranges hold what is asked for.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.joins import is_small
from tidemark.sources import paths

#: Bits that each clustered column gives to a place on the curve.
CURVE_BITS = 6
#: Rows that the cuts of a column are taken from.
CURVE_SAMPLE = 20_000
#: Most tasks, and files, that one commit deals a part over.
DEALT = 16
#: Wanted keys that files are looked up for one by one.
PRUNE_KEYS = 1_000


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def curve_place(buckets: list[Column], bits: int = CURVE_BITS) -> Column:
    """Bits of all buckets interleaved, the highest first: near places are near in every column."""
    place = F.lit(0).cast("long")
    for bit in range(bits):
        for k, bucket in enumerate(buckets):
            one = F.shiftright(bucket, bit).bitwiseAND(F.lit(1)).cast("long")
            place = place + F.shiftleft(one, bit * len(buckets) + k)
    return place


def cuts_of(df: DataFrame, columns: list[str], bits: int = CURVE_BITS) -> dict[str, list]:
    """At most 2^bits - 1 values per column that cut its rows evenly, from one bounded sample."""
    sample = df.select(*columns, F.rand(7).alias("_r")).orderBy("_r").limit(CURVE_SAMPLE)
    held = sample.agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in columns])
    n = 1 << bits

    def firsts(c: str) -> Column:
        at = lambda k: F.floor(k * F.size(c) / n).cast("int")
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.get(c, at(k))))

    row = held.select(*[firsts(c).alias(c) for c in columns]).first()
    return {c: [v for v in row[c] if v is not None] for c in columns}


def along_curve(df: DataFrame, columns: list[str], bits: int = CURVE_BITS) -> DataFrame:
    """Rows with their ``_place`` on a space-filling curve over the columns, each cut into 2^bits ranges.

    The cuts at or below a value are counted by halving: a step of each column is a projection.
    """
    buckets = []
    for k, (c, cuts) in enumerate(cuts_of(df, columns, bits).items()):
        if not cuts:
            continue
        ordered = F.array(*[F.lit(v).cast(df.schema[c].dataType) for v in cuts])
        bucket = f"_bucket{k}"
        df = df.withColumn(bucket, F.lit(0))
        for step in [1 << b for b in reversed(range(bits))]:
            above = F.get(ordered, F.col(bucket) + (step - 1)) <= F.col(c)
            df = df.withColumn(bucket, F.col(bucket) + F.when(above, step).otherwise(0))
        buckets.append(bucket)
    return df.withColumn("_place", curve_place([F.col(b) for b in buckets], bits)).drop(*buckets)


@dataclass
class Snapshots:
    """The versions of one table under ``path``.

    ``part`` names the column that files are divided by, ``ranges`` those whose extremes the
    manifest holds, ``curve`` those that rows are clustered along. Without a curve each part is
    gathered in few files, a large one in up to ``DEALT`` a commit that are written side by side,
    and sorted by ``ranges``. ``slices`` is the
    number of ranges that rows of one commit are dealt over, if Spark is not to choose it.
    """

    spark: SparkSession
    path: str
    part: str
    ranges: list[str]
    curve: list[str] = field(default_factory=list)
    slices: int | None = None

    # ---- versions

    def versions(self) -> list[int]:
        names = paths.files(self.spark, f"{self.path}/log")
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def newest(self) -> int:
        """The newest version whose log entry is whole; 0 for a table without any."""
        for version in reversed(self.versions()):
            try:
                self._entry(version)
                return version
            except ValueError:  # just being written
                continue
        return 0

    def _log(self, version: int) -> str:
        return f"{self.path}/log/{version:010d}.json"

    def _entry(self, version: int) -> dict:
        return json.loads(paths.read_text(self.spark, self._log(version)))

    def schema(self, version: int | None = None) -> StructType:
        version = self.newest() if version is None else version
        return StructType.fromJson(self._entry(version)["schema"])

    def _manifest_schema(self, schema: StructType) -> str:
        ends = ", ".join(f"`{c}`: {schema[c].dataType.simpleString()}" for c in self.ranges)
        part = schema[self.part].dataType.simpleString()
        return f"file string, part {part}, rows long, bytes long, low struct<{ends}>, high struct<{ends}>"

    def manifest(self, version: int | None = None) -> DataFrame:
        """``file, part, rows, bytes, low, high`` of each file of a version."""
        version = self.newest() if version is None else version
        entry = self._entry(version)
        schema = StructType.fromJson(entry["schema"])
        folder = f"{self.path}/manifests/{entry['manifest']}"
        return self.spark.read.schema(self._manifest_schema(schema)).parquet(folder)

    # ---- reading

    def _open(self, files: list[str], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        held = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return held.parquet(*[f"{self.path}/data/{f}" for f in files]).select(*schema.names)

    def read(self, version: int | None = None, **between) -> DataFrame:
        """Rows of a version; ``column=(low, high)`` bounds rows and files, both ends included."""
        version = self.newest() if version is None else version
        held, rows = self.manifest(version), F.lit(True)
        for c, (low, high) in between.items():
            least, most = (F.col("part"),) * 2 if c == self.part else (F.col("low")[c], F.col("high")[c])
            if low is not None:
                held, rows = held.where(most >= F.lit(low)), rows & (F.col(c) >= F.lit(low))
            if high is not None:
                held, rows = held.where(least <= F.lit(high)), rows & (F.col(c) <= F.lit(high))
        files = [r["file"] for r in held.select("file").collect()]
        out = self._open(files, self.schema(version))
        return out.where(rows) if between else out

    def holding(self, wanted: DataFrame, column: str, version: int | None = None) -> DataFrame:
        """Rows of the files that can hold a wanted value of ``column``, an inner join away.

        Up to ``PRUNE_KEYS`` wanted values choose files by their ranges; beyond, nearly every
        file is wanted and all are opened.
        """
        version = self.newest() if version is None else version
        keys = wanted.select(F.col(column).alias("_k")).where(F.col(column).isNotNull()).distinct()
        held = self.manifest(version)
        if is_small(keys, PRUNE_KEYS):
            inside = (F.col("_k") >= F.col("low")[column]) & (F.col("_k") <= F.col("high")[column])
            held = held.join(F.broadcast(keys), inside, "left_semi")
        return self._open([r["file"] for r in held.select("file").collect()], self.schema(version))

    # ---- writing

    def _written(self, df: DataFrame) -> DataFrame:
        """Writes rows as new files and returns their part of a manifest."""
        commit = uuid.uuid4().hex
        if self.curve:
            dealt = along_curve(df, self.curve)
            slices = [self.slices] if self.slices else []
            dealt = dealt.repartitionByRange(*slices, self.part, "_place", *self.ranges)
            dealt = dealt.sortWithinPartitions(self.part, "_place", *self.ranges).drop("_place")
        else:
            share = F.pmod(F.xxhash64(*self.ranges[:1]), F.lit(DEALT))
            dealt = df.repartition(self.part, share).sortWithinPartitions(self.part, *self.ranges)
        folder = f"{self.path}/data/commit={commit}"
        dealt.write.partitionBy(self.part).parquet(folder)
        if not paths.folders(self.spark, folder):
            return self.spark.createDataFrame([], self._manifest_schema(df.schema))
        held = self.spark.read.schema(df.schema).option("basePath", f"{self.path}/data").parquet(folder)
        name = F.regexp_extract("_metadata.file_path", r"(commit=[^/]+/.*)$", 1)
        ends = [
            F.struct(*[f(c).alias(c) for c in self.ranges]).alias(side)
            for side, f in (("low", F.min), ("high", F.max))
        ]
        # The set of a file's one part lets Spark hash the files; extremes of texts alone would
        # have it sort all rows by file.
        files = held.groupBy("_metadata.file_path").agg(
            F.collect_set(self.part).alias("parts"),
            F.max("_metadata.file_size").alias("bytes"),
            F.max(name).alias("name"),
            F.count(F.lit(1)).alias("rows"),
            *ends,
        )
        return files.select(
            F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))).alias("file"),
            F.get("parts", F.lit(0)).alias("part"),
            "rows", "bytes", "low", "high",
        )

    def mark_of(self, writer: str) -> int:
        """The last mark that a writer's commits have; -1 for none."""
        newest = self.newest()
        return self._entry(newest).get("marks", {}).get(writer, -1) if newest else -1

    def done(self, mark: tuple[str, int]) -> bool:
        """Whether the newest version holds what a writer committed under this mark or a later one."""
        return self.mark_of(mark[0]) >= mark[1]

    def commit(self, add: DataFrame | None = None, gone: Column | None = None,
               base: int | None = None, mark: tuple[str, int] | None = None) -> int:
        """A new version: ``base`` without the files for which ``gone`` holds, and with ``add``.

        ``gone`` is a condition on the manifest. The version follows ``base`` (the newest);
        if another writer has committed that one, ``Conflict`` is raised and nothing changes
        for readers. Files of a failed commit are in no manifest and go with ``collect``.
        ``mark`` is a writer's name and a number that grows with its commits, as a stream's
        batches have: a commit whose mark is there already is done and is not repeated.
        """
        if mark and self.done(mark):
            return self.newest()
        base = self.newest() if base is None else base
        schema = add.schema if add is not None else self.schema(base)
        held = self.manifest(base) if base else None
        if held is not None and gone is not None:
            held = held.where(~F.coalesce(gone, F.lit(False)))
        return self._commit(base, held, add, schema, mark)

    def _commit(self, base: int, stays: DataFrame | None, add: DataFrame | None, schema,
                mark: tuple[str, int] | None = None) -> int:
        held = stays
        if add is not None:
            held = self._written(add) if held is None else held.unionByName(self._written(add))
        if held is None:
            held = self.spark.createDataFrame([], self._manifest_schema(schema))
        name = uuid.uuid4().hex
        held.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        marks = {**(self._entry(base).get("marks", {}) if base else {}), **dict([mark] if mark else [])}
        entry = {"manifest": name, "schema": schema.jsonValue(), "base": base, "marks": marks}
        if not paths.create_text(self.spark, self._log(base + 1), json.dumps(entry)):
            raise Conflict(f"version {base + 1} of {self.path} is there already")
        return base + 1

    def append(self, df: DataFrame, mark: tuple[str, int] | None = None) -> int:
        return self.commit(add=df, mark=mark)

    def replace(self, df: DataFrame, gone: Column) -> int:
        """Files for which ``gone`` holds make way for ``df`` in one step."""
        return self.commit(add=df, gone=gone)

    def compact(self, small: int = 128 << 20) -> int:
        """Rows of parts with several files below ``small`` bytes, clustered anew together.

        Only such files are read and replaced; returns the newest version, which is the old one
        where there is nothing to do.
        """
        base = self.newest()
        little = self.manifest(base).where(F.col("bytes") < small)
        parts = little.groupBy("part").count().where("count > 1").select("part")
        named = [r["file"] for r in little.join(parts, "part", "left_semi").collect()]
        if not named:
            return base
        listed = self.spark.createDataFrame([(f,) for f in named], "file string")
        stays = self.manifest(base).join(listed, "file", "left_anti")
        return self._commit(base, stays, self._open(named, self.schema(base)), self.schema(base))

    def collect(self, keep: int = 2, older_than: float = 3600.0) -> int:
        """Drops versions before the last ``keep`` and the files that no kept version names.

        Commits younger than ``older_than`` seconds stay, as one of them may be on its way.
        Returns the number of commit folders and single files that went.
        """
        kept = self.versions()[-keep:]
        names = None
        for v in kept:
            files = self.manifest(v).select("file")
            names = files if names is None else names.unionByName(files)
        live = {r["file"] for r in names.distinct().collect()} if names is not None else set()
        commits = {f.split("/", 1)[0] for f in live}
        edge, gone = time.time() - older_than, 0
        for name in paths.folders(self.spark, f"{self.path}/data"):
            folder = f"{self.path}/data/{name}"
            if paths.changed(self.spark, folder) > edge:
                continue
            if name not in commits:
                paths.drop_folder(self.spark, folder)
                gone += 1
                continue
            for file in paths.files_below(self.spark, folder):
                if file.endswith(".parquet") and f"{name}/{file}" not in live:
                    paths.drop_folder(self.spark, f"{folder}/{file}")
                    gone += 1
        for v in self.versions():
            if v not in kept:
                paths.drop_folder(self.spark, f"{self.path}/manifests/{self._entry(v)['manifest']}")
                paths.drop_folder(self.spark, self._log(v))
        return gone
