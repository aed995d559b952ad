"""What several operators need: code on executors, bundles of documents, packed key sets."""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.paths import drop_folder

PACKAGE = Path(__file__).resolve().parents[1]

BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: A worker that holds more than this after a batch or a group gives back what is free.
SETTLE_BYTES = 160 << 20
BUNDLE_BYTES = 4 << 20


def attach(spark: SparkSession) -> None:
    """Give executors this package, and keep Arrow batches of long texts small."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        spark.conf.set(key, str(most))
    context = spark.sparkContext
    if getattr(context, "_tidemark_attached", False):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tidemark-code-")), "tidemark.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, Path(PACKAGE.name, file.relative_to(PACKAGE)))
    context.addPyFile(path)
    context._tidemark_attached = True


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only; other columns, whatever their names, stay out of the work."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def ascii_lower(text):
    """A-Z lower-cased and nothing else; Spark's own function also changes other letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads: what came of them is written itself."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_folder(df.sparkSession, folder)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def parts_for(total_bytes: int, each: int, least: int) -> int:
    """How many parts of about ``each`` bytes; grows with the data without a limit."""
    return max(least, ceil_div(int(total_bytes), each))


def new_id(number: int) -> int:
    """An id unique over all tasks of a job; fixed once its table is written."""
    return (TaskContext.get().partitionId() << 32) | number


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _resident() -> int:
    try:
        with open("/proc/self/statm") as own:
            return int(own.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:
        return 0


def settle() -> None:
    """Gives memory of finished work back to the machine, once a worker holds much of it.

    Workers live on from stage to stage, and freed arrays stay with a process unless asked for.
    """
    if _resident() > SETTLE_BYTES:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library keeps its own habits


def settled(work):
    """A function over batches, or over one group, that settles after each of them."""

    if inspect.isgeneratorfunction(work):

        @functools.wraps(work)
        def over(batches):
            def passed():
                for batch in batches:
                    yield batch
                    settle()

            yield from work(passed())
            settle()

        return over

    def one(table):
        try:
            return work(table)
        finally:
            settle()

    def two(left, right):  # Spark counts the arguments
        try:
            return work(left, right)
        finally:
            settle()

    return one if len(inspect.signature(work).parameters) == 1 else two


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many ``_`` before them as no column of ``df`` has, in any case."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(words: np.ndarray, length: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of the ``length`` words from each position on, built by doubling shorter windows.

    Entry i covers words[i : i + length]; there are len(words) - length + 1 entries.
    """
    if len(words) < length:
        return np.empty(0, np.uint64)
    total, covered = np.zeros(len(words) - length + 1, np.uint64), 0
    power, span, step = words, 1, factor
    left = length
    while left:
        if left & 1:
            scale = np.uint64(pow(factor, covered, 1 << 64))
            total += power[covered : covered + len(total)] * scale
            covered += span
        left >>= 1
        if left:
            power = power[: len(power) - span] + power[span:] * np.uint64(step)
            step = step * step % (1 << 64)
            span *= 2
    return mix(total)


def ranges(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The hash ranges, of ``parts`` equal ones, that sorted 64-bit keys fall into.

    A key's range is its product with ``parts`` without the lower 64 bits, taken in two halves,
    so the work follows the keys and not the number of ranges. ``parts`` is below 2^31.
    """
    if not len(keys):
        return
    half, many = np.uint64(32), np.uint64(parts)
    low = ((keys & np.uint64(0xFFFFFFFF)) * many) >> half
    part = (((keys >> half) * many + low) >> half).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    for start, end in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
        yield int(part[start]), slice(start, end)


def pack(values: np.ndarray) -> bytes:
    """Numbers of one width, byte plane after byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


BUNDLE_DDL = "bundle long, doc_id array<long>, size array<long>, body binary, rest binary"
TYPES = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "string": pa.string(),
    "array<long>": pa.list_(pa.int64()),
}


def record(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """Rows as Arrow, typed by a DDL string of the types above."""
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, TYPES[kind]) for c, (_, kind) in zip(columns, fields)],
        names=[name for name, _ in fields],
    )


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, sizes, parts, rest, held, number = [], [], [], [], 0, 0

    def row():
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
        other = None
        press = zstandard.ZstdCompressor(level=1).compress
        if rest and rest[0].num_columns:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest[0].schema) as out:
                for x in rest:
                    out.write_batch(x)
            other = press(sink.getvalue().to_pybytes())
        return record([(new_id(number), ids, sizes, body, other)], BUNDLE_DDL)

    for batch in batches:
        others, start = batch.select(range(2, batch.num_columns)), 0
        for i, (doc_id, text) in enumerate(zip(batch.column(0), batch.column(1))):
            raw = text.as_py().encode() if text.is_valid else b""
            ids.append(doc_id.as_py())
            sizes.append(len(raw))
            parts.append(raw)
            held += len(raw) + 64
            if held >= BUNDLE_BYTES:
                rest.append(others.slice(start, i + 1 - start))
                yield row()
                ids, sizes, parts, rest, held, number = [], [], [], [], 0, number + 1
                start = i + 1
        if start < batch.num_rows:
            rest.append(others.slice(start))
    if ids:
        yield row()


def bundles(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """Documents as they lie in the input, some megabytes of text to a compressed row; no shuffle.

    Null text becomes empty text. ``whole_rows`` packs every other column beside it, and in
    place of the text whether it was null. The ids of bundles are fixed only once the result is
    written.
    """
    attach(docs.sparkSession)
    names = fresh(docs, "doc", "text")
    held = [F.col(c).cast(k).alias(n) for c, k, n in zip(("doc_id", "text"), ("long", "string"), names)]
    rest = [F.col(c).isNull().alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return docs.select(*held, *(rest if whole_rows else [])).mapInArrow(settled(_bundles), BUNDLE_DDL)


def bundle_rest(rest: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest)).read_all()


def bundle_texts(size: list[int], body: bytes) -> Iterator[bytes]:
    raw, at = zstandard.ZstdDecompressor().decompress(body), 0
    for n in size:
        yield raw[at : at + n]
        at += n


def bytes_of(bundled: DataFrame) -> int:
    """Bytes of all texts in written bundles."""
    sized = F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x)
    return bundled.agg(F.sum(sized)).first()[0] or 0
