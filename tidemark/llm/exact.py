"""Exact dedup by polynomial fingerprints that combine over chunks, checked byte by byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import attach, fresh, new_id, settled, texts
from tidemark.session import written

# Four primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (911382323, 972663749, 1000000007, 1234567891)

CHUNK = 4096
COMPARE = 1 << 16


def _powers(base: int, prime: int) -> list[int]:
    out = [1]
    for _ in range(CHUNK):
        out.append(out[-1] * base % prime)
    return out


POWERS = [_powers(b, p) for b, p in zip(BASES, PRIMES)]
#: Weight of each place in a whole chunk, the last place first in power.
WEIGHTS = np.array([row[CHUNK - 1 :: -1] for row in POWERS], dtype=np.float64).T


def chunk_hash(data: bytes) -> tuple[int, ...]:
    """Fingerprint of at most one chunk. Sums stay below 2^51, so doubles hold them exactly."""
    values = np.frombuffer(data, np.uint8).astype(np.float64) + 1.0
    sums = values @ WEIGHTS[CHUNK - len(data) :] if data else np.zeros(len(PRIMES))
    return tuple(int(s) % p for s, p in zip(sums, PRIMES))


def combine(left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
    """Fingerprint of a text from those of its two parts: the left one shifted by the right length."""
    return tuple(
        (a * pow(base, right_length, p) + b) % p
        for a, b, base, p in zip(left, right, BASES, PRIMES)
    )


def fingerprint(data: bytes) -> tuple[int, ...]:
    """Chunk hashes, all whole chunks at once, combined from left to right."""
    whole = len(data) // CHUNK
    state = (0,) * len(PRIMES)
    for at in range(0, whole, 256):
        rows = min(256, whole - at)
        block = np.frombuffer(data, np.uint8, rows * CHUNK, at * CHUNK).reshape(rows, CHUNK)
        for sums in ((block.astype(np.float64) + 1.0) @ WEIGHTS).tolist():
            state = tuple(
                (a * row[CHUNK] + int(s)) % p
                for a, s, row, p in zip(state, sums, POWERS, PRIMES)
            )
    rest = data[whole * CHUNK :]
    return combine(state, chunk_hash(rest), len(rest)) if rest else state


def _print_bytes(state: tuple[int, ...], length: int) -> bytes:
    return np.array([*state, length], dtype="<u8").tobytes()


MARK = "doc_id long, row long, print binary, length long, text_sha256 string"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = 0
    for batch in batches:
        prints, lengths, digests = [], [], []
        for text in batch.column(1):
            raw = text.as_py().encode() if text.is_valid else b""
            prints.append(_print_bytes(fingerprint(raw), len(raw)))
            lengths.append(len(raw))
            digests.append(hashlib.sha256(raw).hexdigest())
        rows = [new_id(number + i) for i in range(len(prints))]
        number += len(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.int64()), pa.array(prints, pa.binary()),
             pa.array(lengths, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "row", "print", "length", "text_sha256"],
        )


def _unequal(docs: DataFrame, marks: DataFrame, repeated: DataFrame) -> DataFrame:
    """Fingerprints whose texts are not all the same, found by comparing chunk after chunk.

    Each chunk place of a group folds to its least and greatest bytes before the shuffle, so
    a group of any size leaves one row a task and place.
    """
    wanted = (
        marks.where("length > 0")
        .join(repeated, "print", "left_semi")
        .select(F.col("doc_id").alias("id"), "print", "length")
        .distinct()
    )
    raw = texts(docs).select("doc_id", F.encode("text", "utf-8").alias("raw"))
    # An id may stand on rows of several texts: a row belongs to the prints of its length.
    here = F.col("doc_id").eqNullSafe(F.col("id")) & (F.length("raw") == F.col("length"))
    places = F.sequence(F.lit(0), F.floor((F.length("raw") - 1) / COMPARE).cast("int"))
    chunks = (
        raw.join(wanted, here)
        .select("print", "raw", F.explode(places).alias("place"))
        .select(
            "print",
            "place",
            F.expr(f"substring(raw, place * {COMPARE} + 1, {COMPARE})").alias("chunk"),
        )
    )
    ends = chunks.groupBy("print", "place").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    return ends.where(F.col("a") != F.col("b")).select("print").distinct()


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal texts (byte for byte, nothing normalised) form a group; the row with the largest
    doc_id stays. Null text counts as empty. A null doc_id stays only if no row of its group
    has an id. Of rows that repeat both doc_id and text one is kept. Groups are found by the
    fingerprint and length and proven by a chunkwise comparison; where a comparison fails, the
    digest of the whole text tells the texts of one fingerprint apart.
    """
    spark = docs.sparkSession
    attach(spark)
    marks = written(texts(docs).mapInArrow(settled(_marks), MARK), "exact-marks")
    repeated = marks.groupBy("print").count().where("count > 1").select("print")
    unequal = _unequal(docs, marks, repeated).withColumn("apart", F.lit(True))
    split = marks.join(unequal, "print", "left").withColumn(
        "apart", F.when(F.col("apart"), F.col("text_sha256")).otherwise(F.lit(""))
    )
    groups = split.groupBy("print", "apart").agg(
        F.max(F.struct(F.col("doc_id"), F.col("row"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    return split.join(groups, ["print", "apart"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one stays."""
    kept = exact_duplicates(docs).where("kept")
    own = fresh(docs, "id", "sha")

    def marks(doc_id, digest):
        """A doc_id of none and one of -1 are told apart by the text's digest."""
        named = F.when(doc_id.isNull(), F.concat(F.lit("-"), digest)).otherwise(digest)
        return [F.coalesce(doc_id, F.lit(-1)).alias(own[0]), named.alias(own[1])]

    kept = kept.select(*marks(F.col("doc_id"), F.col("text_sha256")))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    marked = docs.select("*", *marks(F.col("doc_id").cast("long"), digest))
    return marked.join(kept, own, "left_semi").dropDuplicates(own).drop(*own)
