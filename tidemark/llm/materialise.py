"""Token sequences in training order: a keyed permutation gives every sequence its place.

Before a text is tokenised its bytes already bound how many sequences it can become, so every
possible sequence has a number. A Feistel network over the next even number of bits, walked until
it lands inside, permutes exactly these numbers: each sequence gets its place in the training order
where it is, the only pass over the texts tokenises and writes, and no shuffle table exists. Ranges
of places are shards. Within a shard records lie in order and have one length; a table of the
shards' sizes turns places into gapless slots, and record k of a shard whose first slot is f is
slot f + k, at byte k * stride. Reading is front to back and can go on from any slot.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import checked
from tidemark.llm import shared as S
from tidemark.llm.tokens import encoder, vocabulary
from tidemark.session import shared_folder, written

LENGTH = 256
SHARD = 1 << 15
KEY = 20240501
END = 49407
PAD = 65535
NO_DOC = -(1 << 63)
HEADER = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("length", "<i4")])
ROUNDS = 6
#: Composition makes a text at most three times as long, lower case half as much again; a token has a byte.
MOST_PER_BYTE = 5
#: Shards summed up together when slots are counted.
BLOCK = 4096


class Permutation:
    """Feistel permutation of 0 .. size - 1 under a key, by cycle-walking."""

    def __init__(self, size: int, key: int):
        self.size = size
        self.half = max(1, ((max(size - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [
            np.uint64(xxhash.xxh3_64_intdigest(f"{key}:{r}")) for r in range(ROUNDS)
        ]

    def _once(self, x: np.ndarray, keys, back: bool) -> np.ndarray:
        bits = np.uint64(self.half)
        left, right = x >> bits, x & self.mask
        for key in keys:
            if back:
                left, right = right ^ (S.mix(left + key) & self.mask), left
            else:
                left, right = right, left ^ (S.mix(right + key) & self.mask)
        return (left << bits) | right

    def _walk(self, numbers, back: bool) -> np.ndarray:
        x = np.asarray(numbers, np.uint64).copy()
        keys = self.keys[::-1] if back else self.keys
        todo = np.arange(len(x))
        while len(todo):
            x[todo] = self._once(x[todo], keys, back)
            todo = todo[x[todo] >= np.uint64(self.size)]
        return x.astype(np.int64)

    def slots(self, numbers) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots) -> np.ndarray:
        return self._walk(slots, True)


def _format(length: int) -> np.dtype:
    return np.dtype([("head", HEADER), ("ids", "<u2", length), ("end", "S1")])


def stride_of(length: int) -> int:
    """Bytes of a record: its header, its ids, and one line feed."""
    return _format(length).itemsize


def _records(doc_ids: list, texts: list[bytes], own, length: int) -> np.ndarray:
    """The records of whole documents: ids and the end id, cut at ``length`` and filled up."""
    ids = own.encode(texts)
    sizes = np.array([len(x) + 1 for x in ids], np.int64)
    pieces = -(-sizes // length)
    ends = np.cumsum(pieces)
    flat = np.full(int(ends[-1]) * length, PAD, "<u2")
    for found, start in zip(ids, ((ends - pieces) * length).tolist()):
        flat[start : start + len(found)] = found
        flat[start + len(found)] = END
    out = np.zeros(int(ends[-1]), _format(length))
    named = np.array([NO_DOC if d is None else d for d in doc_ids], np.int64)
    piece = np.arange(len(out)) - np.repeat(ends - pieces, pieces)
    out["head"]["doc_id"] = np.repeat(named, pieces)
    out["head"]["piece"] = piece
    out["head"]["length"] = np.minimum(np.repeat(sizes, pieces) - piece * length, length)
    out["ids"] = flat.reshape(-1, length)
    return out


RECORD_DDL = "place long, shard long, record binary"


def _as_arrow(places: np.ndarray, width: int, records: np.ndarray) -> pa.RecordBatch:
    """Records without their line feed, which the writer of lines adds."""
    size = records.itemsize - 1
    raw = np.ascontiguousarray(records.view(np.uint8).reshape(len(records), -1)[:, :size])
    offsets = np.arange(len(records) + 1, dtype=np.int32) * np.int32(size)
    rows = pa.Array.from_buffers(
        pa.binary(), len(records), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(places), pa.array(places // width), rows], names=["place", "shard", "record"]
    )


def _place(path: str | None, length: int, firsts, total: int, width: int, key: int):
    def run(batches):
        own = encoder(path or vocabulary("word_bpe_49k.json"))
        order, part = Permutation(total, key), TaskContext.get().partitionId()
        number, most = firsts.value.get(part, (0, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            records = _records(batch.column(0).to_pylist(), texts, own, length)
            numbers = np.arange(number, number + len(records))
            number += len(records)
            if number > most:
                raise ValueError(f"partition {part} has more sequences than it was counted to allow")
            places = order.slots(numbers)
            for k in range(0, len(records), 2000):
                yield _as_arrow(places[k : k + 2000], width, records[k : k + 2000])

    return run


def _allowed(length: int, per_byte: int):
    """Sequences a text has at so many tokens a byte, and the end id."""
    return F.expr(f"(coalesce(octet_length(text), 0L) * {per_byte} + {length}) div {length}")


SHARDS_DDL = "shard long, records long, first long"


def _count_slots(spark: SparkSession, folder: str, length: int) -> None:
    """Writes how many records each shard has and which slot is its first.

    Sizes come from the files' lengths. Shards are summed in blocks, and only the blocks, one
    for some hundred million sequences, are ordered in one place.
    """
    files = spark.read.format("binaryFile").load(f"{folder}/shards")
    sizes = files.groupBy(F.col("shard").cast("long").alias("shard")).agg(
        (F.sum("length") / stride_of(length)).cast("long").alias("records")
    ).withColumn("block", F.floor(F.col("shard") / BLOCK))

    def earlier(ordered):
        return F.sum("records").over(ordered) - F.col("records")

    blocks = sizes.groupBy("block").agg(F.sum("records").alias("records"))
    blocks = blocks.select("block", earlier(Window.orderBy("block")).alias("before"))
    within = earlier(Window.partitionBy("block").orderBy("shard"))
    sizes.withColumn("within", within).join(blocks, "block").select(
        "shard", "records", (F.col("before") + F.col("within")).alias("first")
    ).write.parquet(f"{folder}/slots")


def materialise(docs: DataFrame, folder: str | None = None, length: int = LENGTH,
                per_shard: int = SHARD, key: int = KEY, path: str | None = None):
    """Writes the shards; returns the folder and the number of sequences.

    Each document's ids and the end id are cut into sequences of at most ``length``; shorter
    ones are filled with 65535. Null text gives the end id alone, rows that repeat are
    sequences of their own, and an empty table writes no record. Shards have about as many
    records as each other, and not above ``per_shard`` where a token has a byte or more on
    average. Before, the bytes of the texts are summed per input partition, as numbering always
    needs; the sums are two numbers a partition and go to all tasks. Both passes must see the
    same partitions: a table's files are split the same way twice, and anything that is shuffled
    is written first. A partition never numbers beyond its own range, so places cannot clash.
    """
    spark = docs.sparkSession
    S.attach(spark)
    rows = S.texts(docs)
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = written(rows, "numbered-texts")
    sums = rows.groupBy(F.spark_partition_id().alias("part")).agg(
        F.sum(_allowed(length, MOST_PER_BYTE)).cast("long").alias("most"),
        F.sum(_allowed(length, 1)).cast("long").alias("likely"),
    ).collect()
    firsts, total = {}, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        firsts[r["part"]] = (total, total + r["most"])
        total += r["most"]
    folder = folder or shared_folder(spark, "training-order")
    shards = max(1, S.ceil_div(sum(r["likely"] for r in sums), per_shard))
    width = max(1, S.ceil_div(total, shards))
    shipped = spark.sparkContext.broadcast(firsts)
    place = S.settled(_place(path, length, shipped, total, width, key))
    placed = rows.mapInArrow(place, RECORD_DDL)
    dealt = placed.repartition(max(shards, 12), "shard").sortWithinPartitions("shard", "place")
    # raw bytes pass through a text file unchanged, and each record ends in one line feed
    lines = dealt.select(F.col("record").cast("string").alias("value"), "shard")
    lines.write.partitionBy("shard").text(f"{folder}/shards")
    if not total:
        return folder, 0
    _count_slots(spark, folder, length)
    slots = spark.read.schema(SHARDS_DDL).parquet(f"{folder}/slots")
    return folder, slots.agg(F.sum("records")).first()[0]


READ_DDL = "slot long, doc_id long, piece int, length int, ids_crc32 long"


def _read(length: int, with_ids: bool):
    form = _format(length)

    def run(batches):
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                records = np.frombuffer(raw, form)
                for k in range(0, len(records), 2000):
                    head = np.ascontiguousarray(records["head"][k : k + 2000])
                    begin = (np.arange(k, k + len(head)) * form.itemsize + HEADER.itemsize).tolist()
                    ids = [raw[b : b + 2 * n] for b, n in zip(begin, head["length"].tolist())]
                    columns = [
                        pa.array(np.arange(first + k, first + k + len(head))),
                        pa.array(head["doc_id"], mask=head["doc_id"] == NO_DOC),
                        pa.array(head["piece"]),
                        pa.array(head["length"]),
                        pa.array(list(map(zlib.crc32, ids)), pa.int64()),
                    ]
                    names = [f.split()[0] for f in READ_DDL.split(", ")]
                    if with_ids:
                        columns.append(pa.array(ids, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_shards(spark: SparkSession, folder: str, length: int = LENGTH, per_shard: int = SHARD,
                with_ids: bool = True, first: int = 0) -> DataFrame:
    """``slot, doc_id, piece, length, ids_crc32`` and the 16-bit ``ids`` from slot ``first`` on.

    Shards are read front to back; those wholly before ``first`` are not opened. How many records
    a shard has is read from the folder, whatever ``per_shard`` it was written with.
    """
    S.attach(spark)
    ddl = READ_DDL + ", ids binary" * with_ids
    files = spark.read.format("binaryFile").load(f"{folder}/shards")
    if "shard" not in files.columns:  # nothing was written
        return spark.createDataFrame([], ddl)
    slots = spark.read.schema(SHARDS_DDL).parquet(f"{folder}/slots")
    wanted = slots.where(F.col("first") + F.col("records") > first)
    start = wanted.agg(F.min("shard")).first()[0]
    if start is None:
        return spark.createDataFrame([], ddl)
    files = files.select(F.col("shard").cast("long"), "content").where(F.col("shard") >= start)
    opened = files.join(checked(wanted.select("shard", "first")), "shard").select("first", "content")
    return opened.mapInArrow(S.settled(_read(length, with_ids)), ddl).where(F.col("slot") >= first)
