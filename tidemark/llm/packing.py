"""Best-fit packing of token pieces into sequences, certified by dual-feasible lower bounds."""

from __future__ import annotations

import logging
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared as S
from tidemark.llm.tokens import encoder, vocabulary
from tidemark.session import written

CAPACITY = 4096
END = 1
GROUP = 50_000

PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str | None, capacity: int, end: int):
    def run(batches):
        encode = encoder(path or vocabulary("word_bpe_49k.json")).encode
        for batch in batches:
            rows = []
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for doc_id, found in zip(batch.column(0), encode(raw)):
                ids = np.append(found, np.uint32(end)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append(
                        (doc_id.as_py(), piece, start, len(part), zlib.crc32(part.tobytes()))
                    )
            if rows:
                yield S.record(rows, PIECE_DDL)

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END):
    """Token pieces of every document; only documents over ``capacity`` are cut."""
    S.attach(docs.sparkSession)
    return S.texts(docs).mapInArrow(S.settled(_pieces(path, capacity, end)), PIECE_DDL)


def feasible_sums(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """``(function, numerator, capacity it is measured in)`` of each dual-feasible function.

    They map lengths so that whatever fits one sequence still does; the sums of groups add up,
    and each sum over its capacity bounds the number of sequences from below.
    """
    x = lengths.astype(np.int64)
    out = [(0, int(x.sum()), capacity)]
    for k in range(1, 9):
        whole = ((k + 1) * x) % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        out.append((k, int(value.sum()), capacity * k))
    for i in range(1, 17):
        small = capacity * i // 32
        value = np.where(x > capacity - small, capacity, np.where(x >= small, x, 0))
        out.append((100 + i, int(value.sum()), capacity))
    return out


def lower_bound(sums) -> int:
    return max((S.ceil_div(n, c) for _, n, c in sums), default=0)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: bin and offset of each piece, and the room left in each bin."""
    bins, offsets, room = [0] * len(lengths), [0] * len(lengths), []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        fits = open_rooms >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = waiting[gap].pop()
            if not waiting[gap]:
                open_rooms &= ~(1 << gap)
        else:
            gap, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        room[b] = left = gap - n
        if left:
            waiting[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, room


PACKED_DDL = PIECE_DDL + ", sequence_id long, offset long, free long"


def _pack(capacity: int, turn: int):
    def run(key, table):
        lengths = table.column("length").to_pylist()
        bins, offsets, room = best_fit(lengths, capacity)
        if len(room) > 1 << 20:
            raise ValueError(f"{len(room)} sequences in a group, ids hold {1 << 20}")
        first = (turn << 56) | (key[0].as_py() << 20)
        return pa.table(
            [table.column(f.split()[0]) for f in PIECE_DDL.split(", ")]
            + [
                pa.array([first + b for b in bins], pa.int64()),
                pa.array(offsets, pa.int64()),
                pa.array([room[b] for b in bins], pa.int64()),
            ],
            names=[f.split()[0] for f in PACKED_DDL.split(", ")],
        )

    return run


def _bound(key, table):
    lengths = np.array(table.column("length").to_pylist(), np.int64)
    rows = feasible_sums(lengths, int(key[1].as_py()))
    return pa.Table.from_batches([S.record(rows, "function int, total long, capacity long")])


def pack(held: DataFrame, capacity: int = CAPACITY, group: int = GROUP,
         most: int = GROUP) -> DataFrame:
    """Written pieces with ``sequence_id`` and ``offset``: no sequence over ``capacity``.

    Pieces are dealt by row number into groups of about ``group``, and each group is packed best
    fit decreasing. Dual-feasible sums over all groups certify how few sequences are possible. As
    long as there are more, groups give the pieces of their sequences with free room to fewer
    groups, dealt anew, which pack them again. A group never gets more than about ``most``
    pieces; once such groups save no sequence in a turn, the packing before stays, and what it
    has above the certified number is logged.
    """
    number = "monotonically_increasing_id()"  # not by doc_id, which rows may repeat
    count = held.count()
    groups = S.parts_for(count, min(group, most), 1)
    dealt = F.expr(f"cast(pmod(xxhash64({number}), {groups}) as long)").alias("part")
    sums = held.select("length", dealt, F.lit(capacity).alias("capacity")).groupBy(
        "part", "capacity"
    ).applyInArrow(_bound, "function int, total long, capacity long")
    sums = sums.groupBy("function", "capacity").agg(F.sum("total").alias("total")).collect()
    certified = lower_bound([(r["function"], r["total"], r["capacity"]) for r in sums])
    done, rest, left, turn, settled, best = [], None, held, 0, 0, None
    while True:
        dealt = F.expr(f"cast(pmod(xxhash64({number}, {turn}), {groups}) as long)")
        packed = left.withColumn("part", dealt).groupBy("part")
        packed = written(packed.applyInArrow(S.settled(_pack(capacity, turn)), PACKED_DDL), "packed")
        made = packed.where("offset = 0").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("free") == 0, 1)).alias("full")
        ).first()
        saved = best is None or settled + made["n"] < best
        if saved:
            best = settled + made["n"]
            settled += made["full"]
            done.append(packed.where("free = 0"))
            rest = packed.where("free > 0")
            left = rest.select(*held.columns)
            count = left.count()
        least = S.parts_for(count, most, 1)
        if best <= certified or groups == 1 or turn == 120 or not saved and groups <= least:
            break
        groups = max(min(groups // 2, S.parts_for(count, group, 1)), least)
        turn += 1
    if best > certified:
        logging.getLogger(__name__).warning(
            "packed into %d sequences, at least %d are needed", best, certified
        )
    out = rest
    for full in done:
        out = out.unionByName(full)
    return out.drop("free")


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                     end: int = END) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and then ``end``; null text is empty, so every document has a piece.
    Rows that repeat a doc_id are packed each for itself.
    """
    held = written(pieces(docs, path, capacity, end), "pieces")
    return pack(held, capacity)
