"""Repeated word windows across documents, found level by level on windows of doubling length.

Windows of about half the wanted length are looked at first, and of those only the one with the
least hash inside each wanted window: equal windows have equal least parts, so nothing is lost
and most positions never leave their task. Windows whose part turned up once are out. What is
left is extended to twice the length, level after level, until it has the wanted length or no
candidate survives. Every level sends packed sorted hashes of a whole bundle to hash ranges and
gets one bit a hash back, so a passage in a third of all documents costs one entry a bundle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared as S
from tidemark.session import written

WINDOW = 13
RANGE_BYTES = 16 << 20
LEAST_RANGES = 64
SECOND = 0xD6E8FEB86659FD93
NO_DOC = np.int64(-1 << 63)
LAST = np.uint64((1 << 64) - 1)


def levels(length: int) -> list[int]:
    """Window lengths looked at, shortest first; each at most twice the one before."""
    out = [length]
    while out[0] > 7:
        out.insert(0, -(-out[0] // 2))
    return out


class Words:
    """The words of a bundle in one line, and which document each belongs to."""

    def __init__(self, doc_id: list, size: list, body: bytes):
        self.words = [raw.split() for raw in S.bundle_texts(size, body)]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.hashes = np.concatenate(
            [S.hash_words(w) for w in self.words] or [np.empty(0, np.uint64)]
        )
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.starts = np.cumsum(counts) - counts
        self.ids = np.array([NO_DOC if d is None else d for d in doc_id], np.int64)
        self.named = np.array([d is not None for d in doc_id], bool)

    def inside(self, length: int) -> np.ndarray:
        """Positions whose window lies in one document that has an id."""
        n = max(0, len(self.doc) - length + 1)
        return (self.doc[:n] == self.doc[length - 1 :][:n]) & self.named[self.doc[:n]]


def _least_parts(words: Words, part: int, length: int) -> np.ndarray:
    """For each window of ``length``: the least hash of its windows of ``part`` words."""
    hashes = S.window_hashes(words.hashes, part)
    n = max(0, len(words.hashes) - length + 1)
    if not n:
        return np.empty(0, np.uint64)
    least = hashes[:n].copy()
    for k in range(1, length - part + 1):
        np.minimum(least, hashes[k : k + n], out=least)
    return least


class Level:
    """The distinct keys a bundle sends at one level, sorted, with the windows they stand for."""

    def __init__(self, words: Words, keys: np.ndarray, second: np.ndarray | None, at: np.ndarray):
        order = np.lexsort((at, second, keys)) if second is not None else np.lexsort((at, keys))
        self.at, keys = at[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        if second is not None:
            second = second[order]
            new[1:] |= second[1:] != second[:-1]
        first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.keys = keys[first]
        self.second = None if second is None else second[first]
        ids = words.ids[words.doc[self.at]]
        self.least = np.minimum.reduceat(ids, first) if len(first) else ids
        most = np.maximum.reduceat(ids, first) if len(first) else ids
        self.several = self.least != most

    def ranges(self, count: int) -> Iterator[tuple[int, slice]]:
        return S.ranges(self.keys, count)


def _flags(level: Level, count: int, answers: list) -> np.ndarray:
    """Per key of the level what its range answered: repeated, or the least id anywhere."""
    out = np.zeros(len(level.keys), np.int64)
    got = {a["part"]: a["answer"] for a in answers}
    for part, cut in level.ranges(count):
        if part in got:
            out[cut] = S.unpack(got[part], np.int64)
    return out


def _replay(row: dict, length: int, count: int, upto: int):
    """The level ``upto`` of a bundle, after the answers to all levels before it."""
    words = Words(row["doc_id"], row["size"], row["body"])
    steps = levels(length)
    answers: dict[int, list] = {}
    for a in row.get("answers") or []:
        answers.setdefault(a["level"], []).append(a)
    inside = np.flatnonzero(words.inside(length))
    if len(steps) == 1:
        level = _final(words, inside, length)
    else:
        least = _least_parts(words, steps[0], length)
        level = Level(words, least[inside], None, inside)
    for k in range(upto):
        repeated = _flags(level, count, answers.get(k, [])) != 0
        at = np.sort(level.at[repeated[level.group]])
        if k + 2 == len(steps):
            level = _final(words, at, length)
        else:
            # a longer part of the window: its first words, of which the least part is known
            level = Level(words, S.window_hashes(words.hashes, steps[k + 1])[at], None, at)
    return words, level, answers


def _final(words: Words, at: np.ndarray, length: int) -> Level:
    second = S.window_hashes(words.hashes, length, SECOND)[at].astype(np.uint32)
    return Level(words, S.window_hashes(words.hashes, length)[at], second, at)


KEYS_DDL = "part int, bundle long, keys binary, second binary, least binary, several binary"


def _send(length: int, count: int, upto: int):
    last = upto == len(levels(length)) - 1
    if last:
        def fields(level, cut):
            return S.pack(level.second[cut]), S.pack(level.least[cut]), None
    else:
        def fields(level, cut):
            return None, None, S.pack(level.several[cut].view(np.uint8))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, level, _ = _replay(row, length, count, upto)
                rows = [
                    (part, row["bundle"], S.pack_sorted(level.keys[cut]), *fields(level, cut))
                    for part, cut in level.ranges(count)
                ]
                if rows:
                    yield S.record(rows, KEYS_DDL)

    return run


ANSWER_DDL = "bundle long, part int, answer binary, hits long"


def _repeated(table: pa.Table) -> pa.Table:
    """One hash range: which keys stand in two bundles, or in two documents of one."""
    rows = table.to_pylist()
    keys = [S.unpack_sorted(r["keys"]) for r in rows]
    several = np.concatenate([S.unpack(r["several"], np.uint8) for r in rows])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    sorted_keys = every[order]
    new = np.ones(len(every), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(every)))
    any_several = np.maximum.reduceat(several[order], first)
    found = np.empty(len(every), np.int64)
    found[order] = ((count > 1) | (any_several > 0))[np.cumsum(new) - 1]
    return _answers(rows, keys, found)


def _least_ids(table: pa.Table) -> pa.Table:
    """One hash range at the last level: the least id that holds each window."""
    rows = table.to_pylist()
    keys = [S.unpack_sorted(r["keys"]) for r in rows]
    every = np.concatenate(keys)
    second = np.concatenate([S.unpack(r["second"], np.uint32) for r in rows])
    least = np.concatenate([S.unpack(r["least"], np.int64) for r in rows])
    order = np.lexsort((second, every))
    a, b = every[order], second[order]
    new = np.ones(len(every), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    ids = np.minimum.reduceat(least[order], np.flatnonzero(new))
    found = np.empty(len(every), np.int64)
    found[order] = ids[np.cumsum(new) - 1]
    return _answers(rows, keys, found)


def _answers(rows, keys, found) -> pa.Table:
    out, at = [], 0
    for row, k in zip(rows, keys):
        answer = found[at : at + len(k)]
        at += len(k)
        out.append((row["bundle"], row["part"], S.pack(answer), int(np.count_nonzero(answer))))
    return pa.Table.from_batches([S.record(out, ANSWER_DDL)])


DONE_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _left(row: dict, length: int, count: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Words and kept words of each document of a bundle."""
    upto = len(levels(length)) - 1
    words, level, answers = _replay(row, length, count, upto)
    least = _flags(level, count, answers.get(upto, []))[level.group]
    hit = level.at[least < words.ids[words.doc[level.at]]]
    edge = np.zeros(len(words.doc) + length + 1, np.int32)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + length, -1)
    gone = np.cumsum(edge)[: len(words.doc)] > 0
    for own, start in zip(words.words, words.starts):
        cut = gone[start : start + len(own)]
        yield own, [w for w, g in zip(own, cut.tolist()) if not g] if cut.any() else own


def _finish(length: int, count: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for doc_id, (own, kept) in zip(row["doc_id"], _left(row, length, count)):
                    raw = b" ".join(kept)
                    digest = hashlib.sha256(raw).hexdigest()
                    rows.append((doc_id, len(own), len(own) - len(kept), digest, raw.decode()))
                for k in range(0, len(rows), 500):
                    yield S.record(rows[k : k + 500], DONE_DDL)

    return run


def _rewrite(length: int, count: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                table = S.bundle_rest(row["rest"])
                raws = S.bundle_texts(row["size"], row["body"])
                nulls = table.column("text").to_pylist()
                old = [None if null else raw.decode() for raw, null in zip(raws, nulls)]
                new, stays = [], []
                for text, (own, kept) in zip(old, _left(row, length, count)):
                    new.append(text if len(kept) == len(own) else b" ".join(kept).decode())
                    stays.append(bool(kept) or not own)
                for name, values in (("text", new), ("n_chars", [None if x is None else len(x) for x in new])):
                    if name in table.column_names:
                        at = table.column_names.index(name)
                        if name == "n_chars":
                            was = table.column(name).to_pylist()
                            values = [
                                n if a is not b else w for n, a, b, w in zip(values, new, old, was)
                            ]
                        kind = pa.string() if name == "text" else table.schema.types[at]
                        table = table.set_column(at, name, pa.array(values, kind))
                yield from table.filter(pa.array(stays)).to_batches(max_chunksize=500)

    return run


def _in_ranges(sent: DataFrame, answer) -> DataFrame:
    return sent.groupBy("part").applyInArrow(S.settled(answer), ANSWER_DDL)


def _answered(held: DataFrame, length: int, count: int) -> DataFrame:
    """Written bundles beside the answers to their levels.

    When no window of a level is repeated, longer ones cannot be, and no further level is sent.
    """
    steps, rows, answered = levels(length), held, None
    for k in range(len(steps)):
        sent = rows.mapInArrow(S.settled(_send(length, count, k)), KEYS_DDL)
        found = _in_ranges(sent, _least_ids if k == len(steps) - 1 else _repeated)
        found = written(found.withColumn("level", F.lit(k)), "substring-answers")
        answered = found if answered is None else answered.unionByName(found)
        collected = answered.groupBy("bundle").agg(
            F.collect_list(F.struct("level", "part", "answer")).alias("answers")
        )
        rows = held.join(collected, "bundle", "left")
        if not found.where("hits > 0").take(1):
            break
    return rows


def remove_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept_sha256, kept_text``.

    Words are runs of other than ASCII white space. A word goes when it is covered by a window
    of ``length`` words that also starts in a document with a smaller doc_id; windows are judged
    on the input. Null text has no words. A document without an id neither gives nor loses
    words. Rows that repeat a doc_id count as one document with several texts.
    """
    held = written(S.bundles(docs), "substring-bundles")
    count = S.parts_for(S.bytes_of(held), RANGE_BYTES, LEAST_RANGES)
    return _answered(held, length, count).mapInArrow(S.settled(_finish(length, count)), DONE_DDL)


def drop_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """``docs`` with the words that stay, joined by one space, as text, in all their columns.

    Where a text changes, n_chars (if there is such a column) follows it; other texts stay as
    they are, white space included. Documents that lose every word go, documents that had none
    stay.
    """
    held = written(S.bundles(docs, whole_rows=True), "substring-bundles")
    count = S.parts_for(S.bytes_of(held), RANGE_BYTES, LEAST_RANGES)
    return _answered(held, length, count).mapInArrow(
        S.settled(_rewrite(length, count)), docs.schema
    )
