"""Periodic runs of words, found by where dyadic blocks occur next to themselves."""

from __future__ import annotations

import collections
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import attach, texts

#: Words that are searched together; a longer text is searched alone.
TOGETHER = 1 << 18
MIN_LENGTH = 6
MIN_REPEATS = 4

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
DDL = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"


class Suffixes:
    """Suffix array by doubling, with the name of every substring of a power of two.

    ``names[k][i]`` is where the suffixes that share the 2^k words from i begin in the array, so
    equal names are equal substrings. ``blocks`` lists, for the lengths from 2 on, the aligned
    blocks that occur more than once, with their ranges of the array. The last word is unique.
    """

    def __init__(self, words: np.ndarray, longest: int):
        n = len(words)
        array = np.argsort(words, kind="stable")
        start = np.flatnonzero(np.diff(words[array], prepend=-1))
        size = np.zeros(n, np.int64)
        size[start] = np.diff(start, append=n)
        name = np.empty(n, np.int64)
        name[array] = np.repeat(start, size[start])
        self.array, self.names, self.blocks = array, [name.astype(np.int32)], []
        reach = 1
        while 2 * reach <= longest // 2:
            live = np.flatnonzero(size[name] > 1)
            if not len(live):
                break
            after = live + reach
            second = np.where(after < n, name[np.minimum(after, n - 1)] + 1, 0)
            key = name[live] * (n + 1) + second
            order = np.argsort(key, kind="stable")
            live, key = live[order], key[order]
            base = name[live]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            group = np.zeros(len(live), np.int64)
            heads = np.flatnonzero(np.diff(base, prepend=-1))
            group[heads] = heads
            group = np.maximum.accumulate(group)
            array[base + np.arange(len(live)) - group] = live
            counts = np.diff(first, append=len(live))
            begins = (base + np.arange(len(live)) - group)[first]
            size[begins] = counts
            name = name.copy()
            name[live] = np.repeat(begins, counts)
            reach *= 2
            self.names.append(name.astype(np.int32))
            self._blocks(words, name, size, reach)

    def _blocks(self, words, name, size, length):
        at = np.arange(0, len(words) - length + 1, length)
        at = at[size[name[at]] > 1]
        if length == 2:  # of these only period 1 is wanted
            at = at[words[at] == words[at + 1]]
        left = name[at]
        self.blocks.append((length, at, left, left + size[left]))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on."""
        return self._extend(a, b, 1)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` equal those before ``b``."""
        return self._extend(a, b, -1)

    def _extend(self, a, b, way):
        moved = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            step, name = 1 << k, self.names[k]
            live = np.arange(len(a))
            while len(live):
                i, j = a[live] + way * moved[live], b[live] + way * moved[live]
                if way < 0:
                    i, j = i - step, j - step
                same = (i >= 0) & (name[np.maximum(i, 0)] == name[np.maximum(j, 0)])
                live = live[same]
                moved[live] += step
                if k < len(self.names) - 1:
                    break  # only the longest step may be taken more than once
        return moved


class WaveletTree:
    """Counts and order statistics of any range of a permutation, bit by bit from the highest."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for bit in reversed(range(self.bits)):
            zero = (values >> bit) & 1 == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[zero], values[~zero]])

    def _down(self, before, left, right, one):
        a, b = before[left], before[right]
        left = np.where(one, before[-1] + left - a, a)
        right = np.where(one, before[-1] + right - b, b)
        return left, right

    def below(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values of each range are less than ``value``."""
        found = np.zeros(len(left), np.int64)
        for before, bit in zip(self.zeros, reversed(range(self.bits))):
            one = (value >> bit) & 1 == 1
            found += np.where(one, before[right] - before[left], 0)
            left, right = self._down(before, left, right, one)
        return found

    def nth(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with ``n`` lesser ones in its range."""
        found = np.zeros(len(left), np.int64)
        for before, bit in zip(self.zeros, reversed(range(self.bits))):
            zeros = before[right] - before[left]
            one = n >= zeros
            n = np.where(one, n - zeros, n)
            found += one.astype(np.int64) << bit
            left, right = self._down(before, left, right, one)
        return found


def find_runs(words: np.ndarray, longest: int) -> np.ndarray:
    """All runs of a sequence that ends with a unique word: rows ``start, length, period``.

    A run of period q and 4q words or more holds an aligned block of the power of two b with
    b/2 <= q < b, and q words beside it. So that block's next occurrence on one side is at
    distance q exactly: a lesser one would make the period itself periodic. Range successor
    over the block's suffixes gives the neighbours, distances b/2 <= d < b are the candidates,
    and common extensions to both sides make them maximal.
    """
    none = np.empty((0, 3), np.int64)
    if longest < MIN_LENGTH:
        return none
    known = Suffixes(words, longest)
    kinds = [(b, at, left, right) for b, at, left, right in known.blocks if len(at)]
    if not kinds:
        return none
    tree = WaveletTree(known.array)
    begins, periods = [], []
    for length, at, left, right in kinds:
        lesser = tree.below(left, right, at)
        for side in (1, -1):
            there = np.flatnonzero(lesser + 1 < right - left if side > 0 else lesser > 0)
            other = tree.nth(left[there], right[there], lesser[there] + side)
            gap = np.abs(other - at[there])
            near = (2 * gap >= length) & (gap < length)
            begins.append(np.minimum(other, at[there])[near])
            periods.append(gap[near])
    begin, period = np.concatenate(begins), np.concatenate(periods)
    back = known.backward(begin, begin + period)
    length = back + known.forward(begin, begin + period) + period
    good = length >= np.maximum(MIN_LENGTH, MIN_REPEATS * period)
    found = np.stack([begin - back, length, period], axis=1)[good]
    return np.unique(found, axis=0) if len(found) else none


def _search(ids: list, held: list[list[bytes]]) -> pa.RecordBatch:
    """Runs and collapsed texts of some documents, whose words are searched as one sequence."""
    number = collections.defaultdict(itertools.count().__next__)
    sizes = np.array([len(w) for w in held], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.empty(first[-1], np.int64)
    for w, at in zip(held, first):
        words[at : at + len(w)] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
    words[first[1:] - 1] = len(number) + np.arange(len(held))  # a word of its own after each text
    runs = find_runs(words, int(sizes.max()))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(edge) == 0
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1
    runs[:, 0] -= first[owner]
    order = np.lexsort((runs[:, 2], runs[:, 0], owner))
    runs, bounds = runs[order], np.searchsorted(owner[order], np.arange(len(held) + 1))
    texts_left = []
    for i, w in enumerate(held):
        if bounds[i] < bounds[i + 1]:
            w = itertools.compress(w, keep[first[i] : first[i] + len(w)])
        texts_left.append(b" ".join(w).decode())
    parts = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], fields=list(RUN))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), parts),
            pa.array(texts_left, pa.string()),
        ],
        names=["doc_id", "runs", "collapsed_text"],
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, held, total = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            words = text.as_py().encode().split() if text.is_valid else []
            if held and total + len(words) > TOGETHER:
                yield _search(ids, held)
                ids, held, total = [], [], 0
            ids.append(doc_id.as_py())
            held.append(words)
            total += len(words) + 1
    if held:
        yield _search(ids, held)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, runs, collapsed_text``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest
    period q and at least max(6, 4q) words that cannot grow on either side; ``runs`` lists them
    as (start, length, period) by start, then period. ``collapsed_text`` joins the words that
    no run holds after its first q words. Null and blank texts have no runs and collapse to
    nothing. Every row is its own document, whatever its doc_id.
    """
    attach(docs.sparkSession)
    return texts(docs).mapInArrow(_runs, DDL)
