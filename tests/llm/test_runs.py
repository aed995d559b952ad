"""Periodic runs against a search of every period."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import runs
from tidemark.llm.queries import op13_periodic_runs


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if w[p:] == w[: len(w) - p])


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and smallest_period(w[i : i + 2 * q]) == q:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words_of(text):
    return [x.decode() for x in (text or "").encode().split()]


def brute(rows):
    out = []
    for d, t in rows:
        w = words_of(t)
        found = brute_runs(w)
        out.append((d, found, collapsed(w, found)))
    return sorted(out, key=repr)


def got(df):
    return sorted(
        ((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in df.collect()),
        key=repr,
    )


def random_words(rng):
    """Words over a small alphabet with repeats of repeats planted."""
    w = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        at, p = rng.randint(0, len(w)), rng.randint(1, 9)
        unit = [rng.choice("abc") for _ in range(p)]
        times = rng.randint(2, 7)
        w[at:at] = (unit * times + unit[: rng.randint(0, p)])
    return w


def test_random_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(random_words(rng))) for i in range(1500)]
    assert got(runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("together", [1, 50, 1 << 18])
def test_searched_alone_or_together(monkeypatch, together):
    """Texts next to each other, equal ones too, do not meet."""
    rng = random.Random(9)
    held = [[x.encode() for x in random_words(rng)] for _ in range(60)]
    held += [held[3], held[3], [b"a"] * 30, [b"a"] * 30, []]
    want = [[tuple(map(int, r)) for r in brute_runs(w)] for w in held]
    monkeypatch.setattr(runs, "TOGETHER", together)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(held))), pa.array([b" ".join(w).decode() for w in held])], names=["d", "t"]
    )
    found = [x for out in runs._runs(iter([batch])) for x in out.column(1).to_pylist()]
    assert [[(r["start"], r["length"], r["period"]) for r in f] for f in found] == want


def test_fibonacci_and_powers():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    for w in (b, [0] * 257, [0, 1] * 100, ([0] * 7 + [1]) * 30, ([0, 0, 1] * 5 + [2]) * 6):
        found = runs.find_runs(np.array([*w, 99]), len(w))
        assert [tuple(map(int, r)) for r in found] == brute_runs(w)


@pytest.mark.parametrize("name", ["odd", "repeated", "empty"])
def test_odd_rows(request, name):
    df = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in df.collect() if len(r["text"] or "") < 40_000]
    long = {(r["doc_id"], r["text"]) for r in df.collect()} - set(rows)
    out = [r for r in got(runs.periodic_runs(df))]
    want = brute(rows)
    for d, t in long:  # one word repeated, or one word
        n = len(words_of(t))
        times = sum(r["doc_id"] == d for r in df.collect())
        want += [(d, [(0, n, 1)] if n >= 6 else [], words_of(t)[0])] * times
    assert out == sorted(want, key=repr)


def test_range_successor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 100, 257):
        values = rng.permutation(n)
        tree = runs.WaveletTree(values)
        left = rng.integers(0, n, 300)
        right = np.minimum(left + rng.integers(1, n + 1, 300), n)
        x = rng.integers(0, n, 300)
        below = tree.below(left, right, x)
        for a, b, v, c in zip(left, right, x, below):
            part = np.sort(values[a:b])
            assert c == (part < v).sum()
        k = (right - left) // 2
        want = [np.sort(values[a:b])[i] for a, b, i in zip(left, right, k)]
        assert list(tree.nth(left, right, k)) == want


def planted(doc_id, text):
    w, h = words_of(text), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query(spark, sf, documents):
    want = []
    for r in documents.collect():
        w = planted(r["doc_id"], r["text"])
        found = brute_runs(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        sha = [
            hashlib.sha256(t.encode()).hexdigest()
            for t in ("".join(f"{s},{n},{q}\n" for s, n, q in found), collapsed(w, found))
        ]
        most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((r["doc_id"], len(found), *most, *sha))
    rows = sorted((tuple(r) for r in op13_periodic_runs(spark, sf).collect()), key=repr)
    assert rows == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in rows) >= 10
