"""Exact, substring and Jaccard dedup against brute force."""

from __future__ import annotations

import collections
import hashlib
import os

import numpy as np
import pytest

from tidemark.llm import exact, jaccard, shared, substrings
from tidemark.llm.links import components


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        done = False
        for d in ids:
            kept = d == keep and not done
            done |= kept
            out.append((d, keep, len(ids), kept, sha(t.encode())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["documents", "odd", "repeated", "empty"])
def test_exact(request, name):
    df = request.getfixturevalue(name)
    got = sorted((tuple(r) for r in exact.exact_duplicates(df).collect()), key=repr)
    assert got == brute_exact(plain(df))


def test_exact_drop(odd, repeated):
    kept = exact.drop_exact_duplicates(repeated)
    assert kept.schema == odd.schema
    rows = plain(kept)
    assert len(rows) == len({t or "" for _, t in plain(odd)})
    assert (8, plain(odd)[7][1]) in rows and (3, " \n\t ") in rows


def test_fingerprints_combine():
    for n in (0, 1, 4095, 4096, 4097, 9000):
        data = os.urandom(n)
        for cut in (0, n // 3, n):
            left, right = exact.fingerprint(data[:cut]), exact.fingerprint(data[cut:])
            assert exact.combine(left, right, n - cut) == exact.fingerprint(data)


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """With a useless fingerprint the chunkwise comparison and the digest still separate texts."""
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "e")], "doc_id long, text string")
    marks = exact.texts(docs).mapInArrow(exact._marks, exact.MARK)
    from pyspark.sql import functions as F

    same = marks.withColumn("print", F.lit(b"0"))
    repeated = same.groupBy("print").count().select("print")
    assert exact._unequal(docs, same, repeated).count() == 1
    alike = docs.where("text = 'ab'")
    marks = exact.texts(alike).mapInArrow(exact._marks, exact.MARK)
    assert exact._unequal(alike, marks, marks.select("print").distinct()).count() == 0


def brute_repeats(rows, length):
    first: dict = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), sha(kept), kept.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["documents", "odd", "repeated", "empty"])
@pytest.mark.parametrize("length", [13, 4, 30])
def test_repeats(request, name, length):
    df = request.getfixturevalue(name)
    got = sorted((tuple(r) for r in substrings.remove_repeats(df, length).collect()), key=repr)
    assert got == brute_repeats(plain(df), length)


def test_repeats_in_rows(odd, documents):
    for df in (odd, documents):
        out = substrings.drop_repeats(df)
        assert out.schema == df.schema
        want = {d: k for d, n, g, _, k in brute_repeats(plain(df), 13) if g and g < n}
        gone = {d for d, n, g, _, _ in brute_repeats(plain(df), 13) if g and g == n}
        before = {r["doc_id"]: r for r in df.collect()}
        after = out.collect()
        assert {r["doc_id"] for r in after} == set(before) - gone
        for r in after:
            old = before[r["doc_id"]]
            if r["doc_id"] in want:
                assert r["text"] == want[r["doc_id"]] and r["n_chars"] == len(r["text"])
            else:
                assert r == old


def test_window_hashes_depend_on_the_window_only():
    words = np.array([5, 6, 7, 5, 6, 7, 8, 5, 6, 7], np.uint64)
    for length in range(1, 11):
        got = shared.window_hashes(words, length)
        at = collections.defaultdict(set)
        for i, h in enumerate(got.tolist()):
            at[tuple(words[i : i + length])].add(h)
        assert len(got) == 11 - length and all(len(s) == 1 for s in at.values())
        assert len({h for s in at.values() for h in s}) == len(at)


def brute_components(rows, words=5):
    sets = []
    for _, t in rows:
        w = tuple((t or "").encode().lower().split())
        sets.append({w[i : i + words] for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(
        ((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))),
        key=repr,
    )


@pytest.mark.parametrize("name", ["documents", "odd", "repeated", "empty"])
def test_jaccard(request, name):
    df = request.getfixturevalue(name)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=repr)
    assert got == brute_components(plain(df))


@pytest.mark.parametrize("bound", [("UNIT", 3), ("UNIT_SHINGLES", 150)])
def test_jaccard_over_many_units(spark, monkeypatch, bound):
    """Chains and groups that are spread over units, by rows or by shingles, connect as in one."""
    monkeypatch.setattr(jaccard, *bound)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(25):  # a chain: neighbours are near, the ends are not
        rows.append((100 + k, " ".join(base[k:] + [f"z{i}" for i in range(k)])))
    for k in range(12):  # a group around one text
        own = [f"g{i}" for i in range(200)]
        own[k * 15] = f"other{k}"
        rows.append((10 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=repr)
    assert got == brute_components(rows)


def test_classes_ask_only_units_that_share_a_token(spark, monkeypatch):
    """Texts of one template that share rare phrases, but no link, do not ask every unit."""
    monkeypatch.setattr(jaccard, "UNIT", 3)
    sizes, write = [], jaccard.written

    def counting(df, name):
        out = write(df, name)
        if name == "jaccard-routes":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counting)
    phrase = lambda k: [f"p{k}-{i}" for i in range(28)]
    common = [f"c{i}" for i in range(150)]
    rows = [(k, " ".join(phrase(k) + common + phrase(k + 1))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=repr)
    assert got == brute_components(rows)
    assert len({c for _, _, c in got}) == len(rows)
    assert len(sizes) == 2 and 0 < max(sizes) <= 2 * len(rows)


def test_units_find_all_links():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.choice(400, 80, replace=False).astype(np.uint64)
        for _ in range(3):
            own = base.copy()
            own[rng.choice(80, rng.integers(0, 14), replace=False)] = rng.choice(9000, 1) + 500
            sets.append(np.unique(own))
    unit = jaccard.Unit(sets)
    for i, q in enumerate(sets):
        want = [
            j for j, s in enumerate(sets)
            if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))
        ]
        assert unit.links(q).tolist() == want and i in want


def test_ranges_cost_what_is_present():
    """A million ranges, few keys: every key in its range, and little memory."""
    import tracemalloc

    keys = np.sort(np.random.default_rng(2).integers(0, 1 << 62, 50_000).astype(np.uint64) * 4)
    tracemalloc.start()
    found = list(shared.ranges(keys, 10**6))
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    assert [s.start for _, s in found[1:]] == [s.stop for _, s in found[:-1]]
    assert found[0][1].start == 0 and found[-1][1].stop == len(keys)
    for part, cut in found:
        assert {int(k) * 10**6 >> 64 for k in keys[cut]} == {part}
    assert list(shared.ranges(keys[:0], 7)) == []
    edge = np.array([0, (1 << 64) - 1], np.uint64)
    assert [p for p, _ in shared.ranges(edge, 6_250_000)] == [0, 6_249_999]


def test_levels_end_when_nothing_is_repeated(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(substrings, "_send", lambda *a, real=substrings._send: sent.append(a) or real(*a))
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(40))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substrings.remove_repeats(df).collect()), key=repr)
    assert got == brute_repeats(rows, 13) and len(sent) == 1


def test_null_ids_are_no_id_of_their_own(spark):
    """Rows without doc_id and rows with -1, with equal texts and with others."""
    rows = [(-1, "a"), (None, "b"), (-1, "b"), (None, "c"), (None, "c"), (-1, "d"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(plain(exact.drop_exact_duplicates(df)), key=repr)
    assert got == sorted([(-1, "a"), (-1, "b"), (None, "c"), (-1, "d")], key=repr)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
