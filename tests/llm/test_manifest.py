"""The Merkle manifest against a plain recursion."""

from __future__ import annotations

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest
from tidemark.llm.queries import op12_merkle_manifest

UPPER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """Root, and each leaf's siblings (left, right) level by level."""
    paths = [[] for _ in digests]
    here = [(d, [i]) for i, d in enumerate(digests)]
    while len(here) > 1:
        up = []
        for at in range(0, len(here), 16):
            run = here[at : at + 16]
            for k, (_, covered) in enumerate(run):
                beside = ("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :]))
                for i in covered:
                    paths[i].append(beside)
            up.append((sha("".join(d for d, _ in run)), [i for _, c in run for i in c]))
        here = up
    return here[0][0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (id, source, lang, n, text)."""
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r[1]].append((-1 if r[0] is None else r[0], leaf(r), r))
    names = sorted(sources, key=lambda s: b"" if s is None else b"+" + s.encode())
    inner = {s: tree([x[1] for x in sorted(sources[s], key=lambda x: x[:2])]) for s in names}
    root, outer = tree([inner[s][0] for s in names]) if names else (None, [])
    out = []
    for s, above in zip(names, outer):
        for (_, digest, r), path in zip(sorted(sources[s], key=lambda x: x[:2]), inner[s][1]):
            start = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                start = leaf((*r[:4], r[4].translate(UPPER)))
            folded, path = start, path + above
            for a, b in path:
                folded = sha(a + folded + b)
            proof = sha("".join(a + b for a, b in path))
            out.append((r[0], digest, inner[s][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def proven(docs):
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = manifest.manifest(docs, altered)
    folded = manifest.folded(F.coalesce("other", "leaf"))
    rows = rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof_text(), 256), folded.alias("f"),
        folded == F.col("root"),
    )
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("name", ["documents", "odd", "repeated", "empty"])
def test_tables(request, name):
    docs = request.getfixturevalue(name)
    assert proven(docs) == brute(plain(docs))


@pytest.mark.parametrize("sizes", [(1,), (16, 17), (1, 15, 256, 257, 2), (4097, 1), tuple([3] * 40)])
def test_sizes(spark, sizes):
    """Lone leaves, full runs, last runs of one, four levels, and more sources than a run."""
    rows, number = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            text = [None, "", f"Text {number} ÄÖ", "same"][number % 4]
            source = None if s == 0 else f"s{s:03d}" if s % 2 else f"é{s}"
            rows.append((number * 7919 % 100_003, source, "en" if number % 3 else None, number, text))
            number += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    assert proven(docs) == brute(rows)


def test_ranks(spark):
    """Ranks run through the ranges of a tree that fills nearly all of them."""
    rows = spark.range(5000).select(
        F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("tree"), (F.col("id") * 37 % 5003).alias("k")
    )
    got = manifest.ranked(rows, ["k"], "ranks").collect()
    for tree_name in "ab":
        mine = sorted((r for r in got if r["tree"] == tree_name), key=lambda r: r["k"])
        assert [r["lo"] for r in mine] == list(range(len(mine)))
        assert {r["n"] for r in mine} == {len(mine)}


def test_query(spark, sf, documents):
    got = sorted((tuple(r) for r in op12_merkle_manifest(spark, sf).collect()), key=repr)
    assert got == brute(plain(documents))
    altered = [r for r in got if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert altered and not all(r[6] for r in altered)
    assert all(r[6] for r in got if zlib.crc32(str(r[0]).encode()) % 5)
