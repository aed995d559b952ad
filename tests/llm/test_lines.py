"""Line dedup against brute force."""

from __future__ import annotations

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import lines
from tidemark.llm.queries import op11_line_dedup

UPPER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(rows, min_chars=10, min_docs=2):
    holders = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    first = {
        k: min((d for d in ids if d is not None), default=None)
        for k, ids in holders.items()
        if len(ids) >= min_docs
    }
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if key(x) not in first or first[key(x)] == d]
        out.append((d, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


HARD = [
    (1, "same line here\nSAME line HERE  \nown"),
    (2, "\t same LINE here\r\nshort\n\n"),
    (3, "short\nshort\nshort"),
    (4, "ÄÖÜ straße İI\näöü strasse\n\n\n"),
    (5, "äÖÜ straße İi\nÄÖÜ STRAßE İI"),
    (6, "\n"),
    (6, "same line here\nmore of six"),
    (7, "more of six\nten chars!\nten chars!"),
    (None, "more of six\nonly without an id"),
    (None, "only without an id"),
    (8, "a b c d e \nline with nul \x00 in it"),
    (9, "line with nul \x00 in it\r"),
    (9, "line with nul \x00 in it\r"),
    (10, "🙂🙂🙂🙂🙂🙂🙂🙂🙂\n🙂🙂🙂🙂🙂🙂🙂🙂🙂🙂"),
    (11, "🙂🙂🙂🙂🙂🙂🙂🙂🙂\n🙂🙂🙂🙂🙂🙂🙂🙂🙂🙂"),
]


@pytest.mark.parametrize("name", ["documents", "odd", "repeated", "empty"])
def test_tables(request, name):
    df = request.getfixturevalue(name)
    assert found(lines.drop_repeated_lines(df)) == brute(plain(df))


@pytest.mark.parametrize("salt", [1, 2_000])
def test_hard_lines(spark, monkeypatch, salt):
    """Also with every key dealt over as many salts as it has lines."""
    monkeypatch.setattr(lines, "SALT_LINES", salt)
    df = spark.createDataFrame(HARD, "doc_id long, text string")
    assert found(lines.drop_repeated_lines(df)) == brute(HARD)


def test_general_interface(spark):
    df = spark.createDataFrame(HARD, "doc_id long, text string")
    got = found(lines.drop_repeated_lines(df, min_chars=3, min_docs=3))
    assert got == brute(HARD, 3, 3)


def test_one_line_in_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lines, "SALT_LINES", 100)
    text = F.concat(F.lit("the same notice\nbody "), F.col("id").cast("string"))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = lines.drop_repeated_lines(df)
    assert got.agg(F.sum("n_dropped"), F.sum("n_lines")).first()[:] == (2999, 6000)
    assert got.where("n_dropped = 0").first()["doc_id"] == 0


def test_ten_thousand_lines(spark):
    body = "\n".join(f"line number {i}" for i in range(10_000))
    df = spark.createDataFrame([(1, body), (2, body + "\nend of two")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.drop_repeated_lines(df).collect()}
    assert got[2]["n_dropped"] == 10_000 and got[2]["kept_text"] == "end of two"
    assert got[1]["n_dropped"] == 0 and got[1]["kept_text"] == body


def test_native(spark, sf):
    """No Python on the executors."""
    plan = op11_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_query(spark, sf, documents):
    got = found(op11_line_dedup(spark, sf))
    want = [(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute(plain(documents))]
    assert got == sorted(want, key=repr)
