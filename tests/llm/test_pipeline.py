"""The stages one by one, and the registered queries."""

from __future__ import annotations

import collections

from test_dedup import brute_components, brute_repeats

import corpus_pipeline
from tidemark.llm import language
from tidemark.llm.queries import CATALOG
from tidemark.session import written


def columns(df):
    return [(f.name, f.dataType) for f in df.schema.fields]


def test_stages(spark, sf, documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    docs, ids = documents, [set(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert columns(docs) == columns(documents), name
        ids.append({r["doc_id"] for r in docs.collect()})
        assert ids[-1] <= ids[-2]
        if name == "near_dedup":
            least = brute_components([(d, rows[d]) for d in sorted(ids[-2])])
            assert ids[-1] == {d for d, _, component in least if d == component}
        if name == "substring_dedup":
            before = brute_repeats([(d, rows[d]) for d in sorted(ids[-2])], 13)
            want = {d: k if g else rows[d] for d, n, g, _, k in before if not n or g < n}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    assert ids[1] == {d for d, t in rows.items() if language.words_of(t)}
    groups = collections.defaultdict(list)
    for d in ids[1]:
        groups[rows[d]].append(d)
    assert ids[2] == {max(g) for g in groups.values()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    whole = corpus_pipeline.run(spark, sf)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    one = sorted(tuple(r[k] for k in keys) for r in packed.collect())
    assert one == sorted(tuple(r[k] for k in keys) for r in whole.collect())
    assert {r[0] for r in one} == ids[-1]


def test_stages_on_odd_rows(spark, sf, odd, repeated, empty):
    for docs in (odd, repeated, empty):
        own = columns(docs)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, sf), "odd-stage")
            assert columns(docs) == own
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_chains_side_by_side(spark, sf, documents):
    """Two chains do not delete each other's tables, and a lazy chain deletes none of its own."""
    stages = dict(corpus_pipeline.STAGES)
    one, two = documents.where("doc_id % 2 = 0"), documents.where("doc_id % 2 = 1")
    a = stages["exact_dedup"](spark, one, sf)
    b = stages["exact_dedup"](spark, two, sf)
    n = b.count()
    kept = a.count()
    assert 0 < kept <= one.count() and 0 < n <= two.count()
    c, d = written(a, "a"), written(b, "b")
    near = stages["near_dedup"](spark, c, sf)  # deletes what chain one read before
    assert b.count() == n and d.count() == n and near.count() <= kept
    lazy = stages["substring_dedup"](spark, stages["near_dedup"](spark, d, sf), sf)
    assert lazy.count() == lazy.count() > 0
    assert near.count() <= kept


def test_tables_of_a_finished_stage_go(spark, sf, documents):
    from tidemark.sources.paths import exists

    stages = dict(corpus_pipeline.STAGES)
    first = stages["exact_dedup"](spark, documents, sf)
    named = first.schema["doc_id"].metadata[corpus_pipeline.TABLES]
    assert named and all(exists(spark, f) for f in named)
    stages["near_dedup"](spark, written(first, "first"), sf)
    assert not any(exists(spark, f) for f in named)


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in CATALOG if n != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in CATALOG
