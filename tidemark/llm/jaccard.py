"""Word-shingle Jaccard join by T-occurrence search, without writing down pairs of copies.

1. Shingle sets are hashed; each bundle of documents sends its distinct hashes to hash ranges and
   learns in how many documents each occurs.
2. A document can only link when enough of its shingles occur elsewhere; equal sets become one
   class. Classes are put into blocks by the shingles of their prefix in order of frequency:
   two sets over the threshold share one of them.
3. Blocks are cut into units of bounded size by length and hash. Inside a unit DivideSkip finds,
   for one query after the other, all documents with the required overlap. Documents that are
   already connected need no query of their own, so thousands of copies cost a few queries.
4. Between units of one block first one document per unit and component is asked, then every
   document outside the block's largest component. Any two unconnected documents of different
   units thus meet, whatever the size of the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared as S
from tidemark.llm.links import components
from tidemark.llm.shared import discard
from tidemark.session import written

WORDS = 5
NEED, OF = 80, 100
RANGE_BYTES = 8 << 20
LEAST_RANGES = 64
#: Classes in a unit, and shingles of all its classes: whichever makes the smaller unit.
UNIT = 2000
UNIT_SHINGLES = 1_000_000


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; one for a text with fewer words, none without."""
    hashes = S.hash_words(text.lower().split())
    if not len(hashes):
        return hashes
    return np.unique(S.window_hashes(hashes, min(words, len(hashes))))


def least_overlap(size: int) -> int:
    """Shingles a set must share with any set it links to."""
    return S.ceil_div(NEED * size, OF)


class Bundle:
    """Shingles of a bundle's documents, and its distinct ones with their document counts."""

    def __init__(self, row: dict, words: int):
        self.sets = [shingles(t, words) for t in S.bundle_texts(row["size"], row["body"])]
        every = np.concatenate(self.sets or [np.empty(0, np.uint64)])
        self.keys, self.place, count = np.unique(every, return_inverse=True, return_counts=True)
        self.count = np.minimum(count, 65535).astype(np.uint16)

    def ranges(self, parts: int) -> Iterator[tuple[int, slice]]:
        return S.ranges(self.keys, parts)


SENT_DDL = "part int, bundle long, keys binary, count binary"
ANSWER_DDL = "bundle long, part int, answer binary"


def _send(words: int, parts: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Bundle(row, words)
                # 48 bits are enough to count by; a chance match only lets a document go on
                rows = [
                    (part, row["bundle"], S.pack_sorted(own.keys[cut] >> np.uint64(16)),
                     S.pack(own.count[cut]))
                    for part, cut in own.ranges(parts)
                ]
                if rows:
                    yield S.record(rows, SENT_DDL)

    return run


def _counts(table: pa.Table) -> pa.Table:
    """One hash range: documents per shingle over all bundles, capped only in how it is told."""
    rows = table.to_pylist()
    keys = [S.unpack_sorted(r["keys"]) for r in rows]
    count = np.concatenate([S.unpack(r["count"], np.uint16) for r in rows]).astype(np.int64)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    total = np.minimum(np.add.reduceat(count[order], np.flatnonzero(new)), 65535)
    found = np.empty(len(every), np.uint16)
    found[order] = total[np.cumsum(new) - 1]
    out, at = [], 0
    for row, k in zip(rows, keys):
        out.append((row["bundle"], row["part"], S.pack(found[at : at + len(k)])))
        at += len(k)
    return pa.Table.from_batches([S.record(out, ANSWER_DDL)])


SET_DDL = "doc_id long, n_shingles long, class binary, tokens binary, prefix array<long>"


def _sets(words: int, parts: int):
    """Per document its set's size and class; the set itself only where it can link."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Bundle(row, words)
                frequency = np.zeros(len(own.keys), np.int64)
                got = {a["part"]: a["answer"] for a in row["answers"] or []}
                for part, cut in own.ranges(parts):
                    frequency[cut] = S.unpack(got[part], np.uint16)
                rows, at, told = [], 0, set()
                for doc_id, tokens in zip(row["doc_id"], own.sets):
                    n = len(tokens)
                    often = frequency[own.place[at : at + n]]
                    at += n
                    name = xxhash.xxh3_128_digest(tokens.tobytes()) if n else None
                    repeated = often > 1
                    if not n or int(repeated.sum()) < least_overlap(n) or name in told:
                        rows.append((doc_id, n, name, None, None))
                        continue
                    told.add(name)
                    first = np.lexsort((tokens, often))[: n - least_overlap(n) + 1]
                    prefix = tokens[first][repeated[first]].view(np.int64)
                    rows.append((doc_id, n, name, S.pack_sorted(tokens), prefix.tolist()))
                for k in range(0, len(rows), 500):
                    yield S.record(rows[k : k + 500], SET_DDL)

    return run


class Unit:
    """Inverted lists of some sets, searched with DivideSkip."""

    MU = 0.01

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets or [np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.tokens, self.start = np.unique(every[order], return_index=True)
        self.end = np.append(self.start[1:], len(every))

    def links(self, query: np.ndarray) -> np.ndarray:
        """All sets at the threshold with the query."""
        if not len(query) or not len(self.tokens):
            return np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        place = place[self.tokens[place] == query]
        need = least_overlap(len(query))
        if len(place) < need:
            return np.empty(0, np.int64)
        length = self.end[place] - self.start[place]
        place = place[np.argsort(length, kind="stable")]
        # DivideSkip: so many of the longest lists are probed instead of merged
        longest = int(length.max())
        long = min(need - 1, int(need / (self.MU * math.log2(longest + 1) + 1)))
        cut = len(place) - long
        merged = np.concatenate([self.owner[self.start[p] : self.end[p]] for p in place[:cut]])
        merged.sort(kind="stable")  # merges the sorted runs
        found, count = np.unique(merged, return_counts=True)
        keep = count >= need - long
        found, count = found[keep], count[keep]
        for k, p in enumerate(place[cut:]):
            if not len(found):
                break
            own = self.owner[self.start[p] : self.end[p]]
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            count = count + (own[at] == found)
            keep = count >= need - (long - 1 - k)
            found, count = found[keep], count[keep]
        union = len(query) + self.sizes[found] - count
        return found[OF * count >= NEED * union]


class Forest:
    """Union-find over whatever names the documents' components."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def connect_unit(names: list, sets: list[np.ndarray]) -> list[tuple]:
    """Links that connect all that is connected in a unit.

    A query finds every partner. Once all documents that were not asked are in one component,
    no unknown link can connect anything.
    """
    unit, forest, links = Unit(sets), Forest(), []
    waiting = set(range(len(sets)))
    turn = 0
    while waiting:
        if turn:
            roots = {i: forest.root(i) for i in waiting}
            groups: dict[int, int] = {}
            for r in roots.values():
                groups[r] = groups.get(r, 0) + 1
            if len(groups) == 1:
                break
            most = max(groups, key=groups.get)
            asked = [i for i in sorted(waiting) if roots[i] != most][: 1 << min(turn, 10)]
        else:
            asked = [0]
        turn += 1
        for i in asked:
            waiting.discard(i)
            for j in unit.links(sets[i]).tolist():
                if forest.join(i, j):
                    links.append((names[i], names[j]))
    return links


def connect_across(names, sets, roots, asked) -> list[tuple]:
    """Links from queries ``(name, set, root)`` to a unit's documents in other components."""
    unit, forest, links = Unit(sets), Forest(), []
    groups = set(roots)
    for name, query, root in asked:
        here = {forest.root(r) for r in groups}
        if here == {forest.root(root)}:
            continue
        for j in unit.links(query).tolist():
            if forest.join(root, roots[j]):
                links.append((name, names[j]))
    return links


LINK_DDL = "a binary, b binary"


def _cuts():
    """Units that a group of classes is dealt over."""
    wide = F.ceil(F.sum("n_shingles") / UNIT_SHINGLES)
    return F.greatest(F.ceil(F.count(F.lit(1)) / UNIT), wide).cast("int")


def _inside(table: pa.Table) -> pa.Table:
    links = connect_unit(
        table.column("class").to_pylist(),
        [S.unpack_sorted(t) for t in table.column("tokens").to_pylist()],
    )
    return pa.Table.from_batches([S.record(links, LINK_DDL)])


def _across(held: pa.Table, asked: pa.Table) -> pa.Table:
    links = []
    if held.num_rows and asked.num_rows:
        queries = zip(
            asked.column("q_class").to_pylist(),
            (S.unpack_sorted(t) for t in asked.column("q_tokens").to_pylist()),
            asked.column("q_root").to_pylist(),
        )
        links = connect_across(
            held.column("class").to_pylist(),
            [S.unpack_sorted(t) for t in held.column("tokens").to_pylist()],
            held.column("root").to_pylist(),
            queries,
        )
    return pa.Table.from_batches([S.record(links, LINK_DDL)])


def _ask(units: DataFrame, asking: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Classes against the other units that can hold a link of theirs.

    Linked sets share a token of their prefixes and have fitting lengths, so a class goes only
    to units where a set of such a length has one of its prefix tokens in its own prefix. The
    classes for a unit go in groups of bounded size; each group meets it in a task of its own.
    """
    there = prefixes.select(
        "token", F.col("unit").alias("to"), F.col("bin").alias("to_bin")
    ).distinct()
    routes = written(
        prefixes.join(asking.select("class"), "class", "left_semi")
        .join(there, "token")
        .where((F.col("to") != F.col("unit")) & (F.abs(F.col("to_bin") - F.col("bin")) <= 1))
        .select("class", "to")
        .distinct(),
        "jaccard-routes",
    )
    groups = routes.join(units.select("class", "n_shingles"), "class").groupBy("to").agg(_cuts().alias("k"))
    dealt = routes.join(groups, "to").select(
        "class", F.col("to").alias("q_unit"), F.expr("pmod(xxhash64(class), k)").alias("q_part")
    )
    asked = dealt.join(units.select("class", "tokens", "root"), "class").select(
        "q_unit",
        "q_part",
        F.col("class").alias("q_class"),
        F.col("tokens").alias("q_tokens"),
        F.col("root").alias("q_root"),
    )
    targets = dealt.select(F.col("q_unit").alias("unit"), F.col("q_part").alias("part")).distinct()
    held = units.join(targets, "unit").select("unit", "part", "class", "tokens", "root")
    links = held.groupBy("unit", "part").cogroup(asked.groupBy("q_unit", "q_part")).applyInArrow(
        S.settled(_across), LINK_DDL
    )
    links = written(links, "jaccard-found")
    discard(routes)
    return links


def _rooted(units: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links).withColumnRenamed("node", "class")
    return units.drop("root").join(roots, "class", "left").withColumn(
        "root", F.coalesce("root", "class")
    )


def _class_links(sets: DataFrame) -> DataFrame:
    """Links ``a, b`` between classes that connect all that is connected."""
    able = sets.where("tokens is not null").dropDuplicates(["class"])
    able = written(able.select("class", "n_shingles", "tokens", "prefix"), "jaccard-able")
    entries = able.select("class", F.explode("prefix").alias("token"))
    heads = entries.groupBy("token").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("n"))
    meets = (
        entries.join(heads.where("n > 1"), "token")
        .where(F.col("class") != F.col("head"))
        .select(F.col("class").alias("a"), F.col("head").alias("b"))
        .distinct()
    )
    blocks = components(meets).select(F.col("node").alias("class"), F.col("root").alias("block"))
    step = math.log(OF / NEED)
    lengths = F.floor(F.log("n_shingles") / F.lit(step)).alias("bin")
    placed = able.join(blocks, "class").select("class", "n_shingles", "tokens", "block", lengths)
    counted = placed.groupBy("block", "bin").agg(_cuts().alias("cuts"))
    unit = F.concat_ws(":", F.hex("block"), "bin", F.expr("pmod(xxhash64(class), cuts)"))
    units = written(
        placed.join(counted, ["block", "bin"]).select(
            "class", "n_shingles", "tokens", "block", "bin", unit.alias("unit"),
            F.col("class").alias("root"),
        ),
        "jaccard-units",
    )
    links = written(units.groupBy("unit").applyInArrow(S.settled(_inside), LINK_DDL), "jaccard-links")
    many = units.groupBy("block").agg(F.countDistinct("unit").alias("n")).where("n > 1")
    spread = units.join(many.select("block"), "block")
    if not spread.take(1):
        discard(able, units)
        return links
    dealt = spread.select("class", "unit", "bin")
    prefixes = written(entries.join(dealt, "class"), "jaccard-prefixes")
    rooted = written(_rooted(spread, links), "jaccard-rooted")
    firsts = rooted.groupBy("unit", "root").agg(F.min("class").alias("class"))
    links = links.unionByName(_ask(rooted, firsts, prefixes))
    discard(rooted)
    rooted = written(_rooted(spread, links), "jaccard-rooted")
    sizes = rooted.groupBy("block", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("block").agg(F.max(F.struct("n", "root")).alias("x"))
    main = largest.select(F.col("x.root").alias("root"))
    others = rooted.select("class", "root").join(main, "root", "left_anti")
    links = links.unionByName(_ask(rooted, others, prefixes))
    discard(able, units, rooted, prefixes)
    return links


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    A document's set is its distinct shingles of ``words`` words, A-Z in lower case; with fewer
    words the whole sequence, without words (or with null text) none. Documents link when
    100 * intersection >= 80 * union. component_id is the least doc_id that links reach, the
    document's own if it links to nothing; empty sets link to nothing. A null doc_id is never
    the least unless the whole component has none.
    """
    held = written(S.bundles(docs), "jaccard-bundles")
    parts = S.parts_for(S.bytes_of(held), RANGE_BYTES, LEAST_RANGES)
    counts = held.mapInArrow(S.settled(_send(words, parts)), SENT_DDL).groupBy("part")
    answers = counts.applyInArrow(S.settled(_counts), ANSWER_DDL)
    collected = answers.groupBy("bundle").agg(
        F.collect_list(F.struct("part", "answer")).alias("answers")
    )
    sets = held.join(collected, "bundle", "left").mapInArrow(S.settled(_sets(words, parts)), SET_DDL)
    sets = written(sets, "jaccard-sets")
    discard(held)
    roots = components(_class_links(sets)).withColumnRenamed("node", "class")
    classes = (
        sets.where("class is not null")
        .groupBy("class")
        .agg(F.min("doc_id").alias("least"))
        .join(roots, "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("class", "component_id")
    return sets.select("doc_id", "n_shingles", "class").join(named, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` without the documents that hang on one with a smaller doc_id.

    Rows without a doc_id stay; rows that repeat a doc_id stay or go together.
    """
    gone = near_duplicates(docs.where("doc_id is not null"), words)
    (name,) = S.fresh(docs, "gone")
    gone = gone.where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
