"""Merkle manifest of a table: every node is labelled with the leaf ranks that it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import checked
from tidemark.llm.shared import ascii_lower
from tidemark.session import written

RUN = 16
DIGEST = 64
PATH = "array<struct<left:string,right:string>>"


def field(value):
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaves(docs: DataFrame, altered=None) -> DataFrame:
    """``tree, doc_id, leaf, other`` per row: its digest, and that of its text with A-Z lower-cased
    where ``altered`` holds (null elsewhere). ``tree`` is the source with a mark before it, so
    that null comes first and is a tree like any other."""
    held = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "n_chars", "text")],
    )
    head = F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")])
    digest = lambda text: F.sha2(F.concat(head, field(text)), 256)
    other = F.lit(None).cast("string")
    if altered is not None:
        other = F.when(altered & F.col("text").isNotNull(), digest(ascii_lower(F.col("text"))))
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), "source"))
    return held.select(
        tree.alias("tree"), "doc_id", digest(F.col("text")).alias("leaf"), other.alias("other")
    )


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``lo``, the rank within ``tree`` by ``order``, and ``n``, the rows of the tree.

    Rows are dealt over ranges of (tree, order), so a large tree fills many tasks. A row's place
    in its range is written with it; ranks add the rows of the tree in earlier ranges, which is
    one small row a tree and range.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    spans = dealt.groupBy("tree", "part").agg(
        F.count(F.lit(1)).alias("held"), F.min("at").alias("first")
    )
    tree = Window.partitionBy("tree")
    spans = spans.select(
        "tree",
        "part",
        "first",
        (F.sum("held").over(tree.orderBy("part")) - F.col("held")).alias("earlier"),
        F.sum("held").over(tree).alias("n"),
    )
    spans = written(spans, f"{name}-spans")
    return dealt.join(checked(spans), ["tree", "part"]).select(
        *rows.columns, (F.col("at") - F.col("first") + F.col("earlier")).alias("lo"), "n"
    )


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The levels above leaves ``tree, lo, n, leaf``: ``tree, lo, hi, n, run, digest`` each.

    A node covers the ranks from ``lo`` to before ``hi``; ``run`` holds its children's digests
    side by side. A tree ends at the level where one node covers all its ranks. No group has
    more than 16 rows, and every level is a sixteenth of the one below.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    now = nodes.select("tree", "lo", (F.col("lo") + 1).alias("hi"), "n", F.col("leaf").alias("digest"))
    out, width = [], 1
    while width < most:
        now = now.where(F.col("n") > width)
        width *= RUN
        runs = now.groupBy("tree", F.floor(F.col("lo") / width).alias("bucket")).agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.max("n").alias("n"),
            F.sort_array(F.collect_list(F.struct("lo", "digest"))).alias("children"),
        )
        runs = runs.withColumn("run", F.array_join(F.col("children.digest"), ""))
        now = written(
            runs.select("tree", "lo", "hi", "n", "run", F.sha2("run", 256).alias("digest")), name
        )
        out.append(now)
    return out


def roots(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of the nodes that cover a whole tree; a lone leaf is its own root."""
    out = nodes.where("n = 1").select("tree", F.col("leaf").alias("digest"))
    for level in above:
        out = out.unionByName(level.where("hi - lo = n").select("tree", "digest"))
    return out


def _contained(children: DataFrame, parents: DataFrame, width: int) -> DataFrame:
    """Each child with the path of its parent and its own siblings before that.

    A child meets the one parent whose bucket of ranks it lies in and whose interval contains
    its own. What the parent's interval has beyond the child's, [lo, child lo) and [child hi,
    hi), are the siblings on the left and on the right.
    """
    child = width // RUN
    named = parents.withColumnsRenamed({"tree": "p_tree", "lo": "p_lo", "hi": "p_hi", "run": "p_run"})
    named = named.drop("n", "digest").withColumn("p_bucket", F.floor(F.col("p_lo") / width))
    inside = (
        (F.col("tree") == F.col("p_tree"))
        & (F.floor(F.col("lo") / width) == F.col("p_bucket"))
        & (F.col("p_lo") <= F.col("lo"))
        & (F.col("hi") <= F.col("p_hi"))
    )
    left = F.floor((F.col("lo") - F.col("p_lo")) / child).cast("int")
    right = F.ceil((F.col("p_hi") - F.col("hi")) / child).cast("int")
    beside = F.struct(
        F.substr("p_run", F.lit(1), left * DIGEST).alias("left"),
        F.substr("p_run", F.length("p_run") - right * DIGEST + 1, right * DIGEST).alias("right"),
    )
    held = children.join(named, inside).withColumn("path", F.concat(F.array(beside), F.col("path")))
    return held.drop("p_tree", "p_lo", "p_hi", "p_run", "p_bucket")


def descend(nodes: DataFrame, above: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes`` with ``path``, the siblings of each level from the leaf's to the root's.

    ``tops`` (tree, path, ...) is what lies above each tree's root; its columns go down to the
    leaves. Level by level from the top, nodes join the level above by containment.
    """
    held = None
    for level in reversed(range(len(above) + 1)):
        width = RUN**level
        here = above[level - 1] if level else nodes.withColumn("hi", F.col("lo") + 1)
        ends = here.where(F.col("n") <= width).join(tops, "tree")
        if held is not None:
            ends = ends.unionByName(_contained(here.where(F.col("n") > width), held, width * RUN))
        held = ends
    return held


def manifest(docs: DataFrame, altered=None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, other, subroot, root, path``.

    Leaves are digests of (doc_id, source, lang, n_chars, text); every source is a tree over its
    leaves by doc_id, in runs of 16, and the sources' roots, null first, are the leaves of one
    more. ``path`` lists the siblings' digests left and right of the way to the root. ``other``
    is the leaf's digest where ``altered`` (a condition) holds and the text has been lower-cased.

    Null fields are marked in the leaf; rows without doc_id come first in their source. Rows
    that repeat a doc_id are leaves of their own, ordered by digest; equal rows have equal
    leaves. An empty table gives no rows.
    """
    held = written(leaves(docs, altered), "leaves")
    nodes = ranked(held, ["doc_id", "leaf"], "ranked-leaves")
    above = levels(nodes, "level")
    sources = roots(nodes, above).select(
        F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("leaf")
    )
    sources = ranked(written(sources, "subroots"), ["name"], "ranked-subroots")
    over = levels(sources, "top-level")
    root = roots(sources, over).select("tree", F.col("digest").alias("root"))
    top = root.withColumn("path", F.array().cast(PATH))
    tops = descend(sources, over, top).select(
        F.col("name").alias("tree"), F.col("leaf").alias("subroot"), "root", "path"
    )
    tops = written(tops, "tops")
    return descend(nodes, above, tops).select("doc_id", "leaf", "other", "subroot", "root", "path")


def proof_text():
    """All siblings of a path, left to right, level by level."""
    return F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf):
    """The root that follows from a leaf's digest and the siblings of its path."""
    return F.aggregate(
        "path", leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256)
    )
