"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


def components(links: DataFrame) -> DataFrame:
    """``a, b`` links of any comparable type to ``node, root``: the least node that is reachable.

    Rounds of "link all larger neighbours to the least one", then the same with smaller ones;
    the number of rounds grows with the logarithm of the longest chain, and a node with many
    links is spread by the join's skew handling and folded before the shuffle.
    """
    now = written(links.where("a <> b").select("a", "b").distinct(), "links")
    while True:
        least = _both(now).groupBy("a").agg(F.min("b").alias("m"))
        root = F.least("a", "m")
        large = _both(now).where("b > a").join(least.select("a", root.alias("m")), "a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = written(small, "links")
        # done when every node hangs on one root that hangs on nothing
        heads = new.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if not heads.where("n > 1").take(1) and not new.join(
            new.select(F.col("a").alias("b")), "b", "left_semi"
        ).take(1):
            roots = new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        now = new


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
