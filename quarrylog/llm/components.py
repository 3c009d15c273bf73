"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a partially summed groupBy and an equi-join; the links of a node with over HOT of them are dealt to several parts, each of which
gets its own row of the node's least neighbour, so that no task holds them all. Links are written to
the shared folder after each round; the driver sees two numbers a round, never links. Rounds grow with the logarithm of the longest chain.

Nulls: links with a null end are dropped. Repeated links, links of a node with itself and both directions of a link count once. No links
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.common import written

#: Links of a node that one task joins, about.
HOT = 512


def _with_least(links: DataFrame) -> DataFrame:
    """links (a, b) with m, the least b of each a."""
    low = links.groupBy("a").agg(F.min("b").alias("m"), F.ceil(F.count("*") / HOT).cast("int").alias("parts"))
    hot = written(low.where("parts > 1").select(F.col("a").alias("hot"), F.col("parts").alias("among")), "hot-nodes")
    part = F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("among"))).cast("int")
    dealt = links.join(hot, F.col("a") == F.col("hot"), "left").select("a", "b", part.alias("part"))
    least = low.select("a", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(least, ["a", "part"]).select("a", "b", "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # a node's link to its least neighbour stays; its other neighbours link to that
    return _with_least(down).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b. Gives a row (node, root) for each node that has a link and isn't its root; root is the least node."""
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark == state or mark["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = mark
        now = written(_small_star(_large_star(now)), "links")
