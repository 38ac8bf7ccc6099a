"""Connected components of a table of links, by alternating stars.

Large-star links every larger neighbour of a node to the smallest node known to it,
small-star does so with the smaller ones; in turn they end in one star per component
after a number of rounds that grows with the logarithm of its size.  Every round is
written to the shared folder, which cuts the lineage.  A node with very many links meets its own
minimum (a partial aggregate) in a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize


def _star(both: DataFrame, keep) -> DataFrame:
    """Links each v of (u, v) that ``keep`` holds to, to the smallest of u and its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("m_u"), F.least("u", "v").alias("m"))
    return (both.where(keep).join(least, F.col("u") == F.col("m_u"))
                .select(F.col("v").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; ``links`` has two columns of node
    ids (no nulls).  The root is the component's smallest node."""
    x, y = links.columns
    links = (links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
                  .where("a > b").distinct())
    links = materialize(links, "llm-links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        if not state[0]:
            break
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).where("a != b").distinct()
        # small star: a's smaller neighbours and a itself go to the least of them
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("m_u"), "m")
        small = (down.join(least, F.col("u") == F.col("m_u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
                     .union(least.select(F.col("m_u").alias("a"), F.col("m").alias("b"))))
        links = materialize(small.where("a != b").distinct(), "llm-links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
