"""Connected components of links, by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step is a grouped minimum, combined before the shuffle, and an equi-join that Spark may split where one node has
many links. Nothing is collected; every round's links are written to the shared folder, which ends their lineage.
Defined cases: no links give no rows; a node linked only with itself, or null, is left out; repeated links count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), each once with u > v. large: joins every node's larger neighbours to its least neighbour; else
    every node and its smaller neighbours to the least of them."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    # The write in between leaves the join two plain inputs, so that a node with many links can be split.
    least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least").withColumnRenamed("u", "n")
    step = both.join(least, both["u"] == least["n"])
    if large:
        out = step.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = step.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link with another; root is the component's least node."""
    links = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if not _open(links).limit(1).count():
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        links = saved(_star(saved(_star(links, True), "large"), False), "small")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _open(links: DataFrame) -> DataFrame:
    """Nodes with several roots, or with a root and nodes of their own: none in a forest of stars."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1))
