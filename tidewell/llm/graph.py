"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps.

Each step groups the edges by a node and joins the node's smallest neighbour back, so a node
with very many edges is pre-aggregated before the shuffle and split at run time in the join.
The edge table is written to the shared folder after each round; only counts and sums reach
the driver, and nothing is broadcast from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import settle, shuffled


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: distinct (u, v) with u > v. Large star: neighbours above a node go to its smallest neighbour; small star: a node and its smaller neighbours do."""
    if large:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        found = both.where("b > a").join(shuffled(least), "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        found = edges.join(shuffled(least), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return found.where("u > v").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node that has an edge; component: its smallest reachable node. Self-loops and repeats don't matter."""
    now = settle(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct(), "edges"
    )
    sign = None
    while True:
        new = settle(_star(_star(now, True), False), "edges")
        got = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (got["n"], got["s"]) == sign or not got["n"]:
            break
        now, sign = new, (got["n"], got["s"])
    stars = new
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
