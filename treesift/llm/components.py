"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is a partial minimum and a join, and its edges are checkpointed. A node with very many neighbours would bring
them all into one task of the join: nodes with at least 1 / HUBS of all edge ends, of which there are HUBS at most, get their minimum
by broadcast instead. A table of up to SMALL edges has no such task. A component's label is its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import checkpointed

#: Nodes that are told their minimum by broadcast at most, and edges up to which none are.
HUBS, SMALL = 10_000, 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def _with_least(ends: DataFrame, n: int) -> DataFrame:
    """ends(u, v) with m, the smallest v of each u; n is about how many rows there are."""
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("u", "w")
    if n <= SMALL:
        return ends.join(least.drop("degree"), F.col("u") == F.col("w")).select("u", "v", "m")
    bar = n / HUBS
    hubs = least.where(F.col("degree") >= bar).select(F.col("w").alias("hub"), F.col("m").alias("hub_m"))
    marked = ends.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    others = marked.where("hub is null").select("u", "v").join(least.where(F.col("degree") < bar).drop("degree"), F.col("u") == F.col("w"))
    return marked.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(others.select("u", "v", "m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link each node's larger neighbours to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down, n)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v) but the components' smallest nodes themselves."""
    now = checkpointed(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        now = checkpointed(_small_star(_large_star(now, state[0]), state[0]))
        then, state = state, _state(now)
        if state == then:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
