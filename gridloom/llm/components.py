"""Connected components of an edge list, as DataFrame rounds (large-star and small-star).

Edges with one end in common meet by a join on that end with the end's smallest neighbour; no neighbour list is
ever gathered, so a hub of a third of all edges is only a skewed join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import saved

MOST_ROUNDS = 60


def _pairs(a: str, b: str) -> list:
    return [F.col(a).alias("u"), F.col(b).alias("v")]


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(*_pairs("v", "u")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(*_pairs("v", "m")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Edges run from larger u to smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").filter("v > m").select(*_pairs("v", "m"))
    return linked.unionByName(least.select(*_pairs("u", "m"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with an edge; the component is its smallest node.

    ``edges`` has two columns of one orderable type. Self loops and rows with a null end are left out.
    """
    a, b = edges.columns[:2]
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = saved(ends.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    state = _state(current)
    for _ in range(MOST_ROUNDS):
        if state[0] == 0:
            break
        after = saved(small_star(large_star(current)))
        new = _state(after)
        if new == state:
            break
        current, state = after, new
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
