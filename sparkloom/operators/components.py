"""Connected components by alternating large-star and small-star rounds: joins and grouped minima only.

Each round is written to the shared folder and takes the place of the one before, so lineage stays
short and a lost executor costs one round. Every grouping is a minimum, which Spark adds up before the shuffle, so a hub with a third of
all edges is one row per task; the joins back to a hub's edges are plain equi-joins that adaptive
execution can split. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.storage import materialise

MAX_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the least node reachable.

    Edges with a null end are dropped; loops and repeated edges are harmless; no edges give no rows.
    """
    found = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    loops = found.where(F.col("u") == F.col("v")).select(F.col("u").alias("node"), F.col("u").alias("component"))
    now = materialise(found.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == mark or state[0] == 0:
            break
        mark = state
        now = materialise(_small_star(_large_star(now).distinct()).distinct(), "edges", instead_of=(now,))
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))
