"""Connected components of a graph of links, by alternating large and small stars.

No node's neighbours are collected: every step is a minimum by node (added up before the shuffle) and
a join on the node, which adaptive execution splits where one node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a file of edges, and files at least, so that few edges don't lie in as many files as a shuffle has partitions.
PART_ROWS, PARTS = 500_000, 8


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is its component's least node.

    Nulls link nothing; repeated edges and loops are harmless; no edge gives no row.
    """
    edges = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/edges-0")
    parts = max(PARTS, edges.count() // PART_ROWS)  # as many files as the edges need; a step never makes more edges than it has
    kept = lambda df, name: written(df.coalesce(parts), f"{folder}/{name}")
    sign, step = None, 0
    while True:
        # large star: each neighbour above a node is tied to the least of the node and its neighbours
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"least-{step}")
        edges = kept(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"edges-{step}")
        # small star: a node and its neighbours below are tied to the least of these
        step += 1
        least = kept(edges.groupBy("u").agg(F.min("v").alias("m")), f"least-{step}")
        tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = kept(tied.where("u <> v").distinct(), f"edges-{step}")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == sign:
            break
        sign = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
