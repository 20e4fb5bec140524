"""Connected components of a table of links, by alternating star contraction.

A large-star step ties every node to the smallest node around it for the larger ones of its neighbours, a small-star
step for the smaller ones; when nothing changes, every component is one star around its smallest node. Each step is one
aggregation (folded before its shuffle) and one join on the node, which adaptive execution may split where one node has
many links. Every round is written to the shared folder, so a lost executor never repeats more than a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.llm.tables import keep


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF)).alias("s")).first()
    return tuple(row)


def _star(pairs: DataFrame) -> DataFrame:
    """For pairs ``(u, v)``: the smallest of each ``u`` and its ``v``, next to every pair."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (columns ``u``, ``v``); a component is named by its smallest node.

    Links of a node with itself and repeated links change nothing; an empty table gives an empty result.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = keep(edges, "links")
    state = _fingerprint(edges)
    while state[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        starred = _star(down)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v")))
        edges = keep(small.where("u <> v").distinct(), "links")
        before, state = state, _fingerprint(edges)
        if before == state:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
