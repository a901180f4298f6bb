"""Connected components of an edge table by alternating large-star and small-star steps.

(Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014.)
Every step is a partial-combined ``min`` per node and a join back, so a node with
very many links is never gathered in one task; each round's edges are written to
the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component: the smallest node reachable) for every node of ``edges(u, v)``; self-loops are ignored."""
    e, path = scratch.save_replacing(edges.where("u != v").select("u", "v").distinct(), "edges", None)
    seen = _mark(e)
    while seen[0]:
        e, path = scratch.save_replacing(_small_star(_large_star(e)), "edges", path)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
