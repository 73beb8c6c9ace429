"""Connected components of a distributed edge table by alternating large-star and small-star steps.

No task ever holds a whole neighbourhood: minima are pre-aggregated, and the joins that carry them back are plain
equi-joins whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs to (node, component): for each node that has an edge the smallest node it reaches.

    Self-loops are ignored; no edges give no rows; repeated edges count once.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    before = e.agg(mark).first()[0]
    while before["n"]:
        after = written(_small_star(_large_star(e)))
        discard(e)
        e, now = after, after.agg(mark).first()[0]
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
