"""Connected components as joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm import scratch


def _pull(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its partners; partners are stored first so that both sides of
    the join are plain shuffles, which adaptive execution can split at a hub."""
    least = scratch.table(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (columns u, v; longs): root is the least node that
    can be reached. Edges from a node to itself and repeated edges do no harm; no edges, no rows.
    Each round is written to the shared folder."""
    edges = (edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
             .where("u <> v").distinct())
    edges = scratch.table(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_pull(both).where("v > u and v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = scratch.table(large, "large")
        pulled = _pull(large)
        small = (pulled.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(pulled.select("u", F.col("m").alias("v"))).distinct())
        edges = scratch.table(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
            .distinct())
