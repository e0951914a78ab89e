"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletry.session import stage


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Every neighbour of a node is tied to the smallest node of its neighbourhood.

    The minimum is combined before the shuffle and joined back, so a node with very many
    neighbours is never gathered in one place and the join can be split.
    """
    if both_ways:
        near = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = near.join(least, "u")
    if both_ways:
        tied = tied.where("v > u")
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its smallest node.

    Edges with a null end and loops are left out; repeated edges count once. Every round is written
    to the shared folder, so a lost executor costs one round at most.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = stage(edges, "edges")
    state = None
    while True:
        edges = stage(_stars(_stars(edges, True), False), "edges")
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if (now["n"], now["s"]) == state:
            break
        state = (now["n"], now["s"])
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops)
