"""Connected components by alternating large-star and small-star, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, write


def _toward_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least neighbour of u, or u itself. Minima are combined before the shuffle, and the join has
    one row per u on one side, so that a node with very many neighbours can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _toward_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    near = _toward_minimum(edges)
    return near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the links; component is the least node reachable.

    Links may repeat, point either way, or join a node with itself (then it is listed); those with a null end are ignored.
    Rounds stop when the edges no longer change, after about log squared of the longest path.
    """
    spark = links.sparkSession
    tidy = links.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()
    )
    first = write(tidy.distinct(), "links")
    nodes = spark.read.parquet(first)
    path, before = None, None
    edges = nodes.where("u > v")
    for _ in range(most_rounds):
        new = write(_small_star(_large_star(edges)), "stars")
        edges = spark.read.parquet(new)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if path:
            drop(spark, path)
        path = new
        if state == before or not state["n"]:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return (
        edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(nodes.select(F.col("v").alias("node"), F.col("v").alias("component")).join(edges.select(F.col("u").alias("node")), "node", "left_anti"))
        .distinct()
    )
