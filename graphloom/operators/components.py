"""Connected components of an edge table, by star contraction over DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def components(edges: DataFrame, most_rounds: int = 60, checkpoint: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the component's smallest node.

    Each round links every node's larger neighbours to its smallest neighbour (large star), then every node's
    smaller neighbours to the smallest one (small star), until no edge changes; rounds grow with the
    logarithm of a component's size.  Edges are made distinct, with partial aggregation, before each
    exchange, and a node's smallest neighbour is found by a partially aggregated minimum, so a hub's edges
    never meet in one task.  Null ends and loops are left out.
    """
    spark = edges.sparkSession
    with Scratch(spark, checkpoint) as scratch:
        now = scratch.cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "r0")
        seen = None
        for k in range(1, most_rounds + 1):
            large = star(now, larger=True)
            small = star(large, larger=False)
            now = scratch.cut(small, f"r{k}")
            mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            scratch.drop(f"r{k - 1}")
            if mark == seen:
                break
            seen = mark
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        return scratch.keep(ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct()))


def star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a > b) after a large or small star."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    # The hash as a second key makes both sides exchange, so that adaptive execution can split a hub's edges.
    same = (F.xxhash64("a") == F.xxhash64("n")) & (F.col("a") == F.col("n"))
    if larger:
        moved = both.where("b > a").join(least, same).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = edges.join(least, same).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
