"""PageRank, tournaments and their ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import iterate
from ..session import Scratch
from .graphs import deduplicated, nodes_of, normalized


def pagerank(edges: DataFrame, iterations: int, damping: float = 0.85, eps: float = 0.0, nodes: DataFrame | None = None) -> DataFrame:
    """(id, score): r = (D + d * sum of r p + (1 - d) / n) / sum, D the mass of nodes without edges over n.

    The sum is known in advance, 1 + m (1 - d) with m the dead mass, so a step is one join and one aggregation.
    Ends when the step's L2 norm is below ``eps``.
    """
    with Scratch(edges.sparkSession, "rank") as scratch:
        edges = scratch.cut(edges.select("src", "dst", "p"), "edges")  # built once; every step reads it
        return _pagerank(edges, iterations, damping, eps, scratch.cut((nodes if nodes is not None else nodes_of(edges)).select("id"), "nodes"))


def _pagerank(edges: DataFrame, iterations: int, damping: float, eps: float, nodes: DataFrame) -> DataFrame:
    n = nodes.count()
    live = edges.select(F.col("src").alias("id")).distinct().withColumn("_live", F.lit(True))
    base = nodes.join(live, "id", "left").select("id", F.coalesce("_live", F.lit(False)).alias("live"))
    hops = edges.select("src", "dst", "p").repartition("src").cache()

    def step(now: DataFrame, _: int) -> DataFrame:
        dead = now.where("not live").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("_m"))  # one row
        flow = hops.join(now.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("p")).alias("f"))
        y = F.col("_m") / n + F.coalesce("f", F.lit(0.0)) * damping + F.lit((1 - damping) / n)
        return now.select("id", "live").join(flow, "id", "left").crossJoin(F.broadcast(dead)).select("id", "live", (y / (1 + F.col("_m") * (1 - damping))).alias("score"))

    def settled(a: DataFrame, b: DataFrame) -> bool:
        return a.select("id", F.col("score").alias("_o")).join(b, "id").agg(F.sqrt(F.sum(F.pow(F.col("score") - F.col("_o"), 2))).alias("d")).first().d < eps

    out = iterate(base.withColumn("score", F.lit(1.0 / max(1, n))), step, iterations, settled if eps > 0 else None).select("id", "score")
    hops.unpersist()
    return out


def tournament(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, norms) of (winner, loser, weight): edges from loser to winner of half the weight; norms 1 plus half of what a node lost."""
    edges = normalized(deduplicated(outcomes.select(F.col("loser").alias("src"), F.col("winner").alias("dst"), (F.col("weight") / 2).alias("weight"))))
    both = F.array(F.struct(F.col("loser").alias("id"), (F.col("weight") / 2).alias("lost")), F.struct(F.col("winner").alias("id"), F.lit(0.0).alias("lost")))
    norms = outcomes.select(F.explode(both).alias("o")).groupBy(F.col("o.id").alias("id")).agg((1 + F.coalesce(F.sum("o.lost"), F.lit(0.0))).alias("norm"))
    return edges, norms


def ranked_outcomes(lists: DataFrame, weight: float = 1.0) -> DataFrame:
    """(winner, loser, weight) of every pair of an ordered ``items`` array, the earlier one wins."""
    pairs = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("winner"), y.alias("loser")))))
    return lists.select(F.explode(pairs).alias("o")).select("o.winner", "o.loser", F.lit(weight).alias("weight"))


def luce(edges: DataFrame, norms: DataFrame, passes: int, eps: float = 1e-8) -> DataFrame:
    """(id, score): log of undamped PageRank over norm, centred."""
    pr = pagerank(edges, passes, 1.0, eps)
    s = pr.join(norms, "id").withColumn("s", F.when(F.col("score") > 0, F.log(F.col("score") / F.col("norm"))))
    return s.crossJoin(s.agg(F.avg("s").alias("_m"))).select("id", (F.col("s") - F.col("_m")).alias("score"))


def dense_rank_labels(parts: DataFrame) -> DataFrame:
    """(id, label): components numbered 1, 2, ... by their smallest node: within ranges of nodes, and by the number of components before each range."""
    with Scratch(parts.sparkSession, "labels") as scratch:
        heads = scratch.cut(parts.select("component").distinct().repartitionByRange("component").withColumn("_part", F.spark_partition_id()), "heads")
        before, sizes = 0, {r["_part"]: r.n for r in heads.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
        offsets = []
        for part in sorted(sizes):
            offsets.append((part, before))
            before += sizes[part]
        known = F.broadcast(parts.sparkSession.createDataFrame(offsets, "_part int, _before long"))  # a row a task
        heads = heads.join(known, "_part").select("component", (F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("component"))).alias("label"))
        return scratch.keep(parts.join(heads, "component").select(F.col("node").alias("id"), F.col("label").cast("bigint").alias("label")))
