"""Discrete node features (node, pos, feat) and vectors made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import assemble
from ..plans.loops import iterate
from ..session import Scratch


#: Dimensions that are added up as columns; longer vectors, and those of several lengths, as rows.
COLUMNS = 64


def feature_counts(features: DataFrame) -> DataFrame:
    """(feat, n): occurrences, repeats counted."""
    return features.groupBy("feat").agg(F.count(F.lit(1)).alias("n"))


def pruned(features: DataFrame, least: int) -> DataFrame:
    """Only features that occur ``least`` times at least, over all nodes."""
    return features.join(feature_counts(features).where(F.col("n") >= least).select("feat"), "feat", "left_semi").select("node", "pos", "feat")


def filled(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node without features gets one of its own, ``node:<id>``."""
    missing = nodes.select(F.col("id").alias("node")).join(features, "node", "left_anti")
    return features.select("node", "pos", "feat").unionByName(missing.select("node", F.lit(0).alias("pos"), F.concat(F.lit("node:"), F.col("node").cast("string")).alias("feat")))


def unigrams(features: DataFrame) -> DataFrame:
    """(feat, p): each feature's share of all occurrences."""
    n = feature_counts(features)
    return n.crossJoin(features.agg(F.count(F.lit(1)).alias("_all"))).select("feat", (F.col("n") / F.col("_all")).alias("p"))


def set_features(features: DataFrame, given: DataFrame) -> DataFrame:
    """``given`` (node, pos, feat) in place of whatever its nodes had."""
    return features.join(given.select("node").distinct(), "node", "left_anti").select("node", "pos", "feat").unionByName(given.select("node", "pos", "feat"))


def mean_embeddings(features: DataFrame, vectors: DataFrame, weights: DataFrame | None = None, alpha: float = 1.0) -> DataFrame:
    """(node, vector): the mean of a node's known features' vectors.

    With ``weights`` (feat, p) a feature counts alpha / (alpha + p).  Features without a vector are left out, and so
    are nodes without any known feature.
    """
    rows = features.join(vectors.select("feat", "vector"), "feat")
    if weights is not None:
        rows = rows.join(weights.select("feat", "p"), "feat").withColumn("_w", F.lit(alpha) / (F.lit(alpha) + F.col("p")))
    else:
        rows = rows.withColumn("_w", F.lit(1.0))
    size = vectors.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.count_if(F.exists("vector", F.isnull)).alias("holes")).first()
    if size.low is not None and 0 < size.low == size.high <= COLUMNS and not size.holes:
        # A row for each feature of a node goes to the node's task and is added up there, a column for each dimension.
        dealt = rows.select("node", "_w", "vector").repartition("node")
        sums = dealt.groupBy("node").agg(F.sum("_w").alias("_n"), *[F.sum(F.col("_w") * F.get("vector", F.lit(i))).alias(f"_{i}") for i in range(size.high)])
        return sums.select("node", F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(size.high)]).alias("vector"))
    parts = rows.select("node", "_w", F.posexplode("vector").alias("_pos", "_x")).groupBy("node", "_pos").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_s"))
    return assemble(parts, ["node"])


def embed_nodes(features: DataFrame, vectors: DataFrame, nodes: DataFrame, dims: int, weights: DataFrame | None = None, alpha: float = 1.0) -> DataFrame:
    """(node, vector) of every node, zeros where no feature is known."""
    got = mean_embeddings(features, vectors, weights, alpha)
    return nodes.select(F.col("id").alias("node")).join(got, "node", "left").select("node", F.coalesce("vector", F.array_repeat(F.lit(0.0), dims)).alias("vector"))


def propagate(edges: DataFrame, features: DataFrame, k: int, threshold: float = 0.0, most: int = 20) -> DataFrame:
    """Features for nodes without any, from their neighbours, hop by hop.

    A node without features takes, of each feature of its neighbours, the sum of p, divided by the norm of these sums,
    keeps those above ``threshold`` and of them the ``k`` largest, ties by feature.  All nodes of a hop are
    served from the hop before; it ends when a hop adds nothing, or after ``most``.
    """
    with Scratch(edges.sparkSession, "features") as scratch:
        return _propagate(scratch.cut(edges.select("src", "dst", "p"), "edges"), features, k, threshold, most)  # built once; every hop reads it


def _propagate(edges: DataFrame, features: DataFrame, k: int, threshold: float, most: int) -> DataFrame:
    state = features.select("node", F.col("pos").cast("long").alias("pos"), "feat", F.lit(1.0).alias("w"))

    def hop(now: DataFrame, _: int) -> DataFrame:
        have = now.select(F.col("node").alias("src")).distinct()
        own = edges.join(have, "src", "left_anti").join(now.select(F.col("node").alias("dst"), "feat").distinct(), "dst")
        sums = own.groupBy(F.col("src").alias("node"), "feat").agg(F.sum("p").alias("s"))
        sums = sums.join(sums.groupBy("node").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("_n")), "node").withColumn("w", F.try_divide("s", "_n")).where(F.col("w") > threshold)
        pick = F.row_number().over(Window.partitionBy("node").orderBy(F.round("w", 12).desc(), "feat"))
        return now.unionByName(sums.withColumn("_r", pick).where(F.col("_r") <= k).select("node", (F.col("_r") - 1).cast("long").alias("pos"), "feat", "w"))

    return iterate(state, hop, most, lambda a, b: a.count() == b.count()).select("node", "pos", "feat")
