"""Building and looking at graphs: edges (src, dst, weight) and, normalised, p."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chance import SEED, uniform


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways; a loop is there twice."""
    ways = F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ways).alias("_w"), "weight").select("_w.src", "_w.dst", "weight")


def deduplicated(edges: DataFrame) -> DataFrame:
    """One edge for each pair of ends, weights summed."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def normalized(edges: DataFrame) -> DataFrame:
    """With ``p``, the weight's share of its source's; a source whose weights sum to zero is uniform.

    Sums are joined rather than computed over a window, so a hub's edges are only added up, never gathered.
    """
    sums = edges.groupBy("src").agg(F.sum("weight").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    p = F.when(F.col("_sum") != 0, F.try_divide("weight", "_sum")).otherwise(1.0 / F.col("_n"))
    return edges.join(sums, "src").withColumn("p", p).drop("_sum", "_n")


def cumulative(edges: DataFrame) -> DataFrame:
    """With ``cdf``, the running sum of p in the order of dst; the last of a source is 1."""
    w = Window.partitionBy("src").orderBy("dst")
    last = F.lead("dst").over(w).isNull()
    return edges.withColumn("cdf", F.when(last, 1.0).otherwise(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))))


def from_cumulative(edges: DataFrame) -> DataFrame:
    """``p`` again from ``cdf``."""
    w = Window.partitionBy("src").orderBy("dst")
    return edges.withColumn("p", F.col("cdf") - F.coalesce(F.lag("cdf").over(w), F.lit(0.0)))


def transposed(edges: DataFrame) -> DataFrame:
    """Edges turned round with their p as weights, normalised again."""
    return normalized(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("weight")))


def with_weights(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """The same topology with other weights (src, dst, weight), normalised; an edge without one keeps none."""
    return normalized(edges.select("src", "dst").join(weights, ["src", "dst"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, degree): the number of edges out of each node, 0 for the others."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return (nodes if nodes is not None else nodes_of(edges)).select("id").join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbours(edges: DataFrame, node, by: str = "p") -> DataFrame:
    """(dst, ``by``) of one node's edges; ``by`` is p, cdf or weight."""
    own = edges.where(F.col("src") == F.lit(node))
    return (cumulative(own) if by == "cdf" else own).select("dst", by)


def counts(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges."""
    n = (nodes if nodes is not None else nodes_of(edges)).agg(F.count(F.lit(1)).alias("nodes"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row by one row


def ranked(scores: DataFrame, k: int | None = None, kinds: DataFrame | None = None, types: list[str] | str | None = None, by: str = "score", ascending: bool = False) -> DataFrame:
    """Scores in order, ties by id, of nodes of the given types only, the first ``k``."""
    if types is not None:
        if not isinstance(types, (str, list, set, tuple)):
            raise TypeError("types is a string, list or set")
        scores = scores.join(kinds.where(F.col("node_type").isin([types] if isinstance(types, str) else list(types))).select("id"), "id", "left_semi")
    out = scores.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), "id")
    return out if k is None else out.limit(k)


def top_degrees(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nodes of most edges, the larger id first among equals."""
    return degrees(edges).orderBy(F.desc("degree"), F.desc("id")).limit(k)


def chosen(nodes: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """``k`` pseudo-random nodes."""
    return nodes.select("id").withColumn("_u", uniform(seed, "id")).orderBy("_u", "id").limit(k).drop("_u")


def split(nodes: DataFrame, valid: float, seed: int = SEED) -> DataFrame:
    """(id, held): ``held`` for about a share ``valid`` of the nodes, by a hash of the id, so no node meets another."""
    return nodes.select("id", (uniform(seed, "id") < valid).alias("held"))


def reservoir(rows: DataFrame, group: list[str], n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows of each group by uniform keys."""
    w = Window.partitionBy(*group).orderBy(uniform(seed, *keys), *keys)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def weighted_reservoir(rows: DataFrame, group: list[str], n: int, weight: str, seed: int, *keys: str) -> DataFrame:
    """``n`` rows of each group with chances by weight: the largest u ** (1 / weight)."""
    key = F.when(F.col(weight) > 0, F.pow(uniform(seed, *keys), F.try_divide(F.lit(1.0), weight))).otherwise(-1.0)
    w = Window.partitionBy(*group).orderBy(key.desc(), *keys)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def sampled(rows: DataFrame, how: float | int | None, seed: int, *keys: str) -> DataFrame:
    """With ``scale``: all rows (None), each with a probability (in (0, 1)), or a fixed number (else)."""
    if how is None:
        return rows.withColumn("scale", F.lit(1.0))
    if 0 < how < 1:
        return rows.where(uniform(seed, *keys) < how).withColumn("scale", F.lit(1.0 / how))
    n, k = rows.count(), int(how)
    return rows.withColumn("_u", uniform(seed, *keys)).orderBy("_u", *keys).limit(k).drop("_u").withColumn("scale", F.lit(n / max(1, min(k, n))))


def mode(rows: DataFrame, group: list[str], value: str, seed: int = SEED) -> DataFrame:
    """(group, value): each group's most frequent value, ties by a hash of group and value."""
    n = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    best = n.groupBy(*group).agg(F.max(F.struct("_n", uniform(seed, *group, value).alias("u"), value)).alias("_b"))
    return best.select(*group, F.col(f"_b.{value}").alias(value))


def namespace(kind: str, name: Column, node_type: Column, delim: str = "=", fixed: str = "feat") -> Column:
    """(ns, name) of a feature: a fixed namespace, the node's type, or what stands before the first delimiter (else ``feat``)."""
    if kind == "single":
        return F.struct(F.lit(fixed).alias("ns"), name.alias("name"))
    if kind == "node_type":
        return F.struct(node_type.alias("ns"), name.alias("name"))
    at = F.locate(delim, name)
    return F.struct(F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(F.lit("feat")).alias("ns"), F.when(at > 0, F.substring(name, at + len(delim), F.length(name))).otherwise(name).alias("name"))
