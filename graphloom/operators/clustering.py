"""Connected components and label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chance import SEED, uniform
from ..plans.loops import iterate
from .components import components
from .graphs import mode, nodes_of, normalized


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): weakly connected components, each named by its smallest node; a node without edges is its own."""
    nodes = (nodes if nodes is not None else nodes_of(edges)).select("id")
    parts = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def largest(edges: DataFrame, k: int) -> DataFrame:
    """Edges within the ``k`` largest components, ties by the smallest node, with p as new weights."""
    parts = connected(edges)
    top = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(k)
    keep = parts.join(top.select("component"), "component", "left_semi").select(F.col("id").alias("src"))
    return normalized(edges.join(keep, "src", "left_semi").select("src", "dst", F.col("p").alias("weight")))


def label_propagation(edges: DataFrame, runs: int = 1, passes: int = 10, seed: int = SEED) -> DataFrame:
    """(run, id, label): each pass gives every node the most frequent label of its out-neighbours, all at once.

    Ties go by a hash of run, node and label; a node without edges keeps its own label.  All runs go in one loop.
    """
    nodes = nodes_of(edges)
    start = nodes.crossJoin(edges.sparkSession.range(runs).withColumnRenamed("id", "run")).select("run", "id", F.col("id").alias("label"))
    hops = edges.select("src", "dst").distinct()

    def step(now: DataFrame, k: int) -> DataFrame:
        heard = hops.join(now.select("run", F.col("id").alias("dst"), "label"), "dst").select("run", F.col("src").alias("id"), "label")
        new = mode(heard, ["run", "id"], "label", seed + k).withColumnRenamed("label", "_new")
        return now.join(new, ["run", "id"], "left").select("run", "id", F.coalesce("_new", "label").alias("label"))

    return iterate(start, step, passes)


def speaker_listener(edges: DataFrame, t: int, threshold: float, memory: int | None = None, best: bool = True, seed: int = SEED) -> DataFrame:
    """(id, labels): overlapping communities; the labels that a node remembers ``threshold`` times at least, ascending.

    In each of t - 1 passes every neighbour speaks one remembered label, chosen by a hash; the listener
    remembers the most frequent one, or with ``best`` off what one speaker, chosen by a hash, said, so that a label is as
    likely as it is frequent.  A memory of ``memory`` slots forgets the oldest.  Labels have the type of the ids.
    """
    memory = memory or t
    least = threshold * memory if threshold < 1 else threshold
    nodes = nodes_of(edges)
    hops = edges.select("src", "dst").distinct()

    def step(now: DataFrame, k: int) -> DataFrame:
        spoken = hops.join(now.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), F.element_at("memory", 1 + F.floor(uniform(seed + k, "src", "dst") * F.size("memory")).cast("int")).alias("label"), F.col("dst").alias("speaker"))
        if best:
            heard = mode(spoken, ["id"], "label", seed + 7_919 * (k + 1))
        else:
            heard = spoken.groupBy("id").agg(F.max(F.struct(uniform(seed + 7_919 * (k + 1), "id", "speaker").alias("u"), "speaker", "label")).alias("b")).select("id", F.col("b.label").alias("label"))
        full = F.concat("memory", F.when(F.col("label").isNull(), F.slice("memory", 1, 0)).otherwise(F.array("label")))
        return now.join(heard, "id", "left").select("id", F.when(F.size(full) > memory, F.slice(full, F.size(full) - memory + 1, memory)).otherwise(full).alias("memory"))

    last = iterate(nodes.select("id", F.array("id").alias("memory")), step, max(0, t - 1))
    kept = last.select("id", F.explode("memory").alias("label")).groupBy("id", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return last.select("id").join(kept.groupBy("id").agg(F.array_sort(F.collect_list("label")).alias("labels")), "id", "left").select("id", F.coalesce("labels", F.array().cast(f"array<{dict(nodes.dtypes)['id']}>")).alias("labels"))


def hops_from(edges: DataFrame, landmarks: DataFrame, most: int = 254) -> DataFrame:
    """(landmark, id, hops): the least number of edges from each landmark, as far as ``most``; unreachable nodes are left out."""
    start = landmarks.select(F.col("id").alias("landmark"), "id", F.lit(0).alias("hops"))
    out = edges.select("src", "dst").distinct()

    def step(now: DataFrame, k: int) -> DataFrame:
        reach = now.where(F.col("hops") == k).join(out, F.col("id") == F.col("src")).select("landmark", F.col("dst").alias("id")).distinct()
        return now.unionByName(reach.join(now, ["landmark", "id"], "left_anti").withColumn("hops", F.lit(k + 1)))

    return iterate(start, step, most, lambda a, b: a.count() == b.count())


def landmark_embeddings(edges: DataFrame, landmarks: DataFrame, most: int = 254) -> DataFrame:
    """(id, vector): hops from each landmark, in the order of their ids, 255 where unreachable."""
    nodes = nodes_of(edges)
    found = hops_from(edges, landmarks, most)
    every = nodes.join(F.broadcast(landmarks.select(F.col("id").alias("landmark"))) if landmarks.count() <= 10_000 else landmarks.select(F.col("id").alias("landmark")), how="cross")
    full = every.join(found, ["landmark", "id"], "left").select("id", "landmark", F.coalesce("hops", F.lit(255)).cast("double").alias("h"))
    return full.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("landmark", "h"))).alias("v")).select("id", F.transform("v", lambda e: e["h"]).alias("vector"))
