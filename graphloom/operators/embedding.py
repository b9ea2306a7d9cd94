"""Node embeddings from propagation and personalised PageRank, and their alignment."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chance import SEED, hashed, uniform
from ..functions.vectors import densify, l2norm, weighted_sums
from ..plans.loops import iterate
from ..session import Scratch
from . import blocks
from .graphs import degrees, nodes_of
from .walks import expected_walk, stays_of

HASHES = 3


def top_terms(terms: DataFrame, most: int, least: float) -> DataFrame:
    """(node, feat, w): each node's largest weights, ties (to 12 digits) by feature, those above ``least``."""
    w = Window.partitionBy("node").orderBy(F.round("w", 12).desc(), "feat")
    return terms.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= most) & (F.col("w") > least)).select("node", "feat", "w")


def unit_terms(terms: DataFrame) -> DataFrame:
    norms = terms.groupBy("node").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return terms.join(norms, "node").select("node", "feat", F.try_divide("w", "_n").alias("w"))


def click_terms(edges: DataFrame, features: DataFrame, start: DataFrame, passes: int, most: int = 100, alpha: float = 1.0, least: float = 1e-5, idf: bool = False) -> DataFrame:
    """(node, feat, w): term weights propagated back and forth over a bipartite graph.

    ``start`` (id): the side that the even passes update; the odd ones update the others.  An update is
    (1 - alpha) old + alpha * sum of p times the neighbours' weights, made a unit vector and cut to ``most`` terms.
    Weights begin at 1 / sqrt(n), or with ``idf`` at 1 / ln(1 + count).
    """
    with Scratch(edges.sparkSession, "clicks") as scratch:
        return _click_terms(scratch.cut(edges.select("src", "dst", "p"), "edges"), features, start, passes, most, alpha, least, idf)  # built once; every pass reads it


def _click_terms(edges: DataFrame, features: DataFrame, start: DataFrame, passes: int, most: int, alpha: float, least: float, idf: bool) -> DataFrame:
    rows = features.select("node", "feat").distinct()
    if idf:
        count = features.groupBy("feat").agg(F.count(F.lit(1)).alias("_c"))
        rows = rows.join(count, "feat").select("node", "feat", (1 / F.log(1.0 + F.col("_c"))).alias("w"))
    else:
        rows = rows.join(rows.groupBy("node").agg(F.count(F.lit(1)).alias("_c")), "node").select("node", "feat", (1 / F.sqrt("_c")).alias("w"))
    side = start.select(F.col("id").alias("node")).distinct().withColumn("_s", F.lit(True))
    begin = top_terms(unit_terms(rows), most, least)

    def step(now: DataFrame, k: int) -> DataFrame:
        mine = side if k % 2 == 0 else nodes_of(edges).select(F.col("id").alias("node")).join(side, "node", "left_anti").withColumn("_s", F.lit(True))
        got = edges.join(mine.select(F.col("node").alias("src")), "src", "left_semi").join(now.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "feat", (F.col("p") * F.col("w") * alpha).alias("w"))
        if alpha != 1:
            got = got.unionByName(now.join(mine.select("node"), "node", "left_semi").select("node", "feat", (F.col("w") * (1 - alpha)).alias("w")))
        new = got.groupBy("node", "feat").agg(F.sum("w").alias("w")).where("w > 0")
        rest = now.join(mine.select("node"), "node", "left_anti")
        return rest.unionByName(top_terms(unit_terms(new), most, least))

    return iterate(begin, step, passes)


def hashed_vectors(terms: DataFrame, key: str, feat: str, weight: str, dims: int, hashes: int = HASHES) -> DataFrame:
    """(key, vector): weights added with the sign and at the dimension of each of ``hashes`` hashes of the feature."""
    rows = terms.withColumn("_h", F.explode(F.array(*map(F.lit, range(hashes)))))
    parts = None
    for h in range(hashes):
        dim, sign = hashed(F.col(feat), h, dims)
        one = rows.where(F.col("_h") == h).select(key, dim.alias("_pos"), (sign * F.col(weight)).alias("_v"))
        parts = one if parts is None else parts.unionByName(one)
    return densify(parts.groupBy(key, "_pos").agg(F.sum("_v").alias("_s")), [key], dims)


def rank_vectors(scores: DataFrame, n: int, dims: int, hashes: int = HASHES) -> DataFrame:
    """(root, vector) of (root, id, score): the node's id hashed, weighted max(0, ln(score * n))."""
    rows = scores.where(F.col("score") > 0).withColumn("w", F.greatest(F.lit(0.0), F.log(F.col("score") * n)))
    return hashed_vectors(rows, "root", "id", "w", dims, hashes)


def rank_walks(edges: DataFrame, roots: DataFrame, restarts: float, beta: float, n: int, dims: int, hashes: int = HASHES) -> DataFrame:
    """``rank_vectors`` of ``walks.expected_walk``; of a graph that ``blocks`` can hold the scores stay in the tasks, which give a vector a root."""
    with Scratch(edges.sparkSession, "walk") as scratch:
        edges = scratch.cut(edges.select("src", "dst", "p"), "edges")
        graph = blocks.packed(edges, roots)
        if graph is None:
            return scratch.keep(rank_vectors(expected_walk(edges, roots, restarts, beta), n, dims, hashes))
        every = nodes_of(edges)
        places = [hashed(F.col("id"), h, dims) for h in range(hashes)]
        named = every.select("id", *[c.alias(f"{x}{h}") for h, pair in enumerate(places) for x, c in zip("ds", pair, strict=True)]).toArrow()  # of the nodes of a packed graph
    signs = np.zeros((len(graph.ids), dims))
    at = graph.numbers(named.column("id").combine_chunks())
    for h in range(hashes):
        np.add.at(signs, (at, named.column(f"d{h}").to_numpy()), named.column(f"s{h}").to_numpy())
    held, stays = edges.sparkSession.sparkContext.broadcast(signs), stays_of(restarts)

    def work(moves: blocks.Steps, at, times):
        score = blocks.ended(moves, at, times, stays, beta, 0.0)
        there = score > 0
        some = there.any(1)
        w = np.maximum(0.0, np.log(score * n, where=there, out=np.zeros_like(score)))
        yield [moves.graph.ids.take(pa.array(at[some])), pa.array(list((w @ held.value)[some]), pa.list_(pa.float64()))]

    return blocks.in_blocks(graph, roots, work, f"root {dict(edges.dtypes)['src']}, vector array<double>")


def feature_rank_vectors(scores: DataFrame, features: DataFrame, n: int, dims: int, least: float = 1e-5, hashes: int = HASHES) -> DataFrame:
    """(root, vector): as ``rank_vectors``, of the features of the nodes reached."""
    sums = scores.join(features.select(F.col("node").alias("id"), "feat"), "id").groupBy("root", "feat").agg(F.sum("score").alias("score"))
    return summed_rank_vectors(sums, n, dims, least, hashes)


def summed_rank_vectors(sums: DataFrame, n: int, dims: int, least: float = 1e-5, hashes: int = HASHES) -> DataFrame:
    """(root, vector): as ``rank_vectors``, of scores of features (root, feat, score), those above ``least``."""
    sums = sums.where(F.col("score") > least)
    return hashed_vectors(sums.withColumn("w", F.greatest(F.lit(0.0), F.log(F.col("score") * n))), "root", "feat", "w", dims, hashes)


def neighbourhood(edges: DataFrame, vectors: DataFrame, alpha: float | None = None, most: int | None = None) -> DataFrame:
    """(id, vector): (1 - alpha) * sum of p times the neighbours' vectors + alpha * own.

    Without ``alpha`` a node's is min(1, 1 / ln(degree + 1)).  Only the first ``most`` edges in the order of dst
    count, p as it is.  A node without edges keeps its vector.
    """
    own = edges
    if most is not None:
        own = edges.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_r") <= most)
    near = weighted_sums(own.join(vectors.select(F.col("id").alias("dst"), "vector"), "dst").withColumnRenamed("src", "id"), ["id"], "vector", "p", "_near")
    deg = degrees(edges, vectors)
    a = F.lit(float(alpha)) if alpha is not None else F.when(F.col("degree") > 0, F.least(F.lit(1.0), F.try_divide(F.lit(1.0), F.log(F.col("degree") + 1.0)))).otherwise(1.0)
    rows = vectors.select("id", "vector").join(near, "id", "left").join(deg, "id").withColumn("_a", a)
    mixed = F.zip_with("_near", "vector", lambda x, y: (1 - F.col("_a")) * x + F.col("_a") * y)
    return rows.select("id", F.when(F.col("_near").isNull(), F.col("vector")).otherwise(mixed).alias("vector"))


def random_vectors(nodes: DataFrame, dims: int, seed: int = SEED) -> DataFrame:
    """(id, vector): unit vectors that depend on seed, id and dimension alone."""
    v = F.array(*[2 * uniform(seed, F.col("id").cast("string"), F.lit(k)) - 1 for k in range(dims)])
    return nodes.select("id", l2norm(v).alias("vector"))


def place_by_distances(anchors: np.ndarray, distances: np.ndarray, start: np.ndarray, alpha: float = 0.1, error: float = 0.01, most: int = 10) -> np.ndarray:
    """The point whose distances to ``anchors`` come near ``distances``, by gradient descent, near anchors first."""
    x, before = start.astype(float).copy(), None
    w = 1 / np.sqrt(np.arange(1, len(anchors) + 1))
    for _ in range(most):
        diff = x - anchors
        d = np.maximum(np.linalg.norm(diff, axis=1), 1e-12)
        loss = float((w * (d - distances) ** 2).sum())
        if before is not None and abs(before - loss) <= error * max(before, 1e-12):
            break
        before = loss
        x -= alpha * ((2 * w * (d - distances) / d)[:, None] * diff).sum(0)
    return x


def align(queries: DataFrame, anchors: DataFrame, alpha: float = 0.1, error: float = 0.01, most: int = 10) -> DataFrame:
    """(id, vector) in the translated space of each query, from its ``anchors`` (id, rank, distance, vector).

    ``anchors`` are a query's nearest originals with their translations; a query has a bounded number of them.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        t = np.stack(part["vector"].to_numpy())
        x = place_by_distances(t, part["distance"].to_numpy(float), t.mean(0), alpha, error, most)
        return pd.DataFrame({"id": [part["id"].iloc[0]], "vector": [x.tolist()]})

    kind = dict(anchors.dtypes)["id"]
    return anchors.join(queries.select("id"), "id", "left_semi").groupBy("id").applyInPandas(one, f"id {kind}, vector array<double>")


