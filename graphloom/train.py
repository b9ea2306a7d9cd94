"""Training from files: ``python -m graphloom.train ep|rank EDGES FEATURES OUT [options]``; OUT gets (feat, vector) as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import api
from .operators.training import Attention, Loss
from .session import ship


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="graphloom.train")
    kinds = p.add_subparsers(dest="kind", required=True)
    for kind, what in (("ep", "embedding propagation"), ("rank", "ranking of walks")):
        k = kinds.add_parser(kind, help=what)
        for name in ("edges", "features", "out"):
            k.add_argument(name)
        k.add_argument("--undirected", action="store_true")
        k.add_argument("--namespace", default="single", choices=["single", "node_type", "prefix"])
        k.add_argument("--min-count", type=int, default=1, help="features that are rarer are left out")
        k.add_argument("--dims", type=int, default=100 if kind == "ep" else 32)
        k.add_argument("--passes", type=int, default=100 if kind == "ep" else 20)
        k.add_argument("--alpha", type=float, default=0.1 if kind == "ep" else 0.05)
        k.add_argument("--loss", default="margin" if kind == "ep" else "listnet")
        k.add_argument("--negatives", type=int, default=1 if kind == "ep" else 5)
    ep, rank = kinds.choices["ep"], kinds.choices["rank"]
    ep.add_argument("--gamma", type=float, default=1.0)
    ep.add_argument("--other", type=float, default=0.0, help="the second margin of the contrastive loss")
    ep.add_argument("--restart", type=float, default=0.25, help="of the walks of the loss ppr")
    ep.add_argument("--hard-negatives", type=int, default=0)
    ep.add_argument("--max-neighbours", type=int, default=10)
    ep.add_argument("--valid", type=float, default=0.1)
    ep.add_argument("--noise", type=float, default=0.0)
    ep.add_argument("--updates", type=int, default=1, help="steps a pass")
    ep.add_argument("--weighting", choices=["log", "exponential"])
    ep.add_argument("--weight", type=float, default=0.5, help="the power of exponential weighting")
    ep.add_argument("--attention", type=int, metavar="D_K", help="train attention with queries and keys so wide")
    ep.add_argument("--heads", type=int, default=1)
    ep.add_argument("--window", type=int)
    ep.add_argument("--chosen", type=int)
    rank.add_argument("--steps", type=float, default=0.3)
    rank.add_argument("--walks", type=int, default=1_000, help="of each node; 0 takes exact masses")
    rank.add_argument("--k", type=int, default=10)
    rank.add_argument("--compression", type=float, default=1.0)
    rank.add_argument("--beta", type=float, default=0.8)
    rank.add_argument("--weight-decay", type=float, default=0.0)
    return p.parse_args(given)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Train as asked and write the features' vectors."""
    graph = api.Graph.load(spark, a.edges, api.UNDIRECTED if a.undirected else api.DIRECTED)
    fs = api.FeatureSet.from_graph(graph).load_into(a.features, a.namespace).prune_min_count(a.min_count)
    if a.kind == "ep":
        attention = None if a.attention is None else Attention(a.heads, a.attention, a.window, a.chosen)
        weighting = None if a.weighting is None else (a.weighting, a.weight)
        learner = api.EmbeddingPropagator(
            a.dims, a.passes, a.alpha, Loss(a.loss, a.gamma, a.other, a.negatives, a.restart), max_neighbours=a.max_neighbours, weighting=weighting,
            noise=a.noise, valid_pct=a.valid, hard_negs=a.hard_negatives, attention=attention, updates=a.updates,
        )
        tell = lambda i, train, valid: print(f"pass {i + 1}/{a.passes}, loss {train:.5f}, held out {'-' if valid is None else f'{valid:.5f}'}", flush=True)
        got = learner.learn_features(graph, fs, watch=tell)
    else:
        learner = api.PprRankLearner(a.alpha, a.dims, a.passes, a.steps, a.k, a.negatives, a.loss, a.compression, a.beta, a.weight_decay, walks=a.walks or None)
        got = learner.learn_features(graph, fs)
    got.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    session = ship(SparkSession.builder.appName("graphloom.train").getOrCreate())
    run(session, arguments())
    session.stop()
