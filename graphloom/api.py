"""Objects over the operators: graphs, features and embeddings whose nodes are named by (type, name).

Each object holds DataFrames and gives DataFrames; nothing is computed until a result is used.  Nodes have
ids that are hashes of (type, name), so naming needs no global order; ``nodes`` translates them back.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .functions.chance import SEED
from .operators import clustering, embedding, features, graphs, nearest, policy, ranking, training, walks
from .session import Scratch
from .sources import tables

DIRECTED, UNDIRECTED = "directed", "undirected"


def node_id(node_type, name):
    """The id of a node: 64 bits of the hash of its type and name."""
    return F.xxhash64(node_type, F.lit("\x00"), name)


def name_nodes(rows: DataFrame) -> DataFrame:
    """(id, node_type, node_name) of edges named at both ends."""
    ends = rows.select(F.col("from_type").alias("node_type"), F.col("from_name").alias("node_name")).unionByName(rows.select(F.col("to_type").alias("node_type"), F.col("to_name").alias("node_name")))
    return ends.distinct().select(node_id(F.col("node_type"), F.col("node_name")).alias("id"), "node_type", "node_name")


@dataclass(frozen=True)
class Graph:
    """A static weighted graph: ``nodes`` (id, node_type, node_name), ``edges`` (src, dst, weight, p)."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_rows(cls, rows: DataFrame) -> Graph:
        edges = rows.select(node_id(F.col("from_type"), F.col("from_name")).alias("src"), node_id(F.col("to_type"), F.col("to_name")).alias("dst"), "weight")
        return cls(name_nodes(rows), graphs.normalized(edges))

    @classmethod
    def load(cls, spark: SparkSession, path: str, edge_type: str = DIRECTED, skip_rows: int = 0, weighted: bool = True, deduplicate: bool = False) -> Graph:
        return cls.from_rows(tables.read_edges(spark, path, edge_type == UNDIRECTED, weighted, deduplicate, skip_rows))

    def named(self) -> DataFrame:
        """Edges with the names of their ends and p."""
        a = self.nodes.select(F.col("id").alias("src"), F.col("node_type").alias("from_type"), F.col("node_name").alias("from_name"))
        b = self.nodes.select(F.col("id").alias("dst"), F.col("node_type").alias("to_type"), F.col("node_name").alias("to_name"))
        return self.edges.join(a, "src").join(b, "dst").select("from_type", "from_name", "to_type", "to_name", F.col("p").alias("weight"))

    def save(self, path: str, compression: str | None = None) -> None:
        """Edges with their transition probabilities."""
        tables.write_tsv(self.named(), path, compression)

    def contains(self, node: tuple[str, str]) -> bool:
        return not self.find(node).isEmpty()

    def find(self, node: tuple[str, str]) -> DataFrame:
        return self.nodes.where((F.col("node_type") == node[0]) & (F.col("node_name") == node[1])).select("id")

    def require(self, *nodes: tuple[str, str]) -> DataFrame:
        """(id) of some nodes; an unknown one is a KeyError."""
        out = None
        for n in nodes:
            one = self.find(n)
            if one.isEmpty():
                raise KeyError(f"no node {n}")
            out = one if out is None else out.unionByName(one)
        return out

    def get_edges(self, node: tuple[str, str], by: str = "cdf") -> DataFrame:
        """(node_type, node_name, ``by``): the cdf, p or weight of a node's edges."""
        self.require(node)
        own = self.edges.join(self.find(node).withColumnRenamed("id", "src"), "src")
        return self.with_names((graphs.cumulative(own) if by == "cdf" else own).select(F.col("dst").alias("id"), by))

    def with_names(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.nodes, "id").drop("id")

    def counts(self) -> DataFrame:
        return graphs.counts(self.edges, self.nodes)

    def transpose(self) -> Graph:
        return replace(self, edges=graphs.transposed(self.edges))

    def vocab(self) -> DataFrame:
        return self.nodes.select("node_type", "node_name")


class GraphBuilder:
    """Edges given one by one, for small graphs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def add_edge(self, source: tuple[str, str], target: tuple[str, str], weight: float, edge_type: str = DIRECTED) -> None:
        self.rows.append((*source, *target, float(weight)))
        if edge_type == UNDIRECTED:
            self.rows.append((*target, *source, float(weight)))

    def build_graph(self, deduplicate: bool = True) -> Graph | None:
        """The graph, or None without edges; the builder is empty afterwards."""
        if not self.rows:
            return None
        rows, self.rows = self.spark.createDataFrame(self.rows, "from_type string, from_name string, to_type string, to_name string, weight double"), []
        keys = ["from_type", "from_name", "to_type", "to_name"]
        return Graph.from_rows(rows.groupBy(*keys).agg(F.sum("weight").alias("weight")) if deduplicate else rows)


@dataclass(frozen=True)
class FeatureSet:
    """``rows`` (node, pos, feat) of the nodes in ``nodes``."""

    nodes: DataFrame
    rows: DataFrame

    @classmethod
    def from_graph(cls, graph: Graph) -> FeatureSet:
        return cls(graph.nodes, graph.nodes.sparkSession.createDataFrame([], "node long, pos int, feat string"))

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, namespace: str = "single", **how) -> FeatureSet:
        rows = tables.read_features(spark, path)
        nodes = rows.select("node_type", "node_name").distinct().select(node_id(F.col("node_type"), F.col("node_name")).alias("id"), "node_type", "node_name")
        return cls(nodes, named_features(rows, namespace, **how))

    def load_into(self, path: str, namespace: str = "single", **how) -> FeatureSet:
        """With the features of a file in place of its nodes' own; nodes that are not known are left out."""
        rows = named_features(tables.read_features(self.nodes.sparkSession, path), namespace, **how)
        return replace(self, rows=features.set_features(self.rows, rows.join(self.nodes.select(F.col("id").alias("node")), "node", "left_semi")))

    def set_features(self, node: tuple[str, str], names: list[tuple[str, str]]) -> FeatureSet:
        given = self.nodes.sparkSession.createDataFrame([(*node, i, f"{ns}:{n}") for i, (ns, n) in enumerate(names)], "t string, n string, pos int, feat string")
        return replace(self, rows=features.set_features(self.rows, given.select(node_id(F.col("t"), F.col("n")).alias("node"), "pos", "feat")))

    def get_features(self, node: tuple[str, str]) -> DataFrame:
        return self.rows.where(F.col("node") == node_id(F.lit(node[0]), F.lit(node[1]))).select("pos", "feat")

    def prune_min_count(self, count: int) -> FeatureSet:
        return replace(self, rows=features.pruned(self.rows, count))

    def filled(self) -> FeatureSet:
        return replace(self, rows=features.filled(self.rows, self.nodes))


def named_features(rows: DataFrame, namespace: str, delim: str = "=", fixed: str = "feat") -> DataFrame:
    ns = graphs.namespace(namespace, F.col("name"), F.col("node_type"), delim, fixed)
    space = F.regexp_replace(ns["ns"], r"([\\:])", r"\\$1")  # so that the first bare colon ends the namespace
    return rows.select(node_id(F.col("node_type"), F.col("node_name")).alias("node"), "pos", F.concat(space, F.lit(":"), ns["name"]).alias("feat"))


@dataclass(frozen=True)
class NodeEmbeddings:
    """``rows`` (id, node_type, node_name, vector) and the distance that goes with them."""

    rows: DataFrame
    distance: str = "cosine"

    @classmethod
    def load(cls, spark: SparkSession, path: str, distance: str = "cosine", types: list[str] | str | None = None, skip_rows: int = 0) -> NodeEmbeddings:
        return cls.named(tables.read_embeddings(spark, path, types, skip_rows), distance)

    @classmethod
    def named(cls, rows: DataFrame, distance: str) -> NodeEmbeddings:
        return cls(rows.select(node_id(F.col("node_type"), F.col("node_name")).alias("id"), "node_type", "node_name", "vector"), distance)

    @classmethod
    def from_list(cls, spark: SparkSession, given: list[tuple[tuple[str, str], list[float]]], distance: str = "cosine") -> NodeEmbeddings:
        """Shorter vectors are filled with zeros; the last vector of a node stays."""
        dims = max((len(v) for _, v in given), default=0)
        last = {n: list(map(float, v)) + [0.0] * (dims - len(v)) for n, v in given}
        return cls.named(spark.createDataFrame([(*n, v) for n, v in last.items()], "node_type string, node_name string, vector array<double>"), distance)

    @classmethod
    def zeros(cls, graph: Graph, dims: int, distance: str = "cosine") -> NodeEmbeddings:
        """A vector of zeros for every node of a graph."""
        return cls(graph.nodes.select("id", "node_type", "node_name", F.array_repeat(F.lit(0.0), dims).alias("vector")), distance)

    @classmethod
    def built(cls, given: DataFrame, distance: str = "cosine") -> NodeEmbeddings:
        """From (node_type, node_name, vector, seq): the vector of the largest ``seq`` of each node; an error if their dimensions differ."""
        sizes = given.agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).first()
        if sizes.lo != sizes.hi:
            raise ValueError(f"embeddings have {sizes.lo} to {sizes.hi} dimensions")
        return cls.named(given.groupBy("node_type", "node_name").agg(F.max_by("vector", "seq").alias("vector")), distance)

    def set_embedding(self, node: tuple[str, str], vector: list[float]) -> NodeEmbeddings:
        """With another vector of a known node."""
        if len(vector) != len(self.get_embedding(node)):
            raise ValueError("another number of dimensions")
        own = (F.col("node_type") == node[0]) & (F.col("node_name") == node[1])
        return replace(self, rows=self.rows.withColumn("vector", F.when(own, F.array(*(F.lit(float(x)) for x in vector))).otherwise(F.col("vector"))))

    def by_id(self, id_: int) -> tuple[tuple[str, str], list[float]]:
        """(name, vector) of the node with an id."""
        got = self.rows.where(F.col("id") == F.lit(id_)).first()
        if got is None:
            raise KeyError(f"no node {id_}")
        return (got.node_type, got.node_name), list(got.vector)

    @classmethod
    def of(cls, graph: Graph, vectors_: DataFrame, distance: str) -> NodeEmbeddings:
        return cls(vectors_.join(graph.nodes, "id").select("id", "node_type", "node_name", "vector"), distance)

    def save(self, path: str, compression: str | None = None) -> None:
        tables.write_tsv(self.rows.select("node_type", "node_name", "vector"), path, compression)

    def get_embedding(self, node: tuple[str, str]) -> list[float]:
        got = self.rows.where((F.col("node_type") == node[0]) & (F.col("node_name") == node[1])).select("vector").first()
        if got is None:
            raise KeyError(f"no node {node}")
        return list(got.vector)

    def l2norm(self) -> NodeEmbeddings:
        return replace(self, rows=self.rows.withColumn("vector", vectors.l2norm(F.col("vector"))))

    def nearest_neighbor(self, query: list[float] | tuple[str, str], k: int, types: list[str] | str | None = None) -> DataFrame:
        q = self.get_embedding(query) if isinstance(query, tuple) else query
        return nearest.nearest(self.rows, q, k, self.distance, types).join(self.rows.select("id", "node_type", "node_name"), "id").orderBy("distance", "id")

    def score_all(self, query: list[float] | tuple[str, str]) -> DataFrame:
        q = self.get_embedding(query) if isinstance(query, tuple) else query
        return self.rows.select("node_type", "node_name", vectors.distance(self.distance, F.col("vector"), F.array(*map(F.lit, q))).alias("distance"))

    def compute_distance(self, a: list[float] | tuple[str, str], b: list[float] | tuple[str, str]) -> float:
        a, b = (self.get_embedding(x) if isinstance(x, tuple) else x for x in (a, b))
        return self.rows.sparkSession.range(1).select(vectors.distance(self.distance, F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias("d")).first().d


class NodeEmbeddingsBuilder:
    """Vectors given one after the other; the last of a node stays."""

    def __init__(self, spark: SparkSession, distance: str = "cosine"):
        self.spark, self.distance, self.given = spark, distance, []

    def add_embedding(self, node: tuple[str, str], vector: list[float]) -> None:
        if self.given and len(vector) != len(self.given[0][2]):
            raise ValueError("another number of dimensions")
        self.given.append((*node, list(map(float, vector)), len(self.given)))

    def build(self) -> NodeEmbeddings | None:
        """None if nothing was given."""
        if not self.given:
            return None
        return NodeEmbeddings.built(self.spark.createDataFrame(self.given, "node_type string, node_name string, vector array<double>, seq long"), self.distance)


# Algorithms, each with the settings it is made with


@dataclass(frozen=True)
class PageRank:
    iterations: int
    damping: float = 0.85
    eps: float = 1e-5

    def learn(self, graph: Graph) -> NodeEmbeddings:
        scores = ranking.pagerank(graph.edges, self.iterations, self.damping, self.eps, graph.nodes)
        return NodeEmbeddings.of(graph, scores.select("id", F.array("score").alias("vector")), "euclidean")


@dataclass(frozen=True)
class RandomWalker:
    restarts: float
    walks: int
    beta: float = 0.5

    def walk(self, graph: Graph, node: tuple[str, str], seed: int = SEED, k: int | None = None, types=None, weighted: bool = True, exact: bool = False) -> DataFrame:
        root = graph.require(node)
        got = walks.expected_walk(graph.edges, root, self.restarts, self.beta) if exact else walks.sampled_walk(graph.edges, root, self.walks, self.restarts, self.beta, weighted, seed)
        return graph.with_names(graphs.ranked(got.select("id", "score"), k, graph.nodes, types)).orderBy(F.desc("score"), "node_type", "node_name")


@dataclass(frozen=True)
class BiasedRandomWalker:
    restarts: float
    walks: int = 0
    beta: float = 0.5
    blend: float = 0.5

    def walk(self, graph: Graph, embeddings: NodeEmbeddings, node: tuple[str, str], context: list[float], k: int | None = None, rerank: list[float] | None = None, types=None) -> DataFrame:
        got = walks.guided_walk(graph.edges, graph.require(node), embeddings.rows, context, self.restarts, self.beta, self.blend, None, rerank, embeddings.distance)
        return graph.with_names(graphs.ranked(got.select("id", "score"), k, graph.nodes, types)).orderBy(F.desc("score"), "node_type", "node_name")


@dataclass(frozen=True)
class SparsePPR:
    restarts: float
    eps: float = 1e-5

    def compute(self, graph: Graph, node: tuple[str, str], k: int | None = None, types=None) -> DataFrame:
        got = walks.sparse_ppr(graph.edges, graph.require(node), self.restarts, self.eps)
        return graph.with_names(graphs.ranked(got.select("id", "score"), k, graph.nodes, types)).orderBy(F.desc("score"), "node_type", "node_name")


@dataclass(frozen=True)
class RandomPath:
    seed: int = SEED + 125

    def rollout(self, graph: Graph, node: tuple[str, str], count: int, restarts: float, weighted: bool = True) -> DataFrame:
        return walks.paths(walks.walks(graph.edges, graph.require(node), count, restarts, weighted, None, self.seed))


class TournamentBuilder:
    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def add_outcome(self, winner: tuple[str, str], loser: tuple[str, str], weight: float = 1.0) -> None:
        self.rows.append((*winner, *loser, float(weight)))

    def add_ranked_outcomes(self, order: list[tuple[str, str]], weight: float = 1.0) -> None:
        """The earlier beats the later, every pair."""
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                self.add_outcome(a, b, weight)

    def build(self) -> Tournament | None:
        if not self.rows:
            return None
        rows, self.rows = self.spark.createDataFrame(self.rows, "from_type string, from_name string, to_type string, to_name string, weight double"), []
        out = rows.select(node_id(F.col("from_type"), F.col("from_name")).alias("winner"), node_id(F.col("to_type"), F.col("to_name")).alias("loser"), "weight")
        edges, norms = ranking.tournament(out)
        return Tournament(Graph(name_nodes(rows), edges), norms)


@dataclass(frozen=True)
class Tournament:
    graph: Graph
    norms: DataFrame


@dataclass(frozen=True)
class LSR:
    passes: int

    def learn(self, tournament: Tournament) -> NodeEmbeddings:
        scores = ranking.luce(tournament.graph.edges, tournament.norms, self.passes)
        return NodeEmbeddings.of(tournament.graph, scores.select("id", F.array("score").alias("vector")), "euclidean")


class ConnectedComponents:
    def learn(self, graph: Graph) -> NodeEmbeddings:
        """One dimension: components numbered from 1 by their smallest node id."""
        parts = clustering.connected(graph.edges, graph.nodes).withColumnRenamed("id", "node")
        labels = ranking.dense_rank_labels(parts)
        return NodeEmbeddings.of(graph, labels.select("id", F.array(F.col("label").cast("double")).alias("vector")), "hamming")

    def prune_largest_components(self, graph: Graph, k: int) -> Graph | None:
        edges = clustering.largest(graph.edges, k)
        return None if edges.isEmpty() else Graph(graph.nodes.join(graphs.nodes_of(edges), "id", "left_semi"), edges)


@dataclass(frozen=True)
class ClusterLPAEmbedder:
    k: int
    passes: int
    seed: int = SEED

    def learn(self, graph: Graph) -> NodeEmbeddings:
        got = clustering.label_propagation(graph.edges, self.k, self.passes, self.seed)
        v = got.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", "label"))).alias("v")).select("id", F.transform("v", lambda e: e["label"].cast("double")).alias("vector"))
        return NodeEmbeddings.of(graph, v, "hamming")


@dataclass(frozen=True)
class SLPAEmbedder:
    t: int
    threshold: float
    memory_size: int | None = None
    best: bool = True
    seed: int = SEED

    def learn(self, graph: Graph) -> NodeEmbeddings:
        """Labels ascending, filled with -1 up to as many as a memory can hold."""
        got = clustering.speaker_listener(graph.edges, self.t, self.threshold, self.memory_size, self.best, self.seed)
        memory = self.memory_size or self.t
        n = -(-memory // max(1, int(self.threshold * memory if self.threshold < 1 else self.threshold))) + 1
        v = F.transform(F.slice(F.concat(F.col("labels"), F.array_repeat(F.lit(-1).cast("bigint"), n)), 1, n), lambda x: x.cast("double"))
        return NodeEmbeddings.of(graph, got.select("id", v.alias("vector")), "jaccard")


@dataclass(frozen=True)
class DistanceEmbedder:
    n_landmarks: int
    seed: int | None = None

    def learn(self, graph: Graph) -> NodeEmbeddings:
        marks = graphs.top_degrees(graph.edges, self.n_landmarks).select("id") if self.seed is None else graphs.chosen(graph.nodes, self.n_landmarks, self.seed)
        return NodeEmbeddings.of(graph, clustering.landmark_embeddings(graph.edges, marks), "alt")


@dataclass(frozen=True)
class VpcgEmbedder:
    max_terms: int
    passes: int
    dims: int
    alpha: float = 1.0
    err: float = 1e-5
    idf: bool = False

    def learn_feature_mapping(self, graph: Graph, fs: FeatureSet, start_node_type: str) -> DataFrame:
        start = graph.nodes.where(F.col("node_type") == start_node_type).select("id")
        return embedding.click_terms(graph.edges, fs.filled().rows, start, self.passes, self.max_terms, self.alpha, self.err, self.idf)

    def learn(self, graph: Graph, fs: FeatureSet, start_node_type: str) -> NodeEmbeddings:
        terms = self.learn_feature_mapping(graph, fs, start_node_type)
        return NodeEmbeddings.of(graph, embedding.hashed_vectors(terms, "node", "feat", "w", self.dims).withColumnRenamed("node", "id"), "cosine")


def every_walk(graph: Graph, steps: float, beta: float, count: int | None, seed: int, best: int | None = None) -> DataFrame:
    """(root, id, score) of walks from every node: ``count`` sampled ones of each, which bounds the rows, or exactly, n x n at worst or the ``best`` of each."""
    if count is None:
        return walks.expected_walk(graph.edges, graph.nodes, steps, beta, best=best)
    return walks.sampled_walk(graph.edges, graph.nodes.select("id"), count, steps, beta, True, seed)


@dataclass(frozen=True)
class InstantEmbeddings:
    dims: int
    hashes: int = 3
    steps: float = 0.3
    beta: float = 0.8
    eps: float | None = None
    walks: int | None = None
    seed: int = SEED

    def learn(self, graph: Graph) -> NodeEmbeddings:
        """From the exact walk, from ``walks`` sampled ones of each node, or with ``eps`` from local push."""
        n = graph.nodes.count()
        if self.eps is None and self.walks is None:
            return NodeEmbeddings.of(graph, embedding.rank_walks(graph.edges, graph.nodes, self.steps, self.beta, n, self.dims, self.hashes).withColumnRenamed("root", "id"), "cosine")
        s = every_walk(graph, self.steps, self.beta, self.walks, self.seed) if self.eps is None else walks.sparse_ppr(graph.edges, graph.nodes, self.steps, self.eps)
        return NodeEmbeddings.of(graph, embedding.rank_vectors(s, n, self.dims, self.hashes).withColumnRenamed("root", "id"), "cosine")


@dataclass(frozen=True)
class PPREmbedder:
    dims: int
    steps: float
    beta: float = 0.8
    eps: float = 1e-5
    walks: int | None = None
    seed: int = SEED

    def learn(self, graph: Graph, fs: FeatureSet) -> NodeEmbeddings:
        if self.walks is None:
            sums = walks.feature_walk(graph.edges, graph.nodes, fs.filled().rows, self.steps, self.beta)
            v = embedding.summed_rank_vectors(sums, graph.nodes.count(), self.dims, self.eps)
        else:
            v = embedding.feature_rank_vectors(every_walk(graph, self.steps, self.beta, self.walks, self.seed), fs.filled().rows, graph.nodes.count(), self.dims, self.eps)
        return NodeEmbeddings.of(graph, v.withColumnRenamed("root", "id"), "cosine")


@dataclass(frozen=True)
class EmbeddingPropagator:
    dims: int = 100
    passes: int = 100
    alpha: float = 0.1
    loss: training.Loss = training.Loss()
    batch_size: int = 50
    max_neighbours: int = 10
    weighting: tuple[str, float] | None = None
    noise: float = 0.0
    valid_pct: float = 0.1
    seed: int = SEED
    hard_negs: int = 0
    attention: training.Attention | None = None
    updates: int = 1

    def learn_features(self, graph: Graph, fs: FeatureSet, feature_embeddings: DataFrame | None = None, watch=None) -> DataFrame:
        """(feat, vector); ``watch`` is called after each pass with its number, its loss and the loss of the nodes held out."""
        how = (self.dims, self.passes, self.alpha, self.loss, self.batch_size, self.max_neighbours, self.weighting, self.noise, self.valid_pct, feature_embeddings, self.seed, self.attention or training.Averaged(), self.hard_negs, self.updates)
        return training.propagate_embeddings(graph.edges, fs.filled().rows, *how, watch)[0]


@dataclass(frozen=True)
class PprRankLearner:
    alpha: float = 0.05
    dims: int = 32
    passes: int = 20
    steps: float = 0.3
    k: int = 10
    negatives: int = 5
    loss: str = "listnet"
    compression: float = 1.0
    beta: float = 0.8
    weight_decay: float = 0.0
    batch_size: int = 1_000
    seed: int = SEED
    walks: int | None = None

    def learn_features(self, graph: Graph, fs: FeatureSet) -> DataFrame:
        s = every_walk(graph, self.steps, self.beta, self.walks, self.seed, self.k + 1)
        kind = "listnet" if self.loss == "listnet" else "listmle"
        return training.rank_features(s, fs.filled().rows, self.dims, self.passes, self.alpha, self.k, self.negatives, kind, self.compression, self.batch_size, self.weight_decay, self.seed)[0]


@dataclass(frozen=True)
class FeatureAggregator:
    """averaged, weighted (alpha and feature shares) or attention (heads, d_k, window)."""

    kind: str = "averaged"
    alpha: float = 1.0
    weights: DataFrame | None = None
    heads: int = 1
    d_k: int = 1
    window: int | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        """As a folder: the settings, and the features' shares (feat, p) of a weighted one."""
        tables.save_aggregator(spark, f"{path}/settings", self.kind, alpha=self.alpha, heads=self.heads, d_k=self.d_k, window=self.window)
        if self.weights is not None:
            self.weights.select("feat", "p").write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureAggregator:
        got = tables.load_aggregator(spark, f"{path}/settings")
        return cls(weights=spark.read.parquet(f"{path}/weights") if got["kind"] == "weighted" else None, **got)


@dataclass(frozen=True)
class NodeEmbedder:
    aggregator: FeatureAggregator = FeatureAggregator()

    def embed_feature_set(self, fs: FeatureSet, vectors_: DataFrame, dims: int) -> DataFrame:
        """(node, vector) of every node; zeros where no feature is known."""
        a = self.aggregator
        if a.kind != "attention":
            return features.embed_nodes(fs.rows, vectors_, fs.nodes, dims, a.weights if a.kind == "weighted" else None, a.alpha)

        @F.pandas_udf("array<double>")
        def attend(bags):
            import numpy as np

            return bags.map(lambda v: training.attended(np.array(list(map(list, v)), float), a.heads, a.d_k, a.window).tolist())

        attend.func.__annotations__ = {}
        got = training.bags(fs.rows, vectors_).select("node", attend("vecs").alias("vector"))
        return fs.nodes.select(F.col("id").alias("node")).join(got, "node", "left").select("node", F.coalesce("vector", F.array_repeat(F.lit(0.0), dims)).alias("vector"))

    def embed_adhoc(self, names: list[str], vectors_: DataFrame, dims: int, strict: bool = True) -> list[float]:
        """The vector of a list of features; an unknown one is a KeyError if ``strict``."""
        spark = vectors_.sparkSession
        rows = spark.createDataFrame([(0, i, n) for i, n in enumerate(names)], "node long, pos int, feat string")
        if strict and not rows.join(vectors_, "feat", "left_anti").isEmpty():
            raise KeyError("unknown feature")
        nodes = spark.createDataFrame([(0, "", "")], "id long, node_type string, node_name string")
        return list(self.embed_feature_set(FeatureSet(nodes, rows), vectors_, dims).first().vector)


@dataclass(frozen=True)
class NeighborhoodAligner:
    alpha: float | None = None
    max_neighbors: int | None = None

    def align(self, embeddings: NodeEmbeddings, graph: Graph) -> NodeEmbeddings:
        return NodeEmbeddings.of(graph, embedding.neighbourhood(graph.edges, embeddings.rows, self.alpha, self.max_neighbors), embeddings.distance)

    def align_to_disk(self, path: str, embeddings: NodeEmbeddings, graph: Graph, compression: str | None = None) -> None:
        self.align(embeddings, graph).save(path, compression)


@dataclass(frozen=True)
class EmbeddingAligner:
    num_nodes: int
    alpha: float = 0.1
    error: float = 0.01
    max_iters: int = 10
    random_nodes: int = 0
    seed: int = SEED

    def bulk_align(self, original: NodeEmbeddings, translated: NodeEmbeddings, queries: DataFrame, ann: EmbAnn | None = None) -> DataFrame:
        """(id, vector) of ``queries`` (id, vector) in the translated space.

        Anchors are the nearest originals, exactly or by ``ann``, and ``random_nodes`` others, drawn by hash for each query.
        """
        if ann is None:
            near = nearest.nearest_each(original.rows, queries, self.num_nodes, "euclidean")
        else:
            near = nearest.by_euclid(ann.find(queries, self.num_nodes), original.rows, queries)
        if self.random_nodes:
            near = nearest.with_others(near, original.rows, queries, self.random_nodes, self.seed)
        anchors = near.join(translated.rows.select("id", "vector"), "id").select(F.col("query").alias("id"), "rank", "distance", "vector")
        return embedding.align(queries, anchors, self.alpha, self.error, self.max_iters)

    def align(self, original: NodeEmbeddings, translated: NodeEmbeddings, query: list[float], ann: EmbAnn | None = None) -> list[float]:
        """One vector, placed in the translated space."""
        asked = original.rows.sparkSession.createDataFrame([(-1, list(map(float, query)))], "id long, vector array<double>")
        return list(self.bulk_align(original, translated, asked, ann).first().vector)


@dataclass(frozen=True)
class FeaturePropagator:
    k: int
    threshold: float = 0.0
    max_iters: int = 20

    def propagate(self, graph: Graph, fs: FeatureSet) -> FeatureSet:
        return replace(fs, rows=features.propagate(graph.edges, fs.rows, self.k, self.threshold, self.max_iters))


@dataclass(frozen=True)
class EmbAnn:
    """A forest over ``embeddings``, kept at ``path`` as Parquet if one is given (built there by the first call), else in the shared folder."""

    embeddings: NodeEmbeddings
    n_trees: int
    max_nodes_per_leaf: int
    test_hp_per_split: int = 5
    num_sampled_nodes_split_test: int = 30
    types: list[str] | str | None = None
    seed: int = SEED + 10
    path: str | None = None

    @cached_property
    def rows(self) -> DataFrame:
        rows = self.embeddings.rows
        return rows if self.types is None else rows.where(F.col("node_type").isin([self.types] if isinstance(self.types, str) else list(self.types)))

    @cached_property
    def trees(self) -> DataFrame:
        """The built forest; every later call reads it."""
        spark = self.rows.sparkSession
        built = lambda: nearest.forest(self.rows, self.n_trees, self.max_nodes_per_leaf, self.test_hp_per_split, self.num_sampled_nodes_split_test, self.seed)
        if self.path is None:
            with Scratch(spark, "forest") as scratch:
                return scratch.keep(built())
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            built().write.mode("overwrite").parquet(self.path)
        return spark.read.parquet(self.path)

    def find(self, queries: DataFrame, k: int, min_search_size: int | None = None) -> DataFrame:
        return nearest.find_in_forest(self.trees, self.rows, queries, k, min_search_size or self.n_trees * k)

    def find_leaf_indices(self, queries: DataFrame) -> DataFrame:
        """(query, shard, tree, leaf)."""
        return nearest.leaves_of(self.trees, queries).drop("path")

    def find_leaf_paths(self, queries: DataFrame) -> DataFrame:
        """(query, shard, tree, path)."""
        return nearest.leaves_of(self.trees, queries).drop("leaf")

    def depth(self) -> DataFrame:
        return nearest.depths(self.trees)


@dataclass(frozen=True)
class GraphAnn:
    graph: Graph
    max_steps: int = 1_000

    def find(self, query: list[float], embeddings: NodeEmbeddings, k: int, seed: int = SEED + 10) -> DataFrame:
        return nearest.climb(self.graph.edges, embeddings.rows, query, k, most=max(1, self.max_steps // 32), kind=embeddings.distance, seed=seed)


@dataclass(frozen=True)
class PolicyEvaluation:
    graph: Graph
    gamma: float = 0.99
    iterations: int = 100
    eps: float = 1e-6
    temperature: float = 1.0
    rewards: DataFrame | None = None

    def set_reward(self, node: tuple[str, str], reward: float) -> PolicyEvaluation:
        one = self.graph.require(node).withColumn("reward", F.lit(float(reward)))
        rest = one if self.rewards is None else self.rewards.join(one.select("id"), "id", "left_anti").unionByName(one)
        return replace(self, rewards=rest)

    def load_rewards(self, path: str) -> PolicyEvaluation:
        got = tables.read_rewards(self.graph.nodes.sparkSession, path).select(node_id(F.col("node_type"), F.col("node_name")).alias("id"), "reward")
        if not got.join(self.graph.nodes, "id", "left_anti").isEmpty():
            raise KeyError("a reward for an unknown node")
        return replace(self, rewards=got)

    def values(self) -> DataFrame:
        none = self.graph.nodes.sparkSession.createDataFrame([], "id long, reward double")
        return policy.evaluate(self.graph.edges, self.rewards if self.rewards is not None else none, self.gamma, self.iterations, self.eps)

    def optimize(self) -> Graph:
        """A graph with new weights; graphs don't change in place."""
        edges = policy.improve(self.graph.edges, self.values(), self.temperature)
        return replace(self.graph, edges=edges.select("src", "dst", F.col("p").alias("weight"), "p"))


class Smci:
    def __init__(self, graph: Graph):
        self.graph, self.rows = graph, []

    def add_reward(self, source: tuple[str, str], target: tuple[str, str], reward: float) -> None:
        self.graph.require(source, target)
        self.rows.append((*source, *target, float(reward)))

    def optimize(self, iterations: int, num_walks: int, alpha: float, discount: float, step_penalty: float, explore_pct: float, restart_prob: float, compression: float = 1.0, embeddings: NodeEmbeddings | None = None, seed: int = SEED) -> Graph:
        given = self.graph.nodes.sparkSession.createDataFrame(self.rows, "a string, b string, c string, d string, reward double")
        rewards = given.select(node_id(F.col("a"), F.col("b")).alias("src"), node_id(F.col("c"), F.col("d")).alias("dst"), "reward")
        edges = policy.smci(self.graph.edges, rewards, iterations, num_walks, alpha, discount, step_penalty, explore_pct, restart_prob, compression, embeddings and embeddings.rows, embeddings.distance if embeddings else "cosine", seed)
        return replace(self.graph, edges=edges.select("src", "dst", F.col("p").alias("weight"), "p"))
