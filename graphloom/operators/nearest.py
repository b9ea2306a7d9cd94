"""Nearest neighbours: exact, by a forest of hyperplane trees, and by climbing a graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chance import SEED, uniform
from ..functions.vectors import distance
from ..session import Scratch


def nearest(vectors: DataFrame, query: list[float], k: int, kind: str = "cosine", types: list[str] | str | None = None) -> DataFrame:
    """(id, distance) of the ``k`` nearest vectors, ties by id; other node types are left out before, not after."""
    rows = vectors if types is None else vectors.where(F.col("node_type").isin([types] if isinstance(types, str) else list(types)))
    return rows.select("id", distance(kind, F.col("vector"), F.array(*map(F.lit, query))).alias("distance")).orderBy("distance", "id").limit(k)


#: Bytes of query vectors that the tasks hold at a time, and of the vectors and of the products that one compares at a time.
HELD, CHUNK, PRODUCTS = 32 << 20, 16 << 20, 64 << 20


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, kind: str = "cosine") -> DataFrame:
    """(query, id, distance, rank) of the ``k`` nearest vectors of each of a stated set of queries (id, vector).

    All queries are compared with all vectors.  For cosine, euclidean and dot a task finds by matrix products which pairs can be
    among the ``k`` nearest, takes the distance of these as ``distance`` does, and hands on its best ``k`` of a query; queries are
    broadcast in blocks of ``HELD`` bytes, several of them one after the other.  Other distances, and vectors with nulls, without finite numbers
    or of another length than most queries, are compared one by one.
    """
    if kind not in ("cosine", "euclidean", "dot"):
        return best_of(crossed(vectors, queries, kind), k)
    size = queries.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")).where("dims > 0").orderBy(F.desc("n"), "dims").first()
    if size is None:
        return best_of(crossed(vectors, queries, kind), k)
    dims = size.dims
    bad = F.col("id").isNull() | F.col("vector").isNull() | (F.size("vector") != dims) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows, asked = (x.select("id", "vector", F.coalesce(bad, F.lit(True)).alias("_bad")) for x in (vectors, queries))
    (n, odd), (m, strange) = (tuple(x.agg(F.count(F.lit(1)), F.count_if("_bad")).first()) for x in (rows, asked))
    spark = vectors.sparkSession
    parts = min(max(1, (n * m) >> 22), 2 * spark.sparkContext.defaultParallelism)
    dealt = rows.where(~F.col("_bad")).select("id", "vector").repartition(parts, "id")
    blocks = max(1, -(-m * dims * 8 // HELD))
    schema = f"query {dict(queries.dtypes)['id']}, id {dict(vectors.dtypes)['id']}, distance double"

    def found(b: int):
        own = asked.where(~F.col("_bad")).select("id", "vector")
        at = (own if blocks == 1 else own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).toArrow()
        ids, lines = at.column("id").combine_chunks(), at.column("vector").combine_chunks()
        held = spark.sparkContext.broadcast((ids, np.asarray(lines.flatten(), float).reshape(-1, dims)))
        return held, best_of(dealt.mapInArrow(lambda batches: nearest_in(batches, *held.value, k, kind), schema), k)

    if blocks == 1:
        out = found(0)[1]
    else:
        with Scratch(spark, "nearest") as scratch:
            out = None
            for b in range(blocks):
                held, near = found(b)
                near = scratch.cut(near, f"b{b}")
                held.destroy()
                out = near if out is None else out.unionByName(near)
            out = scratch.keep(out)
    if odd or strange:
        own = [crossed(rows.where("_bad"), asked, kind)] * bool(odd) + [crossed(rows.where(~F.col("_bad")), asked.where("_bad"), kind)] * bool(strange)
        for pairs in own:
            out = out.select("query", "id", "distance").unionByName(pairs)
        out = best_of(out.select("query", "id", "distance"), k)
    return out


def crossed(vectors: DataFrame, queries: DataFrame, kind: str) -> DataFrame:
    """(query, id, distance) of all pairs; queries are broadcast in blocks of 1,000."""
    rows, out = queries.select(F.col("id").alias("query"), F.col("vector").alias("_q")), None
    blocks = max(1, -(-queries.count() // 1_000))
    for b in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        pairs = vectors.select("id", "vector").join(F.broadcast(own), how="cross").select("query", "id", distance(kind, F.col("vector"), F.col("_q")).alias("distance"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def distances_of(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of ``a`` to that of ``b``, added up in the order of ``functions.vectors.distance``, so to the last bit as there."""
    out, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        x, y = a[:, i], b[:, i]
        if kind == "euclidean":
            out += (x - y) * (x - y)
        else:
            out += x * y
        if kind == "cosine":
            na += x * x
            nb += y * y
    if kind == "euclidean":
        return np.sqrt(out)
    if kind == "dot":
        return -out
    n = np.sqrt(na) * np.sqrt(nb)
    return np.where(n > 0, 1 - np.divide(out, n, where=n > 0, out=np.zeros(len(a))), np.inf)


def nearest_in(batches: Iterator[pa.RecordBatch], names: pa.Array, q: np.ndarray, k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest of these vectors of each query, ties by id, as batches of (query, id, distance).

    A product is off by some roundings at most; what is within twice that of the best ``k`` is looked at exactly.
    """
    dims = q.shape[1]
    width = max(1, PRODUCTS * dims // CHUNK)  # queries whose products with a chunk stay below PRODUCTS
    off = dims * 2e-14
    q2 = (q * q).sum(1)
    nq = np.sqrt(q2)
    kept = [(np.zeros(0, np.int64), None, np.zeros(0)) for _ in range(0, len(q), width)]
    best = np.full(len(q), np.inf)  # no less than the k-th distance so far (of Euclidean ones the square)

    def look(ids: np.ndarray, x: np.ndarray) -> None:
        x2 = (x * x).sum(1)
        nx = np.sqrt(x2)
        for b, low in enumerate(range(0, len(q), width)):
            own = slice(low, min(low + width, len(q)))
            d = q[own] @ x.T
            if kind == "cosine":
                n = nq[own, None] * nx[None, :]
                d = np.where(n > 0, 1 - np.divide(d, n, where=n > 0, out=np.zeros_like(d)), np.inf)
                slack = off
            elif kind == "euclidean":
                d = q2[own, None] + x2[None, :] - 2 * d
                slack = off * (q2[own] + x2.max())[:, None]
            else:
                d = -d
                slack = off * (nq[own] * nx.max())[:, None]
            near = ~(d > best[own, None] + slack)  # what is no number is looked at too
            if len(x) > k and near.sum() > 4 * k * len(near):
                bound = np.partition(d, k - 1, axis=1)[:, k - 1]
                best[own] = np.fmin(best[own], bound + (slack if np.isscalar(slack) else slack[:, 0]))
                near = ~(d > best[own, None] + slack)
            at, to = np.nonzero(near)
            if not len(at):
                continue
            at0, ids0, far0 = kept[b]
            at = at + low
            far = np.concatenate([far0, *(distances_of(kind, x[to[i : i + 65_536]], q[at[i : i + 65_536]]) for i in range(0, len(at), 65_536))])
            at, own_ids = np.concatenate([at0, at]), ids[to] if ids0 is None else np.concatenate([ids0, ids[to]])
            order = np.lexsort((own_ids if own_ids.dtype.kind in "iu" else np.unique(own_ids, return_inverse=True)[1], far, at))
            at, own_ids, far = at[order], own_ids[order], far[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            last = rank == k - 1
            best[at[last]] = np.fmin(best[at[last]], far[last] ** 2 if kind == "euclidean" else far[last])
            kept[b] = (at[rank < k], own_ids[rank < k], far[rank < k])

    ids, rows, size = [], [], 0
    kind_of = None

    def put() -> None:
        got = pa.concat_arrays(ids)
        look(got.to_numpy(zero_copy_only=False) if pa.types.is_integer(got.type) else np.array(got.to_pylist(), object), np.concatenate(rows))

    for batch in batches:
        if not batch.num_rows:
            continue
        kind_of = batch.column(0).type
        ids.append(batch.column(0))
        rows.append(np.asarray(batch.column(1).flatten(), float).reshape(-1, dims))
        size += rows[-1].nbytes
        if size >= CHUNK:
            put()
            ids, rows, size = [], [], 0
    if rows:
        put()
    for at, own, far in kept:
        for i in range(0, len(at), 65_536):
            yield pa.record_batch([names.take(pa.array(at[i : i + 65_536])), pa.array(own[i : i + 65_536], kind_of), pa.array(far[i : i + 65_536])], ["query", "id", "distance"])


def best_of(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest of each query; a window group limit cuts each task's rows before they are exchanged."""
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass
class Node:
    normal: np.ndarray | None = None
    bias: float = 0.0
    above: int = -1
    below: int = -1
    members: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    leaf: int = -1


class Tree:
    """A hyperplane tree over unit-free vectors; nodes in one list, the root first."""

    def __init__(self, vectors: np.ndarray, leaf: int, tests: int = 5, sample: int = 30, seed: int = SEED):
        self.v, self.size, self.tests, self.sample = vectors, max(1, leaf), tests, sample
        self.rng, self.nodes, self.leaves = np.random.default_rng(seed), [], 0
        self.grow(np.arange(len(vectors)))

    def plane(self, own: np.ndarray) -> tuple[np.ndarray, float] | None:
        best = None
        for _ in range(max(1, self.tests)):
            a, b = self.v[self.rng.choice(own, 2, replace=False)]
            if self.tests:
                for _ in range(3):  # two means, by a few assignments of a sample
                    probe = self.v[self.rng.choice(own, min(self.sample, len(own)), replace=False)]
                    near = ((probe - a) ** 2).sum(1) <= ((probe - b) ** 2).sum(1)
                    a, b = (probe[near].mean(0) if near.any() else a), (probe[~near].mean(0) if (~near).any() else b)
            normal = a - b
            bias = -float(normal @ (a + b) / 2) if self.tests else -float(np.median(self.v[own] @ normal))
            up = int((self.v[own] @ normal + bias >= 0).sum())
            if 0 < up < len(own) and (best is None or abs(2 * up - len(own)) < best[0]):
                best = (abs(2 * up - len(own)), normal, bias)
        return best and best[1:]

    def grow(self, own: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(Node())
        split = self.plane(own) if len(own) >= self.size and len(own) > 1 else None
        if split is None:
            self.nodes[at].members, self.nodes[at].leaf = own, self.leaves
            self.leaves += 1
            return at
        up = self.v[own] @ split[0] + split[1] >= 0
        self.nodes[at].normal, self.nodes[at].bias = split
        self.nodes[at].above, self.nodes[at].below = self.grow(own[up]), self.grow(own[~up])
        return at

    def depth(self, at: int = 0) -> int:
        n = self.nodes[at]
        return 1 if n.normal is None else 1 + max(self.depth(n.above), self.depth(n.below))

    def path(self, q: np.ndarray) -> list[int]:
        """Nodes on the way to the query's leaf, the root left out."""
        at, out = 0, []
        while self.nodes[at].normal is not None:
            at = self.nodes[at].above if q @ self.nodes[at].normal + self.nodes[at].bias >= 0 else self.nodes[at].below
            out.append(at)
        return out

    def leaf(self, q: np.ndarray) -> int:
        return self.nodes[([0] + self.path(q))[-1]].leaf

    def find(self, q: np.ndarray, least: int) -> np.ndarray:
        """Members of the leaves nearest by margin, until ``least`` are seen."""
        import heapq

        heap, got, seen = [(0.0, 0)], [], 0
        while heap and seen < least:
            far, at = heapq.heappop(heap)
            n = self.nodes[at]
            if n.normal is None:
                got.append(n.members)
                seen += len(n.members)
                continue
            m = float(q @ n.normal + n.bias)
            heapq.heappush(heap, (far, n.above if m >= 0 else n.below))
            heapq.heappush(heap, (max(far, abs(m)), n.below if m >= 0 else n.above))
        return np.concatenate(got) if got else np.zeros(0, np.int64)


#: Queries that are sent to the tasks at a time.
ASKED = 2_000

FOREST = "shard int, tree int, at int, normal array<double>, bias double, above int, below int, leaf int, members array<{0}>"


def forest(vectors: DataFrame, trees: int = 8, leaf: int = 64, tests: int = 5, sample: int = 30, seed: int = SEED, shard_rows: int = 200_000) -> DataFrame:
    """The nodes of all trees, root first: (shard, tree, at, normal, bias, above, below, leaf, members); write it to ask it often.

    Vectors are dealt by hash into shards of about ``shard_rows``; a task builds one tree of one shard.  Leaves
    are numbered within a tree and have the ids of their ``members``; the others have a plane and two children.
    """
    n = max(1, -(-vectors.count() // shard_rows))
    rows = vectors.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("shard")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids = part["id"].to_numpy()
        tree = Tree(np.stack(part["vector"].to_numpy()), leaf, tests, sample, seed + int(key[1]))
        out = [(int(key[0]), int(key[1]), at, None if x.normal is None else x.normal.tolist(), x.bias, x.above, x.below, x.leaf, ids[x.members].tolist()) for at, x in enumerate(tree.nodes)]
        return pd.DataFrame(out, columns=["shard", "tree", "at", "normal", "bias", "above", "below", "leaf", "members"])

    return rows.groupBy("shard", "tree").applyInPandas(one, FOREST.format(dict(vectors.dtypes)["id"]))


def planted(rows: pd.DataFrame) -> Tree:
    """A tree again from its nodes."""
    tree = Tree.__new__(Tree)
    rows = rows.sort_values("at")
    tree.nodes = [Node(None if n is None else np.array(n, float), b, up, down, np.array(m, object), leaf) for n, b, up, down, leaf, m in zip(rows.normal, rows.bias, rows.above, rows.below, rows.leaf, rows.members, strict=True)]
    return tree


def ask_forest(trees: DataFrame, queries: DataFrame, answer, schema: str) -> DataFrame:
    """``answer`` (tree, query id, query vector) -> rows of ``schema`` for every tree and query (id, vector).

    Queries are a stated set; they go to the tasks in blocks of about ``ASKED``, each a part of the plan.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def asking(held):
        def one(key, rows: pd.DataFrame) -> pd.DataFrame:
            tree = planted(rows)
            return pd.DataFrame([(int(key[0]), int(key[1]), name, *x) for name, q in zip(*held.value, strict=True) for x in answer(tree, q)], columns=["shard", "tree", "query", *names])

        return one

    blocks, out = max(1, -(-queries.count() // ASKED)), None
    for b in range(blocks):
        own = queries.select("id", "vector") if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "vector")
        asked = own.toPandas()
        held = trees.sparkSession.sparkContext.broadcast((asked["id"].tolist(), [np.array(list(v), float) for v in asked["vector"]]))
        got = trees.groupBy("shard", "tree").applyInPandas(asking(held), f"shard int, tree int, query {dict(queries.dtypes)['id']}, {schema}")
        out = got if out is None else out.unionByName(got)
    return out


def find_in_forest(trees: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, least: int) -> DataFrame:
    """(query, id, distance, rank): of the members that each tree finds, ``least`` a tree, the nearest by cosine, each id once."""
    kind = dict(vectors.dtypes)["id"]
    found = ask_forest(trees, queries, lambda tree, q: [(x,) for x in tree.find(q, max(least, k))], f"id {kind}").select("query", "id").distinct()
    pairs = found.join(vectors.select("id", "vector"), "id").join(queries.select(F.col("id").alias("query"), F.col("vector").alias("_q")), "query")
    return best_of(pairs.select("query", "id", distance("cosine", F.col("vector"), F.col("_q")).alias("distance")), k)


def leaves_of(trees: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, shard, tree, leaf, path): the leaf of each query and the nodes on the way to it, without the root."""

    def way(tree: Tree, q: np.ndarray) -> list[tuple[int, list[int]]]:
        path = tree.path(q)
        return [(tree.nodes[([0] + path)[-1]].leaf, path)]

    return ask_forest(trees, queries, way, "leaf int, path array<int>").select("query", "shard", "tree", "leaf", "path")


def depths(trees: DataFrame) -> DataFrame:
    """(shard, tree, depth): a tree of one leaf has depth 1."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(key[0])], "tree": [int(key[1])], "depth": [planted(rows).depth()]})

    return trees.groupBy("shard", "tree").applyInPandas(one, "shard int, tree int, depth int")


def forest_neighbours(vectors: DataFrame, queries: DataFrame, k: int, trees: int = 8, leaf: int = 64, tests: int = 5, sample: int = 30, least: int | None = None, seed: int = SEED, shard_rows: int = 200_000) -> DataFrame:
    """(query, id, distance, rank): approximate nearest by cosine from a forest that is built for this once."""
    with Scratch(vectors.sparkSession, "forest") as scratch:
        kept = scratch.cut(forest(vectors, trees, leaf, tests, sample, seed, shard_rows), "trees")
        return scratch.keep(find_in_forest(kept, vectors, queries, k, least or trees * k))


def by_euclid(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, distance, rank) of pairs, by Euclidean distance."""
    rows = pairs.select("query", "id").join(vectors.select("id", "vector"), "id").join(queries.select(F.col("id").alias("query"), F.col("vector").alias("_q")), "query")
    return best_of(rows.select("query", "id", distance("euclidean", F.col("vector"), F.col("_q")).alias("distance")), 2**31 - 1)


def with_others(near: DataFrame, vectors: DataFrame, queries: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """``near`` (query, id, distance, rank) and up to ``n`` other vectors of each query, ranked after its own.

    The others come from a pool of 64 n vectors, drawn by hash, of which each query takes those of its smallest hashes.
    """
    pool = vectors.select("id").withColumn("_u", uniform(seed, "id")).orderBy("_u", "id").limit(64 * n).select("id")
    pairs = queries.select(F.col("id").alias("query")).join(F.broadcast(pool), how="cross").join(near.select("query", "id"), ["query", "id"], "left_anti")
    drawn = best_of(pairs.withColumn("distance", uniform(seed + 1, "query", "id")), n).select("query", "id", F.col("rank").alias("_r"))
    last = near.groupBy("query").agg(F.max("rank").alias("_m"))
    far = by_euclid(drawn, vectors, queries).drop("rank").join(drawn, ["query", "id"]).join(last, "query", "left")
    return near.select("query", "id", "distance", "rank").unionByName(far.select("query", "id", "distance", (F.coalesce("_m", F.lit(0)) + F.col("_r")).alias("rank")))


def climb(edges: DataFrame, vectors: DataFrame, query: list[float], k: int, starts: int = 16, beam: int = 32, most: int = 30, kind: str = "cosine", seed: int = SEED, restarts: float = 0.05) -> DataFrame:
    """(id, distance): a search that climbs the graph from random nodes towards the query, a beam at a time.

    Each step opens the neighbours of the ``beam`` nearest nodes not opened yet, and a share ``restarts`` of as many random
    nodes; no node is looked at twice.  It ends after ``most`` steps, or when all nodes have been looked at.
    """
    from math import ceil

    from ..plans.loops import iterate

    far = vectors.select("id", distance(kind, F.col("vector"), F.array(*map(F.lit, query))).alias("distance"))
    begin = vectors.select("id").withColumn("_u", uniform(seed, "id")).orderBy("_u", "id").limit(starts).select("id").join(far, "id").withColumn("open", F.lit(True))

    def step(now: DataFrame, k: int) -> DataFrame:
        front = now.where("open").orderBy("distance", "id").limit(beam).select(F.col("id").alias("src"))
        fresh = vectors.select("id").withColumn("_u", uniform(seed + k + 1, "id")).orderBy("_u", "id").limit(ceil(beam * restarts)).select("id")
        reached = edges.join(F.broadcast(front), "src").select(F.col("dst").alias("id")).unionByName(fresh).distinct()
        new = reached.join(now.select("id"), "id", "left_anti").join(far, "id").withColumn("open", F.lit(True))
        old = now.join(F.broadcast(front.select(F.col("src").alias("id"), F.lit(True).alias("_f"))), "id", "left").select("id", "distance", (F.col("open") & F.col("_f").isNull()).alias("open"))
        return old.unionByName(new)

    with Scratch(edges.sparkSession, "climb") as scratch:
        edges = scratch.cut(edges.select("src", "dst"), "edges")  # every step reads it
        end = iterate(begin, step, most, lambda _, now: now.where("open").isEmpty())
    return end.orderBy("distance", "id").limit(k).select("id", "distance")
