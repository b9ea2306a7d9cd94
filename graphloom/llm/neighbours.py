"""Embedding near-duplicates: navigable small-world graphs per shard, queried by every vector.

Each shard of distinct vectors gets a hierarchy of proximity graphs, built in doubling batches with numpy.
Every distinct vector queries every shard by beam search; pairs found are confirmed by cosine in double
precision and united to components.  A shard's beam is widened until an audit against brute force passes;
if the widest one fails too, all queries of the shard are answered by brute force.  A query whose whole beam
is linked is answered by a scan of the shard, so large groups lose nothing.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, mix64
from ..operators.components import components

#: Links of a node above the ground layer, on it; beam while building, first beam of queries, widest beam.
M, M0, BUILD_BEAM, FIRST_BEAM, LAST_BEAM = 12, 24, 48, 24, 384
#: Shards at least; bytes of double-precision vectors of a shard, of a group of queries and of a packed block of queries, at most.
SHARDS, SHARD_BYTES, GROUP_BYTES, BLOCK_BYTES = 8, 64 << 20, 64 << 20, 1 << 20
#: The audit: probes of a shard with few links and with many, cosines to find them, vectors of all shards among them, the bytes these may take, and the share of its true links that a probe has to find on average.
AUDIT, AUDIT_CELLS, VISITORS, VISITOR_BYTES, RECALL = 256, 1 << 28, 4_096, 16 << 20, 0.995
#: What the searches of a shard give; see ``counted``.
SAID = "class string, home long, size long, shard long, whole boolean, n long, to array<string>, pairs array<struct<class:string,n:long>>"


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by their largest component first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row, in falling order."""
    if sims.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        sims, ids = np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)
    at = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)


class Graph:
    """A hierarchy over unit vectors: ``layers[l]`` is an array of neighbours (-1: none), of all nodes."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        self.v = vectors.astype(np.float32)
        n = len(self.v)
        u = (mix64(np.arange(n, dtype=np.uint64) + np.uint64(seed << 32)) >> np.uint64(11)).astype(float) / 2**53
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(M)).astype(int), 6)
        self.layers = [np.full((n, M0 if k == 0 else M), -1, np.int32) for k in range(int(self.level.max()) + 1)] if n else []
        self.order = np.argsort(-self.level, kind="stable")  # upper layers first: each node finds an entry above it
        self.entry = int(self.order[0]) if n else -1
        done, step = 0, 64
        while done < n:
            own = self.order[done : done + min(step, 1_024)]
            self.insert(own, done)
            done += len(own)
            step = max(64, done)

    def insert(self, own: np.ndarray, before: int) -> None:
        peers = self.v[own] @ self.v[own].T
        np.fill_diagonal(peers, -np.inf)
        at = np.full(len(own), self.entry)
        for k in range(len(self.layers) - 1, -1, -1):
            here = np.flatnonzero(self.level[own] >= k)
            if before:
                beam = BUILD_BEAM if len(here) else 1
                sims, ids = self.beam(self.v[own], at, k, beam)
                at = np.where(ids[:, 0] >= 0, ids[:, 0], at)
            else:
                sims, ids = np.full((len(own), 1), -np.inf, np.float32), np.full((len(own), 1), -1)
            if not len(here):
                continue
            s = np.concatenate([sims[here], peers[np.ix_(here, here)]], 1)
            i = np.concatenate([ids[here], np.broadcast_to(own[here], (len(here), len(here)))], 1)
            s, i = top(s, i, BUILD_BEAM)
            width = self.layers[k].shape[1]
            chosen = self.spread(s, i, M)
            self.layers[k][own[here], : chosen.shape[1]] = chosen
            self.back(k, np.repeat(own[here], chosen.shape[1]), chosen.ravel(), width)

    def spread(self, sims: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates, nearest first, none nearer to one chosen before than to the node; then the nearest left."""
        n, width = ids.shape
        valid = (ids >= 0) & np.isfinite(sims)
        own = self.v[np.maximum(ids, 0)]
        between = np.matmul(own, own.transpose(0, 2, 1))
        taken = np.zeros((n, width), bool)
        for j in range(width):
            near = (np.where(taken, between[:, :, j], -np.inf).max(1) > sims[:, j]) if j else np.zeros(n, bool)
            taken[:, j] = valid[:, j] & ~near & (taken.sum(1) < most)
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * width + np.arange(width)
        at = np.argsort(rank, axis=1)[:, :most]
        got = np.take_along_axis(ids, at, 1)
        return np.where(np.take_along_axis(valid, at, 1), got, -1).astype(np.int32)

    def back(self, k: int, source: np.ndarray, target: np.ndarray, width: int) -> None:
        """Links from ``target`` to ``source``; a node with too many keeps a spread of them."""
        ok = target >= 0
        source, target = source[ok], target[ok]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 512):
            part = slice(lo, lo + 512)
            most = int(count[part].max())
            new = np.full((len(nodes[part]), most), -1, np.int32)
            row = np.repeat(np.arange(len(nodes[part])), count[part])
            place = np.arange(len(row)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            new[row, place] = source[start[part][0] : start[part][0] + len(row)]
            ids = np.concatenate([self.layers[k][nodes[part]], new], 1)
            # A link that is there already doesn't count twice.
            by = np.sort(ids, axis=1)
            twice = np.zeros(ids.shape, bool)
            at = np.argsort(ids, axis=1, kind="stable")
            np.put_along_axis(twice, at, np.concatenate([np.zeros((len(ids), 1), bool), by[:, 1:] == by[:, :-1]], 1), 1)
            ids = np.where(twice, -1, ids)
            sims = np.einsum("nd,nmd->nm", self.v[nodes[part]], self.v[np.maximum(ids, 0)])
            sims, ids = top(np.where(ids >= 0, sims, -np.inf), ids, min(ids.shape[1], 3 * width))
            kept = self.spread(sims, ids, width)
            self.layers[k][nodes[part]] = -1
            self.layers[k][nodes[part], : kept.shape[1]] = kept

    def beam(self, q: np.ndarray, entry: np.ndarray, k: int, width: int, each: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query on layer ``k`` from its ``entry``: (similarities, nodes), falling, -1 where empty."""
        n, near = len(q), self.layers[k]
        sims = np.full((n, width), -np.inf, np.float32)
        ids = np.full((n, width), -1, np.int64)
        ids[:, 0], sims[:, 0] = entry, np.einsum("nd,nd->n", q, self.v[entry])
        open_ = ids >= 0
        seen = np.zeros((n, -(-len(self.v) // 8)), np.uint8)
        self.mark(seen, np.arange(n)[:, None], ids[:, :1])
        live = np.arange(n)
        while len(live):
            o = open_[live]
            at = np.argsort(~o, axis=1, kind="stable")[:, :each]  # rows are in falling order: the best open ones
            good = np.take_along_axis(o, at, 1)
            alive = good.any(1)
            live, at, good = live[alive], at[alive], good[alive]
            if not len(live):
                break
            o = o[alive]
            np.put_along_axis(o, at, False, 1)
            new = near[np.where(good, np.take_along_axis(ids[live], at, 1), 0)]
            new = np.where(good[:, :, None], new, -1).reshape(len(live), -1).astype(np.int64)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            known = (seen[live[:, None], np.maximum(new, 0) >> 3] >> (np.maximum(new, 0) & 7).astype(np.uint8)) & 1
            new = np.where((new >= 0) & (known == 0), new, -1)
            self.mark(seen, live[:, None], new)
            s = np.where(new >= 0, np.einsum("nd,nmd->nm", q[live], self.v[np.maximum(new, 0)]), -np.inf)
            s, i = np.concatenate([sims[live], s], 1), np.concatenate([ids[live], new], 1)
            f = np.concatenate([o, new >= 0], 1)
            at = np.argpartition(-s, width - 1, axis=1)[:, :width]
            at = np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)
            sims[live], ids[live], open_[live] = (np.take_along_axis(x, at, 1) for x in (s, i, f))
            open_[live] &= ids[live] >= 0
        return sims, ids

    @staticmethod
    def mark(seen: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        rows = np.broadcast_to(rows, ids.shape)[ids >= 0]
        ids = ids[ids >= 0]
        np.bitwise_or.at(seen, (rows, ids >> 3), (1 << (ids & 7)).astype(np.uint8))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(q), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            at = self.beam(q, at, k, 1)[1][:, 0]
        return self.beam(q, at, 0, width)


class Shard:
    """A shard's graph, its vectors in double precision, counts and ids, its beam (0: brute force), and its own components.

    ``visitors`` are (ids, unit vectors) of members of any shard, by which the search for others' queries is audited.
    """

    def __init__(self, ids: list[str], counts: np.ndarray, vectors: np.ndarray, least: float, visitors: tuple[list[str], np.ndarray] | None = None):
        order = np.argsort(np.array(ids, dtype=object), kind="stable")
        self.ids, self.counts, self.unit = [ids[i] for i in order], counts[order], units(vectors[order])
        self.graph, self.least = Graph(self.unit), least
        probes = self.probes() + self.foreign(visitors)
        self.n_probes = len(probes)
        self.width, self.recall = self.audited(probes)
        self.label = np.arange(len(self.ids))
        for q, found in self.links(self.unit):
            roots = {self.root(q), *(self.root(int(r)) for r in np.unique(self.label[found]))}
            for r in roots:
                self.label[r] = min(roots)
        self.label = np.array([self.root(i) for i in range(len(self.ids))])

    def root(self, i: int) -> int:
        while self.label[i] != i:
            self.label[i] = self.label[self.label[i]]
            i = int(self.label[i])
        return i

    def probes(self) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(vector, its place, its partners by brute force, itself left out), of members in an order by hash that have a partner.

        AUDIT members with fewer partners than the first beam holds and AUDIT with more are looked for, among AUDIT
        members at least and, beyond that, as many as AUDIT_CELLS cosines allow.
        """
        n = len(self.unit)
        order = np.argsort(mix64(np.arange(n, dtype=np.uint64)))[: max(AUDIT, AUDIT_CELLS // max(1, n))]
        few, many = [], []
        for lo in range(0, n, size := max(1, min(AUDIT, (8 << 20) // max(1, n)))):
            own = order[lo : lo + size]
            if not len(own) or (lo >= AUDIT and len(few) >= AUDIT):
                break
            near = self.unit[own] @ self.unit.T >= self.least
            near[np.arange(len(own)), own] = False
            for i, row in zip(own.tolist(), near, strict=True):
                partners = np.flatnonzero(row)
                held = few if len(partners) < FIRST_BEAM else many
                if len(partners) and len(held) < AUDIT:
                    held.append((self.unit[i], i, partners))
        return few + many

    def foreign(self, visitors: tuple[list[str], np.ndarray] | None) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(vector, -1, its partners by brute force) of visitors that are no members and have a partner: AUDIT with few and with many."""
        if visitors is None:
            return []
        own, few, many = set(self.ids), [], []
        at = [i for i, x in enumerate(visitors[0]) if x not in own]
        for i, partners in zip(at, self.scanned(visitors[1][at]), strict=True):
            held = few if len(partners) < FIRST_BEAM else many
            if len(partners) and len(held) < AUDIT:
                held.append((visitors[1][i], -1, partners))
        return few + many

    def audited(self, probes: list[tuple[np.ndarray, int, np.ndarray]]) -> tuple[int, float]:
        """The first beam, from FIRST_BEAM on and doubling, that passes the audit, and its recall; 0 and 1, for brute force, if LAST_BEAM doesn't pass.

        Recall is the mean over probes of the share of a probe's own partners that its search finds, so that a
        large group's many links don't outweigh a small group's few.  Probes with few partners and with many, and
        those that are members and those that are not, are averaged apart, and the lowest average counts.
        """
        few = np.array([len(x) < FIRST_BEAM for _, _, x in probes], bool)
        own = np.array([i >= 0 for _, i, _ in probes], bool)
        q = np.stack([v for v, _, _ in probes]) if probes else self.unit[:0]
        width = FIRST_BEAM
        while True:
            share = np.array([np.isin(x, got).mean() for (_, _, x), (_, got) in zip(probes, self.links(q, width), strict=True)])
            recall = min((float(share[x].mean()) for x in (few & own, ~few & own, few & ~own, ~few & ~own) if x.any()), default=1.0)
            if recall >= RECALL:
                return width, recall
            if width >= LAST_BEAM:
                return 0, 1.0
            width *= 2

    def links(self, q: np.ndarray, width: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(query, members at ``least`` cosine or more), confirmed in double precision, in the order of the queries."""
        for k, found, _ in self.searched(q, width):
            yield k, found

    def searched(self, q: np.ndarray, width: int | None = None) -> Iterator[tuple[int, np.ndarray, bool]]:
        """As ``links``, and whether the members come of a scan of the whole shard, so that none is missing."""
        width = width or self.width
        if not width:
            yield from ((k, found, True) for k, found in enumerate(self.scanned(q)))
            return
        size = int(max(16, min(1_024, (64 << 20) // max(1, len(self.unit) // 8))))
        for lo in range(0, len(q), size):
            part = q[lo : lo + size]
            sims, ids = self.graph.search(part.astype(np.float32), width)
            near = (sims >= self.least - 1e-3) & (ids >= 0)
            whole = near.all(1)  # the whole beam: there may be more of them
            scanned = self.scanned(part[whole])
            for k in range(len(part)):
                if whole[k]:
                    yield lo + k, next(scanned), True
                else:
                    own = ids[k][near[k]]
                    yield lo + k, own[self.unit[own] @ part[k] >= self.least] if len(own) else own, False

    def scanned(self, q: np.ndarray) -> Iterator[np.ndarray]:
        """The members at ``least`` cosine or more of each query, by brute force in blocks of queries."""
        size = max(1, (4 << 20) // max(1, len(self.unit)))
        for lo in range(0, len(q), size):
            yield from map(np.flatnonzero, q[lo : lo + size] @ self.unit.T >= self.least)


def counted(said: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, found): the rows of other classes linked to each class, a link counting for both ends whichever search found it.

    ``said`` has a row of each search (class and its own shard ``home``, ``shard`` asked, ``whole``, ``n``,
    ``pairs``) and the tallies of the scans (``whole`` null: of the rows of ``shard`` whose scans found the class).
    A scan misses nothing, so its count stands.  Any other search of a shard has the links that either side
    found: those that scans of the other side found, as tallied, and the distinct pairs of searches of both sides.
    """
    scans = scratch.cut(said.where("whole").select("class", "shard", "n"), "scans")
    met = scans.select("class", "shard")
    tallies = said.where("whole is null").groupBy("class", "shard").agg(F.sum("n").alias("n")).join(met, ["class", "shard"], "left_anti")
    pairs = said.where("not whole").select(F.col("class").alias("a"), F.col("home").alias("a_home"), "size", F.col("shard").alias("b_home"), F.explode("pairs").alias("b"))
    ends = pairs.select(F.col("a").alias("x"), F.col("a_home").alias("x_home"), F.col("b.class").alias("y"), F.col("b_home").alias("y_home"), F.col("b.n").alias("n"))
    ends = ends.unionByName(pairs.select(F.col("b.class").alias("x"), F.col("b_home").alias("x_home"), F.col("a").alias("y"), F.col("a_home").alias("y_home"), F.col("size").alias("n"))).distinct()
    ends = ends.join(met.toDF("x", "y_home"), ["x", "y_home"], "left_anti").join(met.toDF("y", "x_home"), ["y", "x_home"], "left_anti")
    every = scans.select("class", "n").unionByName(tallies.select("class", "n")).unionByName(ends.select(F.col("x").alias("class"), "n"))
    return every.groupBy("class").agg(F.sum("n").alias("found"))


def valid(v: Column) -> Column:
    """Whether a vector can link: not null, with finite components and not all of them zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", shards: int = SHARDS, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept; and audit_recall, the lowest of any shard, and
    audit_probes, the vectors with links that all audits together asked (0: there were none, and the recall says nothing).

    Two vectors link at a cosine of ``least`` or more; n_links counts the other rows linked directly, rows
    with the same vector included; component_id is the smallest id reachable.  Vectors that are null, empty,
    zero, or hold null or non-finite components, and rows without an id, link with nothing: their component
    is their own id.  Vectors of different lengths don't link.  Rows that repeat an id are rows of their own.

    Scale: rows with the same vector are one class with a count.  Classes are dealt into ``shards`` shards by
    hash, more once a shard would exceed ``shard_bytes``; every class queries every shard, in groups of
    ``group_bytes``, so a task holds one shard and some packed queries, whatever the dimension.  Of the links that a scan finds in a
    shard only their number, one edge for each of the shard's components and the sums of all scans for each
    member leave the task; of those that a beam finds also the pairs, fewer than the beam is wide.
    """
    spark = vectors.sparkSession
    v = F.transform(col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("v", F.when(valid(F.col("v")) & F.col("vec_id").isNotNull(), F.col("v")))
    rows = rows.withColumn("class", F.when(F.col("v").isNotNull(), F.md5(F.to_json(F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x))))))
    with Scratch(spark, "near") as scratch:
        classes = scratch.cut(rows.where("v is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v")), "classes")
        held = max((8 * r.d * r.n for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()), default=0)
        shards, groups = max(shards, -(-held // shard_bytes)), max(1, -(-held // group_bytes))
        longest = classes.agg(F.max(F.size("v")).alias("d")).first().d or 1
        some = classes.select("class", "v").orderBy(F.xxhash64(F.lit("visitor"), "class"), "class").limit(max(1, min(VISITORS, VISITOR_BYTES // (8 * longest)))).toPandas()
        visitors = spark.sparkContext.broadcast({d: (own["class"].tolist(), units(np.stack(own["v"].to_numpy()))) for d, own in some.groupby(some["v"].map(len))})
        keyed = classes.withColumn("d", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("class"), F.lit(shards)))

        def build(key, part: pd.DataFrame) -> pd.DataFrame:
            made = Shard(part["class"].tolist(), part["n"].to_numpy(), np.stack(part["v"].to_numpy()), least, visitors.value.get(int(key[0])))
            data = pickle.dumps(made, protocol=5)
            pieces = [data[i : i + (8 << 20)] for i in range(0, len(data), 8 << 20)]
            return pd.DataFrame({"d": int(key[0]), "shard": int(key[1]), "piece": range(len(pieces)), "data": pieces, "recall": made.recall, "probes": made.n_probes})

        index = scratch.cut(keyed.groupBy("d", "shard").applyInPandas(build, "d long, shard long, piece long, data binary, recall double, probes long"), "index")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for d, part in batch.groupby("d"):
                    size = max(1, BLOCK_BYTES // (8 * int(d)))
                    for lo in range(0, len(part), size):
                        own = part.iloc[lo : lo + size]
                        homes, sizes = (own[x].to_numpy(np.int64).tobytes() for x in ("shard", "n"))
                        yield pd.DataFrame({"d": [int(d)], "ids": ["".join(own["class"])], "homes": [homes], "sizes": [sizes], "data": [np.stack(own["v"].to_numpy()).tobytes()]})

        packed = scratch.cut(keyed.select("class", "v", "d", "shard", "n").mapInPandas(pack, "d long, ids string, homes binary, sizes binary, data binary"), "packed")
        spread = packed.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
        copies = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))

        def query(key, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out, tally = [], {}
            if len(own):
                shard = pickle.loads(b"".join(own.sort_values("piece")["data"]))
                place = {x: j for j, x in enumerate(shard.ids)}
                for ids, homes, many, data in zip(asked["ids"], asked["homes"], asked["sizes"], asked["data"], strict=True):
                    names = [ids[i : i + 32] for i in range(0, len(ids), 32)]
                    homes, many = np.frombuffer(homes, np.int64).tolist(), np.frombuffer(many, np.int64).tolist()
                    q = np.frombuffer(data, float).reshape(len(names), -1)
                    for k, found, whole in shard.searched(units(q)):
                        to = [shard.ids[j] for j in np.unique(shard.label[found])]
                        found = found[found != place.get(names[k], -1)]
                        if whole:
                            tally.setdefault(homes[k], np.zeros(len(shard.ids), np.int64))[found] += many[k]
                        if whole or len(found):
                            pairs = [] if whole else [{"class": shard.ids[j], "n": int(shard.counts[j])} for j in found]
                            out.append((names[k], homes[k], many[k], int(key[1]), whole, int(shard.counts[found].sum()), to, pairs))
                for home, n in tally.items():
                    out += [(shard.ids[j], int(key[1]), int(shard.counts[j]), home, None, int(n[j]), [], []) for j in np.flatnonzero(n)]
            return pd.DataFrame(out, columns=["class", "home", "size", "shard", "whole", "n", "to", "pairs"])

        said = spread.groupBy("d", "shard", "group").cogroup(copies.groupBy("d", "shard", "group")).applyInPandas(query, SAID)
        said = scratch.cut(said, "said")
        edges = said.select(F.col("class").alias("a"), F.explode("to").alias("b")).where("a <> b")
        parts = components(edges, checkpoint="near-cc")
        # A class's own rows count among its links, less the row itself.
        own = classes.select("class", "n", "least")
        found = counted(said, scratch)
        info = own.join(found, "class", "left").join(parts.withColumnRenamed("node", "class"), "class", "left")
        info = info.withColumn("component", F.coalesce("component", "class"))
        # A key of its own makes both sides of the join exchange, so that adaptive execution splits a large component.
        low = info.groupBy("component").agg(F.min("least").alias("component_id")).select(F.concat(F.lit("c"), "component").alias("_component"), "component_id")
        info = info.withColumn("_component", F.concat(F.lit("c"), "component")).join(low, "_component").select(F.concat(F.lit("c"), "class").alias("_class"), (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
        audit = index.where("piece = 0").agg(F.min("recall").alias("recall"), F.coalesce(F.sum("probes"), F.lit(0)).alias("probes")).first()
        slim = rows.select("vec_id", F.concat(F.lit("c"), "class").alias("_class")).join(info, "_class", "left")
        return scratch.keep(
            slim.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id"))
            .withColumns({"audit_recall": F.lit(audit.recall).cast("double"), "audit_probes": F.lit(audit.probes).cast("long")})
        )
