"""Feature embeddings trained by gradient descent: embedding propagation and listwise ranking.

A pass deals the nodes into batches by hash; a batch's gradients are closed-form numpy in one task, summed per
feature by an aggregation, and applied by Adam as a column update.  Everything a batch needs is joined to it:
no task holds all features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from math import cos, exp, log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chance import SEED, uniform
from ..plans.loops import iterate
from ..session import Scratch
from .embedding import random_vectors
from .graphs import degrees
from .walks import walk_ends


@dataclass(frozen=True)
class Loss:
    """margin, contrastive, starspace, rank, rankspace or ppr, with its margins, temperature and number of negatives.

    ppr is the margin loss with positives from walks that end with chance ``restart`` a step, in place of neighbours.
    """

    kind: str = "margin"
    gamma: float = 1.0
    other: float = 0.0
    negatives: int = 1
    restart: float = 0.25

    def __post_init__(self) -> None:
        if self.kind not in ("margin", "contrastive", "starspace", "rank", "rankspace", "ppr"):
            raise ValueError(f"no loss {self.kind!r}")

    def value_and_gradients(self, t: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Of the reconstruction ``t``, the node's own ``h`` and negatives ``u``: (loss, d/dt, d/dh, d/du)."""
        gt, gh, gu = np.zeros_like(t), np.zeros_like(h), np.zeros_like(u)
        if self.kind in ("margin", "ppr"):
            dp, a = euclid(t, h)
            total, on = 0.0, 0
            for i in range(len(u)):
                dn, b = euclid(t, u[i])
                x = self.gamma + dp - dn
                if x > 0:
                    total, on = total + x, on + 1
                    gt += a - b
                    gh -= a
                    gu[i] += b
            k = max(1, on)
            return total / k, gt / k, gh / k, gu / k
        if self.kind == "contrastive":
            # Of unit vectors: the reconstruction as near the node as ``gamma``, negatives no nearer to it than ``other``; terms above 0 are averaged.
            cp, at, ah = cosine(t, h)
            terms = [(self.gamma - cp, -at, -ah, None, None)] + [(c - self.other, None, bh, bu, i) for i, x in enumerate(u) for c, bh, bu in [cosine(h, x)]]
            on = [x for x in terms if x[0] > 0]
            k = max(1, len(on))
            for _, dt, dh, du, i in on:
                gh += dh / k
                if i is None:
                    gt += dt / k
                else:
                    gu[i] += du / k
            return sum(x[0] for x in on) / k, gt, gh, gu
        if self.kind == "starspace":
            cp, at, ah = cosine(t, h)
            total, on = 0.0, 0
            for i in range(len(u)):
                cn, bh, bu = cosine(h, u[i])
                x = self.gamma - (cp - cn)
                if x > 0:
                    total, on = total + x, on + 1
                    gt -= at
                    gh += bh - ah
                    gu[i] += bu
            k = max(1, on)
            return total / k, gt / k, gh / k, gu / k
        if self.kind == "rankspace":
            both = [replace(self, kind=k).value_and_gradients(t, h, u) for k in ("starspace", "rank")]
            return tuple(x + y for x, y in zip(*both, strict=True))
        if self.kind == "rank":
            s = np.append(u @ h, t @ h) if len(u) else np.array([t @ h])
            p = np.exp(s - s.max())
            p /= p.sum()
            if p[-1] >= self.gamma:
                return 0.0, gt, gh, gu
            g = p.copy()
            g[-1] -= 1
            gh += (u.T @ g[:-1] if len(u) else 0) + t * g[-1]
            gt += h * g[-1]
            gu += np.outer(g[:-1], h) if len(u) else 0
            return -float(np.log(max(p[-1], 1e-30))), gt, gh, gu
        raise ValueError(f"unknown loss {self.kind}")


def euclid(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """(distance, its gradient by ``a``; by ``b`` it is the negative)."""
    d = a - b
    n = float(np.sqrt(d @ d))
    return n, d / n if n > 1e-12 else np.zeros_like(d)


def cosine(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    na, nb = float(np.sqrt(a @ a)), float(np.sqrt(b @ b))
    if na < 1e-12 or nb < 1e-12:
        return 0.0, np.zeros_like(a), np.zeros_like(b)
    c = float(a @ b) / (na * nb)
    return c, b / (na * nb) - c * a / na**2, a / (na * nb) - c * b / nb**2


def masked(n: int, window: int | None = None, chosen: int | None = None, rng: np.random.Generator | None = None) -> np.ndarray | None:
    """Which features each of ``n`` looks at: those within ``window`` places, or ``chosen`` ones drawn for it; None is all."""
    if window is not None:
        i = np.arange(n)
        return np.abs(i[:, None] - i[None, :]) <= window
    if chosen is not None and chosen < n:
        order = np.argsort((rng or np.random.default_rng(SEED)).random((n, n)), axis=1)
        return np.argsort(order, axis=1) < max(1, chosen)
    return None


def attention_shares(q: np.ndarray, k: np.ndarray, mask: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """Softmax of q k / sqrt(d) by row, of the places in ``mask`` only; products count ``times`` as often."""
    s = q @ k.T / np.sqrt(q.shape[1])
    if times is not None:
        s = s * times
    if mask is not None:
        s = np.where(mask, s, -np.inf)
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, window: int | None = None) -> np.ndarray:
    """Weights of rows over columns: softmax of q k / sqrt(d), within ``window`` positions if given, times v."""
    return attention_shares(q, k, masked(len(q), window)) @ v


@dataclass(frozen=True)
class Attention:
    """How a node's vector comes of its features' [Q1..Qh, K1..Kh, V1..Vh]: heads, width of Q and K, and what a feature looks at."""

    heads: int = 1
    d_k: int = 1
    window: int | None = None
    chosen: int | None = None

    def width(self, dims: int) -> int:
        return self.heads * (2 * self.d_k + dims)

    def build(self, vectors: np.ndarray, names: list | None = None, rng: np.random.Generator | None = None) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """(a node's vector, the gradient by each row of ``vectors`` given that by the vector).

        Attention of each head, rows averaged, heads averaged; one feature alone gives its first head's value.  With all
        features in sight, a product of two that occur a and b times in the bag counts a * b times.
        """
        n, h, w = len(vectors), self.heads, self.d_k
        d = vectors.shape[1] // h - 2 * w
        at = lambda head, part: slice(head * w + part * h * w, (head + 1) * w + part * h * w) if part < 2 else slice(2 * h * w + head * d, 2 * h * w + (head + 1) * d)
        if n == 1:

            def alone(g: np.ndarray) -> np.ndarray:
                out = np.zeros_like(vectors)
                out[0, at(0, 2)] = g
                return out

            return vectors[0, at(0, 2)].copy(), alone
        mask = masked(n, self.window, self.chosen, rng)
        times = None
        if names is not None and self.window is None and self.chosen is None and len(set(names)) < n:
            c = np.array([names.count(x) for x in names], float)
            times = np.outer(c, c)
        heads = [[vectors[:, at(i, part)] for part in range(3)] for i in range(h)]
        shares = [attention_shares(q, k, mask, times) for q, k, _ in heads]

        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(vectors)
            each = np.tile(g / (n * h), (n, 1))
            for i, ((q, k, v), a) in enumerate(zip(heads, shares, strict=True)):
                by_share = each @ v.T
                by_score = a * (by_share - (a * by_share).sum(1, keepdims=True)) / np.sqrt(w)
                if times is not None:
                    by_score = by_score * times
                out[:, at(i, 0)] += by_score @ k
                out[:, at(i, 1)] += by_score.T @ q
                out[:, at(i, 2)] += a.T @ each
            return out

        return np.mean([(a @ v).sum(0) / n for a, (_, _, v) in zip(shares, heads, strict=True)], axis=0), back

    def around(self, bags: list[tuple[list, np.ndarray]], rng: np.random.Generator | None = None) -> tuple[np.ndarray, Callable[[np.ndarray], list[np.ndarray]]]:
        """Of several nodes: the average of their vectors."""
        built = [self.build(v, names, rng) for names, v in bags]
        return np.mean([x for x, _ in built], axis=0), lambda g: [back(g / len(built)) for _, back in built]


@dataclass(frozen=True)
class Averaged:
    """A node's vector is the mean of its features' ones; several nodes' is the mean over all of their features."""

    def width(self, dims: int) -> int:
        return dims

    def build(self, vectors: np.ndarray, names: list | None = None, rng: np.random.Generator | None = None) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        return vectors.mean(0), lambda g: np.tile(g / len(vectors), (len(vectors), 1))

    def around(self, bags: list[tuple[list, np.ndarray]], rng: np.random.Generator | None = None) -> tuple[np.ndarray, Callable[[np.ndarray], list[np.ndarray]]]:
        n = sum(len(v) for _, v in bags)
        return np.concatenate([v for _, v in bags]).mean(0), lambda g: [np.tile(g / n, (len(v), 1)) for _, v in bags]


def attended(vectors: np.ndarray, heads: int, d_k: int, window: int | None = None) -> np.ndarray:
    """A node's vector from its features' [Q1..Qh, K1..Kh, V1..Vh]: attention of each head, heads averaged, rows averaged."""
    return Attention(heads, d_k, window).build(vectors)[0]


def cosine_rate(step: int, steps: int, rate: float, low: float | None = None, warm: float = 0.2) -> float:
    """A linear rise from ``low`` (default: a hundredth) over the share ``warm`` of the steps, then along half a cosine of all steps."""
    low, t, up = rate / 100 if low is None else low, step + 1, int(warm * steps)
    share = t / up if t <= up else 0.5 * (1 + cos(pi * t / max(1, steps)))
    return low + (rate - low) * share


def exponential_rate(step: int, rate: float, decay: float, low: float = 0.0) -> float:
    return max(low, rate * decay**step)


def adam(state: DataFrame, grads: DataFrame, t: int, rate: float, decay: float = 0.0) -> DataFrame:
    """(feat, vector, m, v) after a step with the summed gradients (feat, g) of it; a feature without one stays."""
    b1, b2 = 0.9, 0.999
    rows = state.join(grads, "feat", "left")
    m = F.zip_with("m", "g", lambda a, b: b1 * a + (1 - b1) * b)
    v = F.zip_with("v", "g", lambda a, b: b2 * a + (1 - b2) * b * b)
    move = F.zip_with(m, v, lambda a, b: (a / (1 - b1**t)) / (F.sqrt(b / (1 - b2**t)) + 1e-8))
    new = F.zip_with("vector", move, lambda x, d: x * (1 - rate * decay) - rate * d)
    has = F.col("g").isNotNull()
    return rows.select("feat", F.when(has, new).otherwise(F.col("vector")).alias("vector"), F.when(has, m).otherwise(F.col("m")).alias("m"), F.when(has, v).otherwise(F.col("v")).alias("v"))


def summed(grads: DataFrame) -> DataFrame:
    """(feat, g): gradients of all batches added up, dimension by dimension."""
    from ..functions.vectors import assemble

    parts = grads.select("feat", F.posexplode("g").alias("_pos", "_x")).where(~F.isnan("_x")).groupBy("feat", "_pos").agg(F.sum("_x").alias("_s"))
    return assemble(parts, ["feat"], "g")


def bags(features: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node, feats, vecs): a node's features in order with their vectors."""
    rows = features.join(vectors.select("feat", "vector"), "feat")
    return rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "feat", "vector"))).alias("b")).select("node", F.transform("b", lambda x: x["feat"]).alias("feats"), F.transform("b", lambda x: x["vector"]).alias("vecs"))


def propagate_embeddings(
    edges: DataFrame, features: DataFrame, dims: int = 100, passes: int = 100, alpha: float = 0.1, loss: Loss = Loss(), batch: int = 50, max_neighbours: int = 10, weighting: tuple[str, float] | None = None,
    noise: float = 0.0, valid: float = 0.1, vectors: DataFrame | None = None, seed: int = SEED, model: Averaged | Attention = Averaged(), hard: int = 0, updates: int = 1,
    watch: Callable[[int, float, float | None], None] | None = None,
) -> tuple[DataFrame, list[float]]:
    """(feature vectors (feat, vector), training loss of each step) by embedding propagation.

    A node's own vector h is built of its features' vectors by ``model``; ~h is built of its neighbours (``max_neighbours``
    by hash), or for the loss ppr of the ends of walks; the loss compares them with those of negative nodes: ``hard`` of
    them from the ends of its walks that are no neighbours, the others drawn by hash from the nodes of its task, which
    are dealt anew each pass.  Losses and gradients that are not finite are dropped.
    ``weighting``: ("log", _) over ln(1 + degree) or ("exponential", w) over degree ** w.  ``noise`` falls to 1e-9 at the end.
    ``vectors`` to start from are used as they are; features without one begin at pseudo-random unit vectors.
    A pass over the nodes is ``updates`` steps, each with a share of them, one state and one Adam step.
    A share ``valid`` of the nodes is never learnt from; ``watch`` is told the pass, its loss and the loss of these (None without any).
    Walks are drawn once, eight for each hard negative or positive that is asked for, and each pass takes some of them.
    """
    with Scratch(edges.sparkSession, "training") as scratch:
        edges, features = scratch.cut(edges.select("src", "dst", *(["p"] if "p" in edges.columns else [])), "edges"), scratch.cut(features.select("node", "pos", "feat"), "features")  # built once; every step reads them
        return _propagate_embeddings(scratch, edges, features, dims, passes, alpha, loss, batch, max_neighbours, weighting, noise, valid, vectors, seed, model, hard, updates, watch)


def _propagate_embeddings(
    scratch: Scratch, edges: DataFrame, features: DataFrame, dims: int, passes: int, alpha: float, loss: Loss, batch: int, max_neighbours: int, weighting: tuple[str, float] | None, noise: float, valid: float,
    vectors: DataFrame | None, seed: int, model: Averaged | Attention, hard: int, updates: int, watch: Callable[[int, float, float | None], None] | None,
) -> tuple[DataFrame, list[float]]:
    spark = edges.sparkSession
    feats = features.select(F.col("feat").alias("id")).distinct()
    width = model.width(dims)
    begin = random_vectors(feats, width, seed).withColumnRenamed("id", "feat")
    if vectors is not None:
        begin = begin.join(vectors.select("feat", F.col("vector").alias("_w")), "feat", "left").select("feat", F.coalesce("_w", "vector").alias("vector"))
    zero = F.array_repeat(F.lit(0.0), width)
    nodes = features.select("node").distinct()
    parts = max(1, nodes.count() // max(1, batch * 32))
    deg = scratch.cut(degrees(edges).withColumnRenamed("id", "node"), "degrees")
    roots = nodes.select(F.col("node").alias("id")).join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    by_chance = lambda rows, most, s, *keys: rows.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(uniform(s, *keys), *keys))).where(F.col("_r") <= most).select("node", "_n")
    steps = passes * updates
    decay = exp((log(1e-9) - log(noise)) / max(1, steps)) if noise > 0 else 1.0
    losses: list[float] = []
    if spark.sparkContext.getCheckpointDir() is None:
        from ..session import shared_dir

        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    far = met = None
    if hard:
        held = nodes.where(uniform(seed, "node") < valid)
        ends = walk_ends(edges, roots, 8 * hard, 0.25, 10, seed + 1).where("node <> root").select(F.col("root").alias("node"), F.col("node").alias("_n")).distinct()
        far = ends.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("_n")), ["node", "_n"], "left_anti").join(held.withColumnRenamed("node", "_n"), "_n", "left_anti").checkpoint()
    if loss.kind == "ppr":
        met = walk_ends(edges, roots, 8 * loss.negatives, loss.restart, 10, seed + 2).select(F.col("root").alias("node"), "walk", F.when(F.col("node") == F.col("root"), F.col("first")).otherwise(F.col("node")).alias("_n")).checkpoint()
    near = by_chance(edges.select(F.col("src").alias("node"), F.col("dst").alias("_n")), max_neighbours, seed, "node", "_n")
    near = scratch.cut(near, "near") if met is None else near

    def step(now: DataFrame, k: int) -> DataFrame:
        turn, part_of = divmod(k, updates)
        rate = cosine_rate(k, steps, alpha)
        spread = exponential_rate(k, noise, decay)
        every = bags(features, now)
        owned = every.join(roots.withColumnRenamed("id", "node"), "node", "left_semi").join(deg, "node").withColumn("held", uniform(seed, "node") < valid)
        if updates > 1:
            owned = owned.where("held" if part_of == updates - 1 else "false").unionByName(owned.where(~F.col("held") & (F.floor(uniform(seed + 31 * turn, "node") * updates) == part_of)))
        owned = owned.withColumn("part", F.floor(uniform(seed + 17 * turn + 1, "node") * parts).cast("int"))
        others = every.select(F.col("node").alias("_n"), F.col("feats").alias("_f"), F.col("vecs").alias("_v"))
        asked = (near if met is None else by_chance(met, loss.negatives, seed + 13 * turn, "node", "walk")).withColumn("role", F.lit(1))
        if far is not None:
            asked = asked.unionByName(by_chance(far, min(hard, loss.negatives), seed + 11 * turn, "node", "_n").withColumn("role", F.lit(2)))
        shown = owned.select("part", "held", "node").join(asked, "node").join(others, "_n")
        shown = shown.select("part", "held", "node", "role", F.col("_n").cast("string").alias("other"), F.col("_f").alias("feats"), F.col("_v").alias("vecs"), F.lit(0).cast("long").alias("degree"))
        selves = owned.select("part", "held", "node", F.lit(0).alias("role"), F.lit("").alias("other"), "feats", "vecs", F.col("degree").cast("long"))

        def gradients(key, rows: pd.DataFrame) -> pd.DataFrame:
            learn = not key[1]
            rng = np.random.default_rng([seed, k, int(key[0]), int(learn)])
            rows = rows.sort_values(["node", "role", "other"])
            bag_of = lambda f, v: (list(f), np.array(list(map(list, v)), float))
            own = rows[rows.role == 0]
            degree = dict(zip(own.node, own.degree, strict=True))
            bag = {n: bag_of(f, v) for n, f, v in zip(own.node, own.feats, own.vecs, strict=True)}
            names, sums, total, count = list(bag), {}, 0.0, 0

            def add(feats: list, grads: np.ndarray) -> None:
                for f, g in zip(feats, grads, strict=True):
                    sums[f] = sums[f] + g if f in sums else g

            for node, given in rows[rows.role > 0].groupby("node"):
                met_bags, hard_bags = ([bag_of(f, v) for f, v in zip(x.feats, x.vecs, strict=True)] for x in (given[given.role == 1], given[given.role == 2]))
                if node not in bag or not met_bags:
                    continue
                feats, vecs = bag[node]
                picks = [names[i] for i in rng.integers(0, len(names), 4 * loss.negatives) if names[i] != node]
                against = (hard_bags + [bag[p] for p in picks])[: loss.negatives]
                t, back_t = model.around(met_bags, rng)
                h, back_h = model.build(vecs, feats, rng)
                built = [model.build(v, f, rng) for f, v in against]
                u = np.array([x for x, _ in built]).reshape(-1, dims)
                value, gt, gh, gu = loss.value_and_gradients(t, h, u)
                d = max(1.0, float(degree[node]))
                scale = 1.0 if weighting is None else 1 / max(1e-9, np.log1p(d)) if weighting[0] == "log" else d ** -weighting[1]
                if not np.isfinite(value):
                    continue
                total, count = total + value * scale, count + 1
                if not learn:
                    continue
                for (f, _), g in zip(met_bags, back_t(gt * scale), strict=True):
                    add(f, g)
                add(feats, back_h(gh * scale))
                for (f, _), (_, back), g in zip(against, built, gu, strict=True):
                    add(f, back(g * scale))
            if spread > 0:
                sums = {f: g + rng.normal(0, spread, width) for f, g in sums.items()}
            out = [(f, g.tolist(), None, None, False) for f, g in sums.items() if np.isfinite(g).all()] + [(None, None, float(total), int(count), not learn)]
            return pd.DataFrame(out, columns=["feat", "g", "loss", "n", "held"])

        got = selves.unionByName(shown).groupBy("part", "held").applyInPandas(gradients, "feat string, g array<double>, loss double, n long, held boolean").checkpoint()
        said = {r.held: r.l / max(1, r.n) for r in got.where("feat is null").groupBy("held").agg(F.sum("loss").alias("l"), F.sum("n").alias("n")).collect()}  # two rows at most
        losses.append(said.get(False, 0.0))
        if watch is not None and part_of == updates - 1:
            watch(turn, float(np.mean(losses[-updates:])), said.get(True))
        return adam(now, summed(got.where("feat is not null").select("feat", "g")), k + 1, rate)

    end = iterate(begin.select(F.col("feat").cast("string").alias("feat"), "vector", zero.alias("m"), zero.alias("v")), step, steps)
    return end.select("feat", "vector"), losses


def list_loss(scores: np.ndarray, target: np.ndarray, kind: str = "listnet") -> tuple[float, np.ndarray]:
    """(loss, gradient by ``scores``) of a list whose item scores are exp(q e).

    listnet: cross entropy of the target with the softmax of exp(score), of items whose softmax is not above their target.
    listmle: the negative log likelihood of the list's order under exp(score).
    """
    y = np.exp(np.clip(scores, -30, 30))
    if kind == "listnet":
        p = np.exp(y - y.max())
        p /= p.sum()
        on = (target > 0) & (p <= target)
        value = -float((target[on] * np.log(np.maximum(p[on], 1e-30))).sum())
        g = (p * target[on].sum() - np.where(on, target, 0.0)) * y
        return value, g
    tail = np.cumsum(y[::-1])[::-1]
    value = -float(np.log(y / tail).sum())
    g = y * np.cumsum(1 / tail) - 1
    return value, g


def rank_features(walk_scores: DataFrame, features: DataFrame, dims: int = 32, passes: int = 20, alpha: float = 0.05, k: int = 10, negatives: int = 5, kind: str = "listnet", compression: float = 1.0, batch: int = 1_000, decay: float = 0.0, seed: int = SEED) -> tuple[DataFrame, list[float]]:
    """(feature vectors, loss of each pass): learnt so that exp(q e) orders a node's walk library.

    ``walk_scores`` (root, id, score): the ``k`` best (to 12 digits, ties by id) of each root other than itself are its list, scores to
    the power ``compression`` normalised as target; ``negatives`` nodes by hash follow with target 0.
    """
    scratch = Scratch(walk_scores.sparkSession, "lists")
    w = Window.partitionBy("root").orderBy(F.round("score", 12).desc(), "id")
    lists = walk_scores.where("root <> id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("s", F.pow("score", F.lit(compression)))
    lists = lists.join(lists.groupBy("root").agg(F.sum("s").alias("_t")), "root").select("root", "id", "rank", (F.col("s") / F.col("_t")).alias("target"))
    lists = scratch.cut(lists, "lists")  # every pass reads them
    feats = features.select(F.col("feat").cast("string").alias("id")).distinct()
    zero = F.array_repeat(F.lit(0.0), dims)
    begin = random_vectors(feats, dims, seed).select(F.col("id").alias("feat"), "vector", zero.alias("m"), zero.alias("v"))
    parts = max(1, lists.select("root").distinct().count() // batch)
    losses: list[float] = []

    def step(now: DataFrame, p: int) -> DataFrame:
        all_bags = bags(features, now)
        rows = lists.unionByName(lists.select("root").distinct().select("root", F.col("root").alias("id"), F.lit(0).alias("rank"), F.lit(0.0).alias("target")))
        rows = rows.join(all_bags.withColumnRenamed("node", "id"), "id").withColumn("part", F.floor(uniform(seed + p, "root") * parts).cast("int"))

        def gradients(key, part: pd.DataFrame) -> pd.DataFrame:
            rng, sums, total, count = np.random.default_rng([seed, p, int(key[0])]), {}, 0.0, 0
            bag = {i: (list(f), np.array(list(map(list, v)), float)) for i, f, v in zip(part.id, part.feats, part.vecs, strict=True)}
            names = sorted(bag)
            for root, own in part.groupby("root"):
                own = own[own["rank"] > 0].sort_values("rank")
                if root not in bag or not len(own):
                    continue
                ids = own.id.tolist()
                ids += [x for x in (names[i] for i in rng.integers(0, len(names), 3 * negatives)) if x != root and x not in ids][:negatives]
                target = np.zeros(len(ids))
                target[: len(own)] = own.target
                q, e = bag[root][1].mean(0), np.array([bag[i][1].mean(0) for i in ids])
                value, g = list_loss(e @ q, target, kind)
                if not np.isfinite(value):
                    continue
                total, count = total + value, count + 1
                for i, d in [(root, e.T @ g)] + [(i, q * x) for i, x in zip(ids, g, strict=True)]:
                    for f in bag[i][0]:
                        sums[f] = sums.get(f, 0) + d / len(bag[i][0])
            out = [(f, np.asarray(g).tolist(), None, None) for f, g in sums.items() if np.isfinite(g).all()] + [(None, None, float(total), int(count))]
            return pd.DataFrame(out, columns=["feat", "g", "loss", "n"])

        got = rows.select("part", "root", "id", "rank", "target", "feats", "vecs").groupBy("part").applyInPandas(gradients, "feat string, g array<double>, loss double, n long").checkpoint()
        said = got.where("feat is null").agg(F.sum("loss").alias("l"), F.sum("n").alias("n")).first()
        losses.append((said.l or 0.0) / max(1, said.n or 0))
        return adam(now, summed(got.where("feat is not null").select("feat", "g")), p + 1, cosine_rate(p, passes, alpha), decay)

    with scratch:
        return iterate(begin, step, passes).select("feat", "vector"), losses
