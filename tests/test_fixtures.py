"""Golden values on small graphs, worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import api
from graphloom.functions import vectors
from graphloom.operators import clustering, embedding, evaluation, features, graphs, nearest, policy, ranking, training, walks


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows, normal=True: (graphs.normalized if normal else lambda x: x)(spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, weight double"))


def as_dict(df, *cols):
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    return {r[:-1] if len(r) > 2 else r[0]: r[-1] for r in rows}


FIVE = [(0, 1, 1), (1, 1, 3), (1, 2, 2), (2, 0, 2.5), (1, 0, 10)]


def test_probabilities_and_cdf(make):
    e = make(FIVE)
    p = as_dict(e.where("src = 1"), "dst", "p")
    assert p == pytest.approx({0: 10 / 15, 1: 3 / 15, 2: 2 / 15})
    c = graphs.cumulative(e)
    assert as_dict(c.where("src = 1"), "dst", "cdf") == pytest.approx({0: 10 / 15, 1: 13 / 15, 2: 1.0})
    assert as_dict(graphs.from_cumulative(c).where("src = 1"), "dst", "p") == pytest.approx(p)
    zero = make([(0, 1, 0), (0, 2, 0)])
    assert as_dict(zero, "dst", "p") == {1: 0.5, 2: 0.5}


def test_degrees_and_duplicates(make):
    assert as_dict(graphs.degrees(make([(0, 2, 1), (2, 0, 2)])), "id", "degree") == {0: 1, 2: 1}
    assert as_dict(graphs.deduplicated(make([(0, 1, 1), (0, 1, 2)], False)), "src", "dst", "weight") == {(0, 1): 3.0}
    assert graphs.undirected(make([(3, 3, 1)], False)).count() == 2


def test_transposed(make):
    t = graphs.transposed(make([(0, 2, 1), (1, 2, 3), (1, 0, 1)]))
    assert as_dict(t.where("src = 2"), "dst", "p") == pytest.approx({0: 1 / 1.75, 1: 0.75 / 1.75})


HOPS = [(0, 1, 1), (1, 1, 3), (1, 2, 2.5), (2, 0, 10), (2, 3, 1)]


def test_landmarks(make):
    e = make(HOPS)
    top = graphs.top_degrees(e, 2).select("id")
    assert {r.id for r in top.collect()} == {1, 2}
    assert as_dict(clustering.landmark_embeddings(e, top), "id", "vector") == {0: [2, 1], 1: [0, 2], 2: [1, 0], 3: [2, 1]}
    far = as_dict(clustering.landmark_embeddings(e, e.sparkSession.createDataFrame([(3,)], "id long")), "id", "vector")
    assert far == {0: [255], 1: [255], 2: [255], 3: [0]}


def test_components(make):
    e = graphs.normalized(graphs.undirected(make([(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (5, 6, 1), (7, 8, 1)], False)))
    parts = clustering.connected(e)
    assert as_dict(ranking.dense_rank_labels(parts.withColumnRenamed("id", "node")), "id", "label") == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2, 7: 3, 8: 3}
    kept = clustering.largest(e, 1)
    assert {r.src for r in kept.collect()} == {3, 4, 5, 6}


def test_long_chain_components(make):
    e = make([(i, i + 1, 1) for i in range(200)] + [(1_000, 1_001, 1)])
    assert as_dict(clustering.connected(e), "id", "component") == {i: 0 for i in range(201)} | {1_000: 1_000, 1_001: 1_000}


def test_walk_expectation(make, spark):
    e = make([(0, 1, 1), (1, 1, 3), (1, 2, 2), (2, 1, 0.5), (1, 0, 10)])
    root = spark.createDataFrame([(1,)], "id long")
    got = as_dict(walks.expected_walk(e, root, 1, 0.0), "id", "score")
    assert got == pytest.approx({0: 10 / 15, 1: 3 / 15, 2: 2 / 15})
    mass = walks.expected_walk(e, root, 0.1, 0.0, 30).agg(F.sum("score")).first()[0]
    assert mass == pytest.approx(1.0)
    n = 4_000
    mc = as_dict(walks.sampled_walk(e, root, n, 2, 0.0), "id", "score")
    want = as_dict(walks.expected_walk(e, root, 2, 0.0), "id", "score")
    for k, p in want.items():
        assert abs(mc.get(k, 0) - p) <= 4 * (p * (1 - p) / n) ** 0.5 + 1e-3
    with pytest.raises(ValueError):
        walks.steps_for(0)


def test_dead_end_returns(make, spark):
    e = make([(0, 1, 1)])
    got = as_dict(walks.expected_walk(e, spark.createDataFrame([(0,)], "id long"), 2, 0.5), "id", "score")
    assert got == {0: 1.0}


def test_sparse_ppr_mass(make, spark):
    e = make(FIVE)
    got = walks.sparse_ppr(e, spark.createDataFrame([(0,)], "id long"), 0.2, 1e-7)
    assert got.agg(F.sum("score")).first()[0] == pytest.approx(1.0, abs=1e-4)


def test_reweighting(spark):
    mass = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0)], "root long, node long, mass double")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, vector array<double>")
    assert as_dict(walks.reweighted(mass, v, [1.0, 0.0], 0.0), "node", "mass") == {1: 1.0, 2: 1.0, 3: 1.0}
    got = as_dict(walks.reweighted(mass, v, [1.0, 0.0], 1.0), "node", "mass")
    assert got[1] > got[3] > got[2]


def test_pagerank(make):
    e = make([(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1)])
    r, n = np.full(4, 0.25), 4
    p = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0.5, 0, 0, 0.5], [0, 0, 0, 0]])
    for _ in range(6):
        y = r[3] / n + 0.85 * (r @ p) + 0.15 / n
        r = y / y.sum()
    assert as_dict(ranking.pagerank(e, 6), "id", "score") == pytest.approx(dict(enumerate(r)))


def test_tournament(spark):
    b = api.TournamentBuilder(spark)
    b.add_ranked_outcomes([("t", "a"), ("t", "b"), ("t", "c")], 2.0)
    t = b.build()
    assert b.build() is None and t.graph.edges.count() == 3
    names = t.graph.nodes.join(t.norms, "id")
    assert as_dict(names, "node_name", "norm") == {"a": 1.0, "b": 2.0, "c": 3.0}
    s = as_dict(api.LSR(20).learn(t).rows, "node_name", "vector")
    assert s["a"][0] > s["b"][0]


SHOP = [("alice", "widget", 3), ("alice", "gadget", 1), ("bob", "gadget", 5), ("bob", "doohickey", 2), ("mart", "widget", 4), ("mart", "doohickey", 1)]


def shop(spark):
    b = api.GraphBuilder(spark)
    for u, i, w in SHOP:
        b.add_edge(("user", u), ("item", i), w)
    return b.build_graph()


def test_policy(spark):
    g = shop(spark)
    p = api.PolicyEvaluation(g, 0.9, 100, 1e-6, 0.5)
    for i, r in (("widget", 10), ("gadget", 5), ("doohickey", 2)):
        p = p.set_reward(("item", i), r)
    v = as_dict(g.with_names(p.values()), "node_name", "value")
    assert v == pytest.approx({"widget": 10, "gadget": 5, "doohickey": 2, "alice": 7.875, "bob": 0.9 * 29 / 7, "mart": 7.56})
    new = p.optimize().named().where("from_name = 'alice' and to_name = 'gadget'").first().weight
    assert new == pytest.approx(0.25 * np.exp(-10) / (0.75 + 0.25 * np.exp(-10)))
    with pytest.raises(KeyError):
        p.set_reward(("item", "none"), 1)
    cold = policy.improve(g.edges, p.values(), 0.0)
    assert cold.where("p = 1").count() == 3


def test_smci_prefers_the_rewarded_way(spark):
    b = api.GraphBuilder(spark)
    for x, y in ((0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (6, 7), (1, 5), (2, 6)):
        b.add_edge(("n", str(x)), ("n", str(y)), 1, api.UNDIRECTED)
    s = api.Smci(b.build_graph())
    s.add_reward(("n", "0"), ("n", "3"), 2)
    got = as_dict(s.optimize(1, 300, 0.1, 0.9, 0.0, 0.2, 5).named().where("from_name = '1'"), "to_name", "weight")
    assert got["2"] > got["5"] and sum(got.values()) == pytest.approx(1.0)


def test_smci_rewards_only_ends(make, spark):
    """A walk that passes its target and goes on earns nothing; each reward has walks of its own."""
    e = graphs.normalized(make([(0, 1, 1), (0, 3, 1), (1, 2, 1), (3, 2, 1)], False))
    run = lambda rewards, steps: {(r.src, r.dst): r.p for r in policy.smci(e, spark.createDataFrame(rewards, "src long, dst long, reward double"), 1, 40, 0.0, 1.0, explore=0.0, restart=steps).collect()}
    assert run([(0, 1, 5.0)], 2)[0, 1] == pytest.approx(0.5)
    assert run([(0, 1, 5.0)], 1)[0, 1] > 0.95
    both = run([(0, 1, 5.0), (0, 3, 5.0)], 1)
    assert 0.05 < both[0, 1] < 0.95


def test_walks_choose_by_weight_and_end(make, spark):
    """A hub with 60 edges of which one has half of the weight; a dead end leads home; no walk is cut short."""
    e = graphs.normalized(make([(0, i, 59.0 if i == 1 else 1.0) for i in range(1, 61)], False))
    root = spark.createDataFrame([(0,)], "id long")
    first = lambda **how: as_dict(walks.walks(e, root, 2_000, 1, **how).where("step = 1").groupBy("node").count(), "node", "count")
    got = first()
    assert 900 < got[1] < 1_100 and len(got) > 50 and sum(got.values()) == 2_000
    assert max(first(weighted=False).values()) < 80 and 480 < first(greedy=0.5)[1] < 620
    rows = walks.walks(e, root, 60, 0.1)
    ends = rows.groupBy("walk").agg(F.max("step").alias("n"))
    assert ends.count() == 60 and 6 < ends.agg(F.avg("n")).first()[0] < 15 and rows.where("step % 2 = 0 and node <> 0").isEmpty()


def test_losses_by_their_formulas():
    """Values worked out by hand."""
    t, h, u = np.array([3.0, 4.0]), np.array([0.0, 2.0]), np.array([[5.0, 0.0], [0.0, -1.0], [1.0, 1.0]])
    c = 2**-0.5  # cosines of h with t: 0.8; with u: 0, -1, c
    value = lambda *how: training.Loss(*how).value_and_gradients(t, h, u)[0]
    assert value("contrastive", 1.0, 0.5, 3) == pytest.approx((0.2 + c - 0.5) / 2)
    assert value("contrastive", 0.7, 0.0, 3) == pytest.approx(c)
    star = (0.5 - 0.8 + c) / 1
    rank = -np.log(np.exp(8) / (np.exp(8) + 1 + np.exp(-2) + np.exp(2)))
    assert value("starspace", 0.5, 0.0, 3) == pytest.approx(star) and value("rank", 2.0, 0.0, 3) == pytest.approx(rank)
    assert value("rankspace", 0.5, 0.0, 3) == pytest.approx(star)  # the target has more than half of the softmax
    assert value("rankspace", 1.0, 0.0, 3) == pytest.approx((0.2 + 1 - 0.8 + c) / 2 + rank)


def test_distances(spark):
    d = lambda k, a, b: spark.range(1).select(vectors.distance(k, F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0]
    a, b = [1.0, 2.0, 1.0], [3.0, 2.0, 4.0]
    want = {"alt": 3, "cosine": 1 - 11 / (6**0.5 * 29**0.5), "euclidean": 13**0.5, "hamming": 2 / 3, "dot": -11}
    assert {k: d(k, a, b) for k in want} == pytest.approx(want)
    assert d("jaccard", [1.0, 2.0, -1.0], [2.0, 4.0, 5.0]) == 0.75 and np.isinf(d("cosine", [0.0, 0.0], [1.0, 2.0]))


def test_attention():
    v = np.array([[1, 1], [2, 2], [-1, -1]], float)
    q = np.array([[-1], [0], [1]], float)
    assert training.attention(q, q, v)[:, 0] == pytest.approx([1.0647, 0.6667, -0.0858], abs=1e-4)
    full = np.concatenate([q, q, v], axis=1)
    assert training.attended(full, 1, 1) == pytest.approx(training.attention(q, q, v).sum(0) / 3)
    assert training.attended(full[:1], 1, 1) == pytest.approx([1, 1])


@pytest.mark.parametrize("loss", [training.Loss("margin", 5.0, 0, 2), training.Loss("contrastive", 1.0, -0.9, 2), training.Loss("starspace", 1.5, 0, 2), training.Loss("rank", 2.0, 0, 2), training.Loss("rankspace", 2.0, 0, 2)])
def test_gradients(loss):
    rng = np.random.default_rng(3)
    x = [rng.normal(size=4), rng.normal(size=4), rng.normal(size=(2, 4))]
    _, *g = loss.value_and_gradients(*x)
    for which in range(3):
        for at in np.ndindex(x[which].shape):
            up, down = ([y.copy() for y in x] for _ in range(2))
            up[which][at] += 1e-6
            down[which][at] -= 1e-6
            slope = (loss.value_and_gradients(*up)[0] - loss.value_and_gradients(*down)[0]) / 2e-6
            assert slope == pytest.approx(g[which][at], abs=1e-4)


@pytest.mark.parametrize("kind", ["listnet", "listmle"])
def test_list_gradients(kind):
    s, t = np.array([0.1, -0.3, 0.2, 0.0]), np.array([0.5, 0.3, 0.2, 0.0])
    value, g = training.list_loss(s, t, kind)
    for i in range(4):
        e = np.eye(4)[i] * 1e-6
        slope = (training.list_loss(s + e, t, kind)[0] - training.list_loss(s - e, t, kind)[0]) / 2e-6
        assert slope == pytest.approx(g[i], abs=1e-4)
    assert np.isfinite(value)


def test_training_lowers_the_loss(make, spark):
    e = graphs.normalized(graphs.undirected(make([(i, (i + 1) % 12, 1) for i in range(12)] + [(i, (i + 2) % 12, 1) for i in range(12)], False)))
    f = features.filled(spark.createDataFrame([], "node long, pos int, feat string"), graphs.nodes_of(e))
    _, losses = training.propagate_embeddings(e, f, 6, 8, 0.1, training.Loss("margin", 1.0, 0, 3), valid=0.0)
    assert np.isfinite(losses).all() and losses[-1] < losses[0]


@pytest.mark.parametrize("model", [training.Averaged(), training.Attention(2, 3), training.Attention(1, 2, window=1), training.Attention(1, 2, chosen=2)])
def test_models_and_their_gradients(model):
    """Of one node and of several, against slopes; a feature that occurs twice is in the bag twice."""
    rng = np.random.default_rng(4)
    names, x, g = ["a", "b", "a", "c"], rng.normal(size=(4, model.width(3))), rng.normal(size=3)
    other = rng.normal(size=(2, model.width(3)))
    draw = lambda: np.random.default_rng(9)
    one = lambda v: model.build(v, names, draw())
    many = lambda v: model.around([(names, v), (["d", "e"], other)], draw())
    for f, grads in ((one, one(x)[1](g)), (many, many(x)[1](g)[0])):
        for at in np.ndindex(x.shape):
            e = np.zeros_like(x)
            e[at] = 1e-6
            assert ((f(x + e)[0] - f(x - e)[0]) @ g) / 2e-6 == pytest.approx(grads[at], abs=1e-6)
    assert model.build(x[:1], names[:1])[1](g).shape == (1, model.width(3))


def test_rates():
    rates = [training.cosine_rate(k, 100, 1.0) for k in range(100)]
    assert rates[0] == pytest.approx(0.01 + 0.99 / 20) and rates[19] == 1.0 and rates[-1] == pytest.approx(0.01)
    assert rates[49] == pytest.approx(0.01 + 0.99 * 0.5)
    assert training.exponential_rate(3, 2.0, 0.5) == 0.25 and training.exponential_rate(9, 2.0, 0.5, 0.1) == 0.1


def test_walk_ends_are_two_steps_away_at_least(make, spark):
    e = graphs.normalized(graphs.undirected(make([(i, i + 1, 1) for i in range(6)], False)))
    got = walks.walk_ends(e, spark.createDataFrame([(0,), (3,)], "id long"), 40, 1.0).collect()
    assert len(got) == 80 and {(r.root, r.first) for r in got} == {(0, 1), (3, 2), (3, 4)}
    assert {r.node for r in got if r.root == 0 and r.node != 0} <= {1, 2, 3} and any(r.node == 2 for r in got)


@pytest.mark.parametrize("how", [{"loss": training.Loss("ppr", 1.0, 0, 2)}, {"hard": 2, "loss": training.Loss("margin", 1.0, 0, 3)}, {"model": training.Attention(1, 2), "updates": 2, "noise": 0.01}])
def test_training_with_walks_and_attention(make, spark, how):
    e = graphs.normalized(graphs.undirected(make([(i, (i + 1) % 12, 1) for i in range(12)] + [(i, (i + 2) % 12, 1) for i in range(12)], False)))
    f = spark.createDataFrame([(i, j, f"f{(i + j) % 12}") for i in range(12) for j in range(2)], "node long, pos int, feat string")
    seen = []
    got, losses = training.propagate_embeddings(e, f, 4, 2, 0.1, **{"valid": 0.3, "watch": lambda *x: seen.append(x), **how})
    assert [x[0] for x in seen] == [0, 1] and all(np.isfinite(x[2]) for x in seen)
    assert np.isfinite(losses).all() and len(losses) == 2 * how.get("updates", 1)
    assert got.count() == 12 and {len(r.vector) for r in got.collect()} == {how.get("model", training.Averaged()).width(4)}


def test_a_step_of_training_is_the_plain_one(make, spark):
    """One Adam step of the margin loss without negatives in reach of chance: each node's only other node is its negative."""
    e = graphs.normalized(make([(0, 1, 1), (1, 0, 1)]))
    f = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], "node long, pos int, feat string")
    start = {"a": [1.0, 0.0], "b": [0.0, 2.0], "c": [3.0, 1.0]}
    given = spark.createDataFrame(list(start.items()), "feat string, vector array<double>")
    loss = training.Loss("starspace", 5.0, 0, 1)
    got, losses = training.propagate_embeddings(e, f, 2, 1, 0.1, loss, valid=0.0, vectors=given)
    v = {k: np.array(x) for k, x in start.items()}
    h = {0: (v["a"] + v["b"]) / 2, 1: v["c"]}
    g, total = {k: np.zeros(2) for k in v}, 0.0
    for node, other in ((0, 1), (1, 0)):
        value, gt, gh, gu = loss.value_and_gradients(h[other], h[node], np.array([h[other]]))
        total += value
        for n, d in ((other, gt), (node, gh), (other, gu[0])):
            for k in ("a", "b") if n == 0 else ("c",):
                g[k] += d / (2 if n == 0 else 1)
    rate = training.cosine_rate(0, 1, 0.1)
    want = {k: v[k] - rate * g[k] / (np.abs(g[k]) + 1e-8) for k in v}
    assert losses[0] == pytest.approx(total / 2)
    for r in got.collect():
        assert r.vector == pytest.approx(want[r.feat], abs=1e-6)


def test_features(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, "c")], "node long, pos int, feat string")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "feat string, vector array<double>")
    assert as_dict(features.mean_embeddings(rows, v), "node", "vector") == {1: [0.5, 1.5], 2: [1.0, 0.0]}
    nodes = spark.createDataFrame([(1,), (4,)], "id long")
    assert as_dict(features.embed_nodes(rows, v, nodes, 2), "node", "vector") == {1: [0.5, 1.5], 4: [0.0, 0.0]}
    assert features.pruned(rows, 2).count() == 2
    assert as_dict(features.unigrams(rows), "feat", "p") == {"a": 0.5, "b": 0.25, "c": 0.25}


def test_propagated_features(make, spark):
    e = graphs.normalized(graphs.undirected(make([(1, 2, 1), (2, 3, 1)], False)))
    got = features.propagate(e, spark.createDataFrame([(1, 0, "a")], "node long, pos int, feat string"), 2)
    assert {(r.node, r.feat) for r in got.collect()} == {(1, "a"), (2, "a"), (3, "a")}


def test_neighbourhood(make, spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 2.0])], "id long, vector array<double>")
    got = as_dict(embedding.neighbourhood(make([(0, 1, 1), (0, 2, 3)]), v, 0.5), "id", "vector")
    assert got[0] == pytest.approx([0.5 * 1.5 + 0.5, 0.5 * 1.75]) and got[2] == [2.0, 2.0]


def test_place_by_distances():
    anchors = np.array([[0, 0], [4, 0], [0, 4.0]])
    x = embedding.place_by_distances(anchors, np.linalg.norm(anchors - [1, 1], axis=1), anchors.mean(0), 0.1, 1e-6, 500)
    assert x == pytest.approx([1, 1], abs=0.05)


def test_forest(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(600, 12))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    asked = df.where("id % 50 = 0")
    want = {(r.query, r.id) for r in nearest.nearest_each(df, asked, 5).collect()}
    got = {(r.query, r.id) for r in nearest.forest_neighbours(df, asked, 5, 8, 40, least=300).collect()}
    assert len(want & got) >= 0.9 * len(want)
    tree = nearest.Tree(v, 40)
    assert sum(len(n.members) for n in tree.nodes) == 600 and tree.depth() >= 4
    assert tree.nodes[tree.path(v[0])[-1]].leaf == tree.leaf(v[0]) and 0 in tree.nodes[tree.path(v[0])[-1]].members


def test_a_kept_forest(spark, tmp_path):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 6))
    rows = spark.createDataFrame([(i, "v", str(i), x.tolist()) for i, x in enumerate(v)], "id long, node_type string, node_name string, vector array<double>")
    ann = api.EmbAnn(api.NodeEmbeddings(rows), 3, 30, path=str(tmp_path / "forest"))
    asked = rows.where("id % 50 = 0").select("id", "vector")
    first = {(r.query, r.id) for r in ann.find(asked, 4, 300).collect()}
    assert first == {(r.query, r.id) for r in nearest.nearest_each(rows, asked, 4).collect()}
    again = api.EmbAnn(api.NodeEmbeddings(rows), 3, 30, path=str(tmp_path / "forest"))
    assert first == {(r.query, r.id) for r in again.find(asked, 4, 300).collect()}
    nodes = {(r.tree, r.at): r for r in again.trees.collect()}
    assert sorted(x for (t, _), r in nodes.items() if t == 0 for x in r.members) == list(range(300))
    paths = again.find_leaf_paths(asked).collect()
    leaves = {(r.query, r.tree): r.leaf for r in again.find_leaf_indices(asked).collect()}
    deep = {r.tree: r.depth for r in again.depth().collect()}
    assert len(paths) == 3 * 6 and set(deep) == {0, 1, 2} and min(deep.values()) >= 4
    for r in paths:
        end = nodes[r.tree, r.path[-1]]
        assert r.query in end.members and end.leaf == leaves[r.query, r.tree] and len(r.path) < deep[r.tree]
    assert api.EmbAnn(api.NodeEmbeddings(rows), 2, 1_000).depth().select("depth").distinct().collect()[0].depth == 1


def test_alignment_by_a_forest_and_others(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(80, 3))
    make_ = lambda x: api.NodeEmbeddings(spark.createDataFrame([(i, "v", str(i), y.tolist()) for i, y in enumerate(x)], "id long, node_type string, node_name string, vector array<double>"), "euclidean")
    a, b = make_(v), make_(v + [5.0, 0.0, 0.0])
    aligner = api.EmbeddingAligner(6, 0.05, 1e-7, 2_000, random_nodes=4)
    assert aligner.align(a, b, [0.2, 0.1, 0.0]) == pytest.approx([5.2, 0.1, 0.0], abs=0.05)
    ann = api.EmbAnn(a, 2, 20)
    got = aligner.bulk_align(a, b, a.rows.where("id % 50 = 0").select("id", "vector"), ann).collect()
    assert {r.id for r in got} == {0, 50} and all(np.linalg.norm(np.array(r.vector) - v[r.id] - [5, 0, 0]) < 0.1 for r in got)


def test_climb(make, spark):
    n = 100
    e = graphs.normalized(graphs.undirected(make([(i, i + 1, 1) for i in range(n - 1)], False)))
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "id long, vector array<double>")
    got = nearest.climb(e, v, [42.0, 1.0], 3, starts=8, beam=8, most=40, kind="euclidean")
    assert [r.id for r in got.collect()] == [42, 41, 43]


def test_overlapping_labels(make):
    e = graphs.normalized(graphs.undirected(make([(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)], False)))
    got = as_dict(clustering.speaker_listener(e, 10, 2), "id", "labels")
    assert all(set(got[i]) <= {0, 1, 2} for i in range(3)) and all(set(got[i]) <= {3, 4, 5} for i in range(3, 6))
    named = e.select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"))
    assert set(as_dict(clustering.speaker_listener(named, 5, 1, best=False), "id", "labels")["n4"]) <= {"n3", "n4", "n5"}
    lpa = as_dict(clustering.label_propagation(e, 1, 5), "id", "label")
    assert {lpa[i] for i in range(3)} <= {0, 1, 2}


def test_a_frequent_label_is_heard_more_often(make, spark):
    """Of 10 speakers 9 say the same: about 9 of 10 listeners hear it."""
    first = make([(100 + i, s, 1) for i in range(200) for s in range(10)] + [(s, 50 if s else 60, 1) for s in range(10)], False)
    got = as_dict(clustering.speaker_listener(first, 3, 1, memory=1, best=False), "id", "labels")
    heard = [got[100 + i][0] for i in range(200)]
    assert 160 <= heard.count(50) <= 196 and set(heard) == {50, 60}


def test_components_are_numbered_in_order(spark):
    rows = [(i, i - i % 3) for i in range(300)]
    got = as_dict(ranking.dense_rank_labels(spark.createDataFrame(rows, "node long, component long")), "id", "label")
    assert got == {i: 1 + i // 3 for i in range(300)}


def test_files(spark, tmp_path):
    g = shop(spark)
    g.save(str(tmp_path / "g"), "gzip")
    again = api.Graph.load(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, again.named().collect())) == sorted(map(tuple, g.named().collect()))
    assert as_dict(again.get_edges(("user", "alice"), "p"), "node_name", "p") == {"widget": 0.75, "gadget": 0.25}
    with pytest.raises(KeyError):
        again.get_edges(("user", "nobody"))
    e = api.NodeEmbeddings.from_list(spark, [(("a", "x"), [1.0, 2.0]), (("a", "y"), [3.0]), (("b", "z"), [1.0, 1.0])], "euclidean")
    e.save(str(tmp_path / "e"))
    back = api.NodeEmbeddings.load(spark, str(tmp_path / "e"), "euclidean", "a")
    assert back.get_embedding(("a", "y")) == [3.0, 0.0] and back.rows.count() == 2
    assert back.compute_distance(("a", "x"), ("a", "y")) == pytest.approx(8**0.5)
    assert [r.node_name for r in e.nearest_neighbor(("a", "x"), 2).collect()] == ["x", "z"]
    (tmp_path / "bad.tsv").write_text("a\tb\tc\n")
    with pytest.raises(Exception, match="expected 5 fields"):
        api.Graph.load(spark, str(tmp_path / "bad.tsv")).edges.count()


def test_builders(spark):
    assert api.GraphBuilder(spark).build_graph() is None
    g = shop(spark)
    fs = api.FeatureSet.from_graph(g).set_features(("item", "widget"), [("c", "red"), ("c", "big")])
    assert [r.feat for r in fs.get_features(("item", "widget")).orderBy("pos").collect()] == ["c:red", "c:big"]
    assert fs.filled().rows.count() == 2 + 5
    w = api.RandomWalker(0.3, 50).walk(g, ("user", "alice"), types="item", exact=True)
    assert {r.node_name for r in w.collect()} <= {"widget", "gadget", "doohickey"}
    ns = spark.createDataFrame([("color=red",), ("plain",)], "n string").select(graphs.namespace("prefix", F.col("n"), F.lit("t")).alias("x"))
    assert [tuple(r.x) for r in ns.collect()] == [("color", "red"), ("feat", "plain")]


def test_unknown_losses_are_rejected():
    with pytest.raises(ValueError):
        training.Loss("other")


def test_queries_over_all_of_the_geography(spark):
    from graphloom import queries

    d = "/root/testdata/sf0.001"
    n = {t: queries.read(spark, d, t).count() for t in ("customer", "supplier", "nation", "region")}
    got = queries.QUERIES["c3_speaker_listener"](spark, d)
    assert {r.kind: r["count"] for r in got.groupBy((F.col("id") % 4).alias("kind")).count().collect()} == dict(enumerate(n.values()))
    roots = {r.kind: r.n for r in queries.QUERIES["e6_feature_ppr"](spark, d).groupBy(F.substring("root", 1, 1).alias("kind")).agg(F.countDistinct("root").alias("n")).collect()}
    assert roots == {t[0]: k for t, k in n.items()}


def test_embeddings_are_built_and_set(spark):
    b = api.NodeEmbeddingsBuilder(spark)
    assert b.build() is None
    for n, v in ((("a", "x"), [1, 0]), (("a", "y"), [0, 1]), (("a", "x"), [2, 2])):
        b.add_embedding(n, v)
    with pytest.raises(ValueError):
        b.add_embedding(("a", "z"), [1, 2, 3])
    e = b.build()
    assert e.get_embedding(("a", "x")) == [2, 2] and e.rows.count() == 2
    e = e.set_embedding(("a", "y"), [5, 6])
    assert e.get_embedding(("a", "y")) == [5, 6] and e.get_embedding(("a", "x")) == [2, 2]
    at = e.rows.where("node_name = 'y'").first().id
    assert e.by_id(at) == (("a", "y"), [5, 6])
    for call in (lambda: e.by_id(at + 1), lambda: e.set_embedding(("a", "q"), [1, 1])):
        with pytest.raises(KeyError):
            call()
    zeros = api.NodeEmbeddings.zeros(shop(spark), 3)
    assert {tuple(r.vector) for r in zeros.rows.collect()} == {(0, 0, 0)} and zeros.rows.count() == shop(spark).nodes.count()


def test_aggregators_are_saved(spark, tmp_path):
    shares = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "feat string, p double")
    for k, a in enumerate((api.FeatureAggregator(), api.FeatureAggregator("attention", heads=2, d_k=3, window=4), api.FeatureAggregator("weighted", 0.5, shares))):
        a.save(spark, str(tmp_path / str(k)))
        b = api.FeatureAggregator.load(spark, str(tmp_path / str(k)))
        assert (a.kind, a.alpha, a.heads, a.d_k, a.window) == (b.kind, b.alpha, b.heads, b.d_k, b.window)
        assert (a.weights is None) == (b.weights is None)
    assert as_dict(b.weights, "feat", "p") == {"a": 0.75, "b": 0.25}


def test_measures(spark):
    answers = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.1), (1, 3, 0.1), (1, 4, 0.3), (2, 5, 0.5), (2, 6, 0.6)], "query long, id long, distance double")
    truth = spark.createDataFrame([(1, 3), (1, 4), (2, 6), (3, 1)], "query long, id long")
    assert evaluation.recall_at_k(answers, truth, 2).first().recall == pytest.approx(2 / 4)
    assert as_dict(evaluation.hit_rates(answers, truth, (1, 2)), "k", "hit_rate") == pytest.approx({1: 0, 2: 2 / 3})
    grams = spark.createDataFrame([("a b c",), ("x",), (None,)], "t string").select(evaluation.ngrams(F.col("t")).alias("g")).collect()
    assert [x.gram for x in grams[0].g] == ["a", "b", "c", "a b", "b c", "a b c"] and [x.gram for x in grams[1].g] == ["x"] and grams[2].g is None
    v = spark.createDataFrame([("a b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("z", [9.0, 9.0])], "name string, vector array<double>")
    assert evaluation.answer("a b c", v) == [0.5, 0.5] and evaluation.answer("q", v) is None


def test_attention_weights(spark):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(4, 2 * 2 * 3 + 2))
    bags = spark.createDataFrame([(1, ["a", "b", "c", "d"], vecs.tolist())], "node long, feats array<string>, vecs array<array<double>>")
    for window in (None, 1):
        got = {(r.head, r.feat, r.other): r.weight for r in evaluation.attention_weights(bags, 2, 3, window).collect()}
        for h in range(2):
            want = training.attention(vecs[:, 3 * h : 3 * h + 3], vecs[:, 6 + 3 * h : 9 + 3 * h], np.eye(4), window)
            assert [[got[h, a, b] for b in "abcd"] for a in "abcd"] == pytest.approx(want)


def test_training_from_files(spark, tmp_path):
    from graphloom import train

    (tmp_path / "edges").write_text("".join(f"u\t{i}\tu\t{(i + k) % 8}\t1\n" for i in range(8) for k in (1, 3)))
    (tmp_path / "features").write_text("".join(f"u\t{i}\ta:{i % 4} all\n" for i in range(8)))
    at = [str(tmp_path / x) for x in ("edges", "features", "out")]
    for given in (["ep", *at, "--undirected", "--dims", "4", "--passes", "1"], ["rank", *at, "--undirected", "--dims", "4", "--passes", "1", "--steps", "2", "--walks", "10", "--k", "3"]):
        train.run(spark, train.arguments(given))
        got = {r.feat: len(r.vector) for r in spark.read.parquet(at[2]).collect()}
        assert got == {"feat:all": 4, **{f"feat:a:{i}": 4 for i in range(4)}}


def test_namespaces_do_not_run_together(spark):
    rows = spark.createDataFrame([("a:b", "n", 0, "c"), ("a", "n", 1, "b:c")], "node_type string, node_name string, pos int, name string")
    assert sorted(r.feat for r in api.named_features(rows, "node_type").collect()) == ["a:b:c", "a\\:b:c"]
