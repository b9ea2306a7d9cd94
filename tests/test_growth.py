"""What used to grow faster than its input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.operators import embedding, evaluation, features, graphs, nearest, policy, ranking, walks
from graphloom.session import Scratch


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_cut_into_words_once(spark):
    rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(3_000)),), ("",), (None,)], "t string")
    cut = rows.select(evaluation.ngrams(F.col("t")).alias("g"))
    assert plan_of(cut).count("split(") == 1
    got = [r.g for r in cut.collect()]
    assert len(got[0]) == 3_000 + 2_999 + 2_998 and got[0][-1].gram == "w2997 w2998 w2999" and [x.gram for x in got[1]] == [""] and got[2] is None


def some_vectors(spark, n: int, odd: bool = False):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(n)]
    rows += [(n + i, rows[i % 3][1]) for i in range(40)] + [(n + 40, [0.0] * 6), (n + 41, [0.0] * 6)]  # copies, whose distances are equal
    if odd:
        rows += [(n + 50, None), (n + 51, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (n + 52, [1.0, 2.0])]
    return spark.createDataFrame(rows, "id long, vector array<double>")


@pytest.mark.parametrize("kind", ["cosine", "euclidean", "dot"])
def test_nearest_of_each_by_products(spark, kind, monkeypatch):
    v = some_vectors(spark, 300)
    asked = v.where("id % 10 = 0 or id >= 300")
    got = nearest.nearest_each(v, asked, 7, kind)
    assert "Cross" not in plan_of(got)
    want = sorted(map(tuple, nearest.best_of(nearest.crossed(v, asked, kind), 7).collect()))
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(nearest, "HELD", 6 * 8 * 20)
    assert sorted(map(tuple, nearest.nearest_each(v, asked, 7, kind).collect())) == want


def test_nearest_of_each_in_chunks_and_by_names(spark):
    rows = some_vectors(spark, 300).collect()
    x, names = np.array([r.vector for r in rows]), np.array([f"v{r.id}" for r in rows], object)
    at = [pa.record_batch([pa.array(names[i : i + 50]), pa.array([r.vector for r in rows[i : i + 50]])], ["id", "vector"]) for i in range(0, len(rows), 50)]
    far = np.array([nearest.distances_of("cosine", x, np.tile(q, (len(x), 1))) for q in x[:20]])
    want = [[names[j] for j in sorted(range(len(x)), key=lambda j: (far[i, j], names[j]))[:5]] for i in range(20)]
    before = nearest.CHUNK
    try:
        nearest.CHUNK = 4_000
        out = pa.Table.from_batches(nearest.nearest_in(iter(at), pa.array(range(20)), x[:20], 5, "cosine")).to_pylist()
    finally:
        nearest.CHUNK = before
    assert [[r["id"] for r in out if r["query"] == i] for i in range(20)] == want


def test_nearest_of_each_with_odd_vectors(spark):
    v = some_vectors(spark, 60, True)
    asked = v.where("id % 10 = 0 or id >= 100")
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, nearest.nearest_each(v, asked, 4).collect())) == sorted(map(key, nearest.best_of(nearest.crossed(v, asked, "cosine"), 4).collect()))


def test_climbing_reads_a_written_graph(spark, monkeypatch):
    cuts = []
    was = nearest.Scratch.cut
    monkeypatch.setattr(nearest.Scratch, "cut", lambda self, df, name: (cuts.append(name), was(self, df, name))[1])
    v = some_vectors(spark, 40)
    e = nearest.nearest_each(v, v, 4).where("query <> id").select(F.col("query").alias("src"), F.col("id").alias("dst"))
    assert nearest.climb(e, v, v.first().vector, 3, most=3).count() == 3 and "edges" in cuts


def dead_ended(spark):
    rows = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 3.0), ("b", "e", 1.0), ("e", "b", 2.0)]  # d is a dead end
    return graphs.normalized(spark.createDataFrame(rows, "src string, dst string, weight double"))


def rows_of(df):
    return {tuple(r)[:-1]: r[-1] for r in df.collect()}


def test_walks_in_blocks_and_by_joins(spark, monkeypatch):
    e = dead_ended(spark)
    roots = spark.createDataFrame([("a",), ("b",), ("d",), ("z",)], "id string")
    v = spark.createDataFrame([(x, [float(i), 1.0, -i * i / 5]) for i, x in enumerate("abcd")], "id string, vector array<double>")
    run = [
        lambda: walks.expected_walk(e, roots, 0.3, 0.5, 3, 0.01, best=2),
        lambda: walks.guided_walk(e, roots, v, [1.0, 0.0, 0.5], 0.2, 0.5, 0.5, 2, [0.0, 1.0, 1.0], "euclidean"),
    ]
    got = [f() for f in run]
    assert all("MapInArrow" in plan_of(x) for x in got)
    got = [rows_of(x) for x in got]
    vectors = {r.root: r.vector for r in embedding.rank_walks(e, roots, 2, 0.5, 5, 8).collect()}
    monkeypatch.setattr(walks.blocks, "EDGES", 0)
    assert [rows_of(f()) for f in run] == [pytest.approx(x) for x in got]
    want = {r.root: r.vector for r in embedding.rank_walks(e, roots, 2, 0.5, 5, 8).collect()}
    assert set(vectors) == set(want) and all(vectors[r] == pytest.approx(want[r]) for r in want)


@pytest.mark.parametrize("dead", [False, True])
def test_feature_walks_have_no_pairs(spark, dead):
    e = dead_ended(spark)
    if not dead:
        e = graphs.normalized(graphs.undirected(e))
    feats = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("c", "z"), ("d", "y")], "node string, feat string")
    pairs = walks.expected_walk(e, graphs.nodes_of(e), 0.3, 0.5, 3)
    want = pairs.join(feats.withColumnRenamed("node", "id"), "id").groupBy("root", "feat").agg(F.sum("score").alias("score"))
    assert rows_of(walks.feature_walk(e, graphs.nodes_of(e), feats, 0.3, 0.5, 3)) == pytest.approx(rows_of(want))


def test_means_are_added_up_as_columns(spark, monkeypatch):
    f = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "b"), (3, 0, "z")], "node long, pos int, feat string")
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, -1.0])], "feat string, vector array<double>")
    w = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "feat string, p double")
    for weights in (None, w):
        got = features.mean_embeddings(f, v, weights, 0.1)
        assert "Generate" not in plan_of(got)
        got = rows_of(got)
        with monkeypatch.context() as m:
            m.setattr(features, "COLUMNS", 0)
            want = rows_of(features.mean_embeddings(f, v, weights, 0.1))
        assert set(got) == set(want) == {(1,), (2,)} and all(got[n] == pytest.approx(want[n]) for n in want)


def test_loops_build_their_graph_once(spark, monkeypatch):
    cuts = []
    was = Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name: (cuts.append(name), was(self, df, name))[1])
    e = dead_ended(spark)
    rewards = spark.createDataFrame([("d", 1.0)], "id string, reward double")
    f = spark.createDataFrame([("a", 0, "x"), ("d", 0, "y")], "node string, pos int, feat string")
    for run in (lambda: policy.evaluate(e, rewards, 0.9, 1), lambda: ranking.pagerank(e, 1), lambda: embedding.click_terms(e, f, rewards, 1), lambda: features.propagate(e, f, 2, 0.0, 1)):
        cuts.clear()
        assert run().count() and cuts.count("edges") == 1


def test_norms_take_one_pass_over_the_outcomes(spark):
    o = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 3, 2.0), (1, 2, 1.0)], "winner long, loser long, weight double")
    norms = ranking.tournament(o)[1]
    assert rows_of(norms) == {(1,): 1.0, (2,): 2.0, (3,): 2.5}
    assert plan_of(norms).count("LogicalRDD") + plan_of(norms).count("LocalRelation") == 1 and "Join" not in plan_of(norms)
