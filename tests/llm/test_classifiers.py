"""The classifiers against plain versions, on held-out rows of the given tables, and on awkward samples."""

import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import language as L
from graphloom.llm import quality as Q
from graphloom.llm import queries, sampling
from graphloom.llm import toxicity as T

DATA = "/root/testdata/sf0.01"
given_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


def auc(y, s):
    good, bad = s[y == 1], s[y == 0]
    return float((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean())


def test_toxicity_gradients():
    """The batch step's gradients against differences of the loss of a plain version."""
    rng = np.random.default_rng(3)
    vectors, weight, bias = rng.normal(size=(7, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    own = [(np.array([0, 2, 5]), np.array([0.002, 0.003, 0.001])), (np.array([], int), np.array([])), (np.array([1, 2, 6]), np.array([0.004, 0.001, 0.002]))]
    y = np.array([1.0, 0.0, 0.0])

    def loss(v, w, b):
        out = 0.0
        for (u, s), t in zip(own, y):
            z = sum((T.SCALE * x * v[i] for i, x in zip(u, s)), np.zeros(3)) @ w + b
            out += math.log(sum(math.exp(x) for x in z)) - z[int(t)]
        return out

    got, used, gv, gw, gb = T.step_gradients(vectors, weight, bias, own, y)
    assert abs(got - loss(vectors, weight, bias)) < 1e-9 and used.tolist() == [0, 1, 2, 5, 6]
    for x, g, at in ((vectors, gv, [(int(i), k) for i in used for k in range(3)]), (weight, gw, list(np.ndindex(3, 2))), (bias, gb, [(0,), (1,)])):
        for p, own_g in zip(at, g.ravel(), strict=True):
            old = x[p]
            ends = []
            for e in (1e-5, -1e-5):
                x[p] = old + e
                ends.append(loss(vectors, weight, bias))
            x[p] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - own_g) < 1e-6


def test_toxicity_score_is_an_average_of_the_whole_text():
    """Scores against a plain average over words of averages over their units; clean words only dilute."""
    rng = np.random.default_rng(4)
    m = T.Model(rng.normal(size=1 << T.BITS), -0.5)
    text = b"some words and some more wordsandwords " * 7 + b"end"
    words = T.words_of(text)
    each = []
    for w in words:
        marked, found = b"<" + w + b">", T.units([w])[0]
        assert len(found) == 1 + sum(max(0, len(marked) - n + 1) for n in T.GRAMS)
        each.append(float(np.mean(m.unit[found])))
    assert abs(m.score([text], {})[0] - 1 / (1 + math.exp(0.5 - sum(each) / len(each)))) < 1e-12
    m = T.Model(np.where(np.arange(1 << T.BITS) == T.units([b"foul"])[0][0], 500.0, 0.0), -3.0)
    p = m.score([b"foul " + b"fine " * n for n in (0, 9, 99, 9_999)], {})
    assert (np.diff(p) < 0).all() and p[0] > 0.5 and abs(p[3] - 1 / (1 + math.exp(3))) < 0.01


def test_toxicity_of_several_mild_words():
    """Words that are only more frequent in toxic texts tell together, and long clean texts don't drift."""
    rng = np.random.default_rng(5)
    plain, mild = [f"word{i}" for i in range(300)], [f"rough{c}" for c in "abcdefgh"]
    make = lambda toxic, n: " ".join(rng.choice(mild) if rng.random() < (0.10 if toxic else 0.01) else rng.choice(plain) for _ in range(n)).encode()
    y = (np.arange(900) % 3 == 0).astype(float)
    texts = [make(t, 80) for t in y]
    m = T.train(texts[:600], y[:600])
    assert ((m.score(texts[600:], {}) >= 0.5) == (y[600:] == 1)).mean() > 0.95
    assert (m.score([make(False, 20_000) for _ in range(5)], {}) < 0.5).all()


def test_labelled_bounds_rows(spark):
    """An id that is repeated many times, null ids and texts, ids labelled twice; at most as many rows as asked for."""
    docs = spark.range(5_000).selectExpr("7L as doc_id", "concat('t', id) as text").unionByName(spark.createDataFrame([(1, "a"), (2, None), (None, "n"), (3, "c"), (4, "d"), (6, "f")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (1, 0), (2, 1), (None, 1), (3, None), (4, 2), (6, 0)], "doc_id long, toxic int")
    take = lambda rows: {(r._id, r._y, r._value) for r in sampling.labelled(docs, labels, "toxic", 5, 99, rows, docs["text"]).collect()}
    assert take(100) == {(7, 1, "t0"), (1, 0, "a"), (6, 0, "f")}
    assert len(take(2)) <= 2
    # A text larger than all of the sample is passed over, and others are learnt from.
    docs = spark.createDataFrame([(i, ("foul " if i % 2 else "fine ") + f"text number {i}") for i in range(300)] + [(1_000, "fine " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1_000, 0)], "doc_id long, toxic int")
    m = T.fit(docs, labels, mod=5, held=9, most_bytes=20_000)
    assert m.score([b"a foul text"], {})[0] > 0.5 > m.score([b"a fine text"], {})[0]


def plain_quality(m, x):
    """One row's score, table by table."""
    z = m.bias
    for j, cuts in enumerate(m.cuts):
        z += m.tables[j][sum(v >= c for c in cuts for v in [x[j]])]
    for (a, b), grid in zip(m.pairs, m.grids, strict=True):
        z += grid[sum(c <= x[a] for c in m.coarse[a])][sum(c <= x[b] for c in m.coarse[b])]
    return 1 / (1 + math.exp(-min(60, max(-60, z))))


def test_quality_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(6)
    x = rng.random((400, 5)).round(2)  # ties at the cuts
    m = Q.train(x, (x[:, 0] * x[:, 1] > 0.25).astype(float), rounds=10, pair_rounds=5)
    assert np.allclose(m.score(x), [plain_quality(m, row) for row in x], atol=1e-12)


def test_language_scores_against_a_plain_version():
    """Add-one smoothed log frequencies of words, else of the longest known n-grams, summed and normalised."""
    words = {"en": Counter("the thing with the whale and the thing".split()), "de": Counter("der ding mit der wal und der ding".split())}
    m = L.build([(g, w, n) for g, c in words.items() for w, n in c.items()])
    parts = {g: {n: Counter() for n in range(1, L.LONGEST + 1)} for g in words}
    for g, c in words.items():
        for w, k in c.items():
            for n in parts[g]:
                for p in L.grams(w, n):
                    parts[g][n][p] += k
    known = {n: set().union(*(parts[g][n] for g in words)) for n in range(1, L.LONGEST + 1)}
    log = lambda table, kinds, w: math.log(table[w] + 1) - math.log(sum(table.values()) + kinds + 1)

    def score(text):
        total = dict.fromkeys(words, 0.0)
        for w in re.findall(r"[a-z]+", text):
            if any(w in words[g] for g in words):
                own = {g: log(words[g], len(set().union(*words.values())), w) for g in words}
            else:
                n = next((n for n in range(min(L.LONGEST, len(w) + 2), 0, -1) if any(p in known[n] for p in L.grams(w, n))), 0)
                met = [p for p in L.grams(w, n) if p in known[n]] if n else []
                own = {g: sum(log(parts[g][n], len(known[n]), p) for p in met) / max(1, len(met)) if met else 0.0 for g in words}
            for g in words:
                total[g] += own[g]
        best = max(sorted(total), key=lambda g: total[g])
        return best, 1 / sum(math.exp(total[g] - total[best]) for g in total)

    texts = ["the whale", "thingy derwal", "undwal ding xx", "mit", "with zzz"]
    langs, scores = m.predict([t.encode() for t in texts], L.Seen())
    for t, g, s in zip(texts, langs, scores, strict=True):
        want = score(t)
        assert g == want[0] and abs(s - want[1]) < 1e-5, t


def test_forgotten_words_score_the_same(monkeypatch):
    m = L.build([("en", f"en{i}", 1 + i % 5) for i in range(50)] + [("de", f"de{i}", 2) for i in range(50)])
    texts = [" ".join(f"{'en' if (i + k) % 3 else 'de'}{k}" for k in range(i % 40)).encode() for i in range(60)]
    want = m.predict(texts, L.Seen())
    monkeypatch.setattr(L, "CACHE", 7)
    seen = L.Seen()
    got = [m.predict([t], seen) for t in texts]
    assert [g[0][0] for g in got] == want[0] and np.allclose([g[1][0] for g in got], want[1])


@given_tables
def test_held_out(spark):
    """Accuracy on the folds that were not learnt from."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().drop_duplicates("doc_id").set_index("doc_id")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    for f, label, least, recall in ((queries.op6_toxicity, "toxic", 0.95, 0.6), (queries.op7_quality, "quality", 0.95, 0.9)):
        got = f(spark, DATA).where("held_out").toPandas().drop_duplicates("doc_id").set_index("doc_id").join(labels, how="inner")
        y = got[label].to_numpy()
        assert len(got) > 50 and (got.predicted == y).mean() >= least and (got.predicted[y == 1] == 1).mean() >= recall, label
        assert auc(y, got.score.to_numpy()) > 0.7
    got = queries.op8_language(spark, DATA).where("held_out").toPandas().merge(docs[["doc_id", "lang"]].dropna(), on="doc_id")
    got = got[got.lang_pred != "und"]
    assert len(got) > 200 and (got.lang_pred == got.lang).mean() > 0.98
    assert defaultdict(int, got.groupby("lang").size()).keys() >= {"en", "de", "fr", "es"}
