"""The kernels of the training-data operators against plain versions, without Spark."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import decontaminate as D
from graphloom.llm import jaccard as J
from graphloom.llm import language as L
from graphloom.llm import mixing as M
from graphloom.llm import neighbours as N
from graphloom.llm import quality as Q
from graphloom.llm import toxicity as T
from graphloom.llm import urls as U
from graphloom.llm import warc as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=60, deadline=None)
@given(st.text())
def test_words(t):
    assert [w.decode() for w in D.words_of(t.encode("utf-8", "ignore"))] == WORD.findall(ascii_lower(t.encode("utf-8", "ignore").decode()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "c"]), max_size=9), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from(["a", "bb", "c", "dd"]), max_size=60), max_size=4), st.integers(1, 7))
def test_wu_manber_finds_every_occurrence(items, docs, window):
    table = D.WuManber([(k, " ".join(x).encode()) for k, x in enumerate(items)], window)
    patterns = {}
    for k, x in enumerate(items):
        for i in range(max(1, len(x) - window + 1)) if x else ():
            patterns.setdefault(tuple(x[i : i + window]), set()).add(k)
    old = D.STRETCH
    try:
        for D.STRETCH in (3, old):
            sizes, found = table.search([None, *(" ".join(x).encode() for x in docs)])
            assert sizes.tolist() == [0, *map(len, docs)] and found[0] == []
            for words, got in zip(docs, found[1:], strict=True):
                assert sorted(got) == sorted((i, len(p), sorted(ids)) for p, ids in patterns.items() for i in range(len(words) - len(p) + 1) if tuple(words[i : i + len(p)]) == p)
    finally:
        D.STRETCH = old


def test_wu_manber_skips_and_stays_small():
    """Most of a clean text is passed over, and tables take some 12 bytes a byte of the benchmark."""
    rng = random.Random(4)
    items = [" ".join(f"item{rng.randrange(30_000)}" for _ in range(200)).encode() for _ in range(300)]
    (table,) = D.WuManber(list(enumerate(items)), 13).tables
    text = D.Words([" ".join(f"word{rng.randrange(30_000)}" for _ in range(50_000)).encode() + b" " + items[7]])
    asked = []
    whole = table.shift
    table.shift = type("Asked", (), {"__getitem__": lambda self, i: (asked.append(len(i)), whole[i])[1]})()
    assert len(list(table.find(text))) == 188 and sum(asked) < 0.15 * 50_000
    table.shift = whole
    held = sum(x.nbytes for x in vars(table).values() if isinstance(x, np.ndarray)) + len(table.data)
    assert held < 12 * len(b" ".join(items))


def plain_set(t, k):
    w = SPACED.findall(ascii_lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB c\té\n", max_size=40)), max_size=12), st.integers(1, 5), st.sampled_from([3, 1 << 20]))
def test_shingles_tell_sets_apart(texts, k, block):
    got = J.shingle_sets([None if t is None else t.encode() for t in texts], k, block)
    want = [plain_set(t, k) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([(90, 100), (80, 100), (50, 100)]))
def test_signature_tree_finds_components(seed, t):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64) for _ in range(6)]
    sets = []
    for _ in range(90):
        s = base[rng.integers(0, 6)].copy()
        for _ in range(rng.integers(0, 6)):
            s[rng.integers(0, len(s))] = rng.integers(0, 2**63)
        sets.append(np.unique(s))
    edges, _ = J.match(sets, np.arange(len(sets)), *t)
    linked = lambda i, j: t[1] * len(np.intersect1d(sets[i], sets[j])) >= t[0] * len(np.union1d(sets[i], sets[j]))
    assert all(linked(*e) for e in edges)

    def roots(pairs):
        up = list(range(len(sets)))
        find = lambda i: i if up[i] == i else find(up[i])
        for i, j in pairs:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(sets))]

    assert roots(edges) == roots([(i, j) for i in range(len(sets)) for j in range(i) if linked(i, j)])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_prefixes_of_linked_sets_meet(seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))
    b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 2**63, 2).astype(np.uint64)]))
    weight = lambda s: (s % np.uint64(7)).astype(np.int64)
    if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)):
        assert len(np.intersect1d(J.prefix(a, weight(a), 90, 100), J.prefix(b, weight(b), 90, 100)))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 3_000), st.integers(0, 3_000), st.integers(0, 99))
def test_cascade_is_exact(n, m, seed):
    x = np.random.default_rng(seed).integers(0, 2**64, (2, n + m), dtype=np.uint64)
    c = U.Cascade.build((x[0, :n], x[1, :n]), (x[0, n:], x[1, n:]))
    got = c.listed(x[0], x[1])
    assert got[:n].all() and not got[n:].any()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1_000), st.sampled_from([3.0, 1.0, 2.0])), min_size=1, max_size=8))
def test_targets(rows):
    sizes, weights = [r[0] for r in rows], [r[1] for r in rows]
    got = M.fill_targets(sizes, weights)
    assert all(t <= 2 * s + 1e-6 for t, s in zip(got, sizes, strict=True))
    assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 * max(1, sum(sizes))
    free = [t / w for t, s, w in zip(got, sizes, weights, strict=True) if t < 2 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


def test_bundle_round_trip():
    rng = random.Random(3)
    pages = [(i, f"http://a/{i}", rng.randbytes(rng.randrange(0, 4_000))) for i in range(50)] + [(None, None, b"")]
    b = W.Bundler(frame_bytes=5_000)
    for i, url, body in pages:
        b.add(i, W.record(i, url, body, "response", None, W.digest(body)))
    data, entries = b.close()
    assert len(W.seek_table(data)) > 5 and len(entries) == len(pages)
    for (i, url, body), (j, _, at, n, where, _) in zip(pages, entries, strict=True):
        head, block = W.read_record(data, at, n, where)
        assert i == j and block == body and head.get("warc-target-uri") == url
    everything = b"".join(W.frame_content(data, *x) for x in W.seek_table(data))
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == everything


def test_small_world_finds_links():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    v = np.concatenate([centres + rng.normal(0, 0.08, centres.shape) for _ in range(12)] + [np.repeat(rng.normal(size=(1, 16)), 300, 0) + rng.normal(0, 0.01, (300, 16))])
    s = N.Shard([f"{i:032d}" for i in range(len(v))], np.ones(len(v), int), v, 0.95)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    truth = u @ u.T >= 0.95
    found = np.zeros(truth.shape, bool)
    for k, got in s.links(u):
        found[k, got] = True
    assert not (found & ~truth).any() and found.sum() >= 0.99 * truth.sum()


def test_audit_sees_small_groups_beside_a_large_one(monkeypatch):
    """A third of the rows are one group, whose links a narrow beam finds; the pairs' links take a wider one."""
    rng = np.random.default_rng(6)
    group = rng.normal(size=(1, 16)) + rng.normal(0, 0.01, (400, 16))
    pairs = np.repeat(rng.normal(size=(400, 16)), 2, 0)
    v = np.concatenate([group, pairs + rng.normal(0, 0.01, pairs.shape)])

    def links(self, q, width=None):
        for k, row in enumerate(q @ self.unit.T >= self.least):
            yield k, np.flatnonzero(row if row.sum() > 24 or (width or self.width) >= 96 else q[k] @ self.unit.T >= 1 - 1e-12)

    monkeypatch.setattr(N.Shard, "links", links)
    s = N.Shard([f"{i:032d}" for i in range(len(v))], np.ones(len(v), int), v, 0.95)
    assert s.width == 96 and s.recall == 1
    assert all(i not in x and len(x) for _, i, x in s.probes()) and {len(x) < 24 for _, _, x in s.probes()} == {True, False}
    assert s.n_probes == len(s.probes())
    assert N.Shard(["a", "b"], np.ones(2, int), np.eye(2), 0.95).recall == 1


def test_audit_asks_for_other_shards(monkeypatch):
    """Members find all of their partners with the first beam, visitors only with a wider one."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(200, 16))
    visitors = ([f"x{i}" for i in range(200)], N.units(v + rng.normal(0, 0.01, v.shape)))

    def links(self, q, width=None):
        for k, row in enumerate(q @ self.unit.T):
            yield k, np.flatnonzero(row >= self.least if (width or self.width) >= 48 else row >= 1 - 1e-12)

    monkeypatch.setattr(N.Shard, "links", links)
    ids = [f"{i:032d}" for i in range(200)]
    assert N.Shard(ids, np.ones(200, int), v, 0.95).width == 24
    s = N.Shard(ids, np.ones(200, int), v, 0.95, visitors)
    assert s.width == 48 and s.recall == 1 and s.n_probes == 200
    assert N.Shard(ids, np.ones(200, int), v, 0.95, (ids, N.units(v))).n_probes == 0


def test_units_of_huge_and_tiny_vectors():
    v = np.array([[3e200, 4e200], [3e-200, 4e-200], [3e-320, 0.0], [0.6, 0.8]])
    assert np.allclose(N.units(v), [[0.6, 0.8], [0.6, 0.8], [1, 0], [0.6, 0.8]])


def test_shard_that_no_beam_serves_is_scanned(monkeypatch):
    rng = np.random.default_rng(8)
    v = np.repeat(rng.normal(size=(150, 16)), 2, 0) + rng.normal(0, 0.01, (300, 16))
    monkeypatch.setattr(N.Graph, "search", lambda self, q, width: ((q @ self.v[:1].T), np.zeros((len(q), 1), np.int64)))
    s = N.Shard([f"{i:032d}" for i in range(300)], np.ones(300, int), v, 0.95)
    truth = s.unit @ s.unit.T >= 0.95
    assert s.width == 0 and s.recall == 1
    assert all(whole and np.array_equal(got, np.flatnonzero(truth[k])) for k, got, whole in s.searched(s.unit))
    assert np.array_equal(s.label, np.arange(300) // 2 * 2)


def test_language_backs_off():
    counts = [(g, w, n) for g, ws in {"en": "the thing with whale", "de": "der ding mit schwan", "fr": "le truc avec eau"}.items() for w in ws.split() for n in [5]]
    m = L.build(counts)
    langs, score = m.predict([b"the thing", b"schwarm", "eaux".encode(), b"123 !!", None, b"", "ГГ".encode()], L.Seen())
    assert langs[:3] == ["en", "de", "fr"] and langs[3:6] == ["und"] * 3 and (score[:3] > 0.3).all() and langs[6] != "und"
    assert L.build([]).predict([b"x"], L.Seen())[0] == ["und"]


def test_toxicity_learns_words_and_their_misspellings():
    rng = random.Random(5)
    plain, bad = [f"word{i}" for i in range(300)], ["dreadful", "horribly"]
    texts, y = [], []
    for _ in range(800):
        w = rng.choices(plain, k=40)
        y.append(float(rng.random() < 0.3))
        if y[-1]:
            w[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(w).encode())
    m = T.train(texts[:600], np.array(y[:600]))
    p = m.score(texts[600:], {})
    assert ((p >= 0.5) == (np.array(y[600:]) == 1)).mean() > 0.97
    own = m.word_scores([b"dreadful", b"dreadfull", b"word7"])
    assert own[0] > own[1] > own[2]
    assert np.isfinite(m.score([None, b"", b"x" * 100_000], {})).all()
    assert np.isfinite(T.train([], np.zeros(0)).score([b"a"], {})).all()


def test_the_middle_of_a_long_word_counts():
    """Scripts without spaces: a paragraph is one word."""
    rng = random.Random(9)
    fill = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4E40)) for _ in range(n))
    bad, texts, y = "\u9fa0\u9fa1\u9fa2\u9fa3", [], []
    for i in range(400):
        y.append(float(i % 3 == 0))
        texts.append((fill(150) + (bad if y[-1] else "") + fill(150)).encode())
    m = T.train(texts[:300], np.array(y[:300]))
    assert ((m.score(texts[300:], {}) >= 0.5) == (np.array(y[300:]) == 1)).mean() > 0.95
    word = bytes(rng.randrange(128, 256) for _ in range(1_000))
    n = T.GRAMS[-1]
    assert {word[i : i + n] for i in range(1_001 - n)} <= {p[i : i + n] for p in T.pieces(word) for i in range(len(p) - n + 1)} and max(map(len, T.pieces(word))) == T.PIECE

    model = L.build([("en", "thethingwith", 9), ("de", "derdingmitschwan", 9)])
    text = ("dermit" * 5 + "thething" * 40 + "dermit" * 5).encode()
    assert model.predict([text], L.Seen())[0] == ["en"]
    assert "".join([L.pieces(text.decode())[0], *(p[4:] for p in L.pieces(text.decode())[1:])]) == text.decode()


def test_quality_learns_a_pair():
    rng = np.random.default_rng(2)
    x = rng.random((3_000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.train(x, y, rounds=20)
    assert ((m.score(x) > 0.5) == (y == 1)).mean() > 0.9
    assert Q.features(None) == Q.features(b"") and len(Q.features(b"A b\nb!")) == len(Q.FEATURES)
    assert np.isfinite(Q.train(np.zeros((0, 16)), np.zeros(0)).score(np.zeros((1, 16)))).all()


def test_hash_key_halves():
    key = hashlib.blake2b(b"x", digest_size=16).digest()
    assert -(2**63) <= J.first_half(key) < 2**63


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (95, 100), (1, 1), (1, 2)])
def test_linked_sets_have_a_part_in_common(num, den):
    rng = np.random.default_rng(5)
    seen = 0
    for _ in range(1500):
        both = int(np.exp(rng.uniform(0, 6.5)))
        # As many tokens of their own as the similarity allows, dealt to both sides at random.
        most = both * (den - num) // num
        one = int(rng.integers(0, most + 1))
        t = rng.integers(0, 1 << 63, both + most).astype(np.uint64)
        a, b = np.unique(t[: both + one]), np.unique(np.concatenate([t[:both], t[both + one :]]))
        assert den * both >= num * (both + most)
        assert set(J.part_keys(a, num, den).tolist()) & set(J.part_keys(b, num, den).tolist())
        seen += most > 0
    assert seen > 500 or num == den


def test_sets_with_a_passage_in_common_have_no_part_in_common():
    rng = np.random.default_rng(6)
    t = rng.integers(0, 1 << 63, (400, 150)).astype(np.uint64)
    t[:, :30] = t[0, :30]
    keys = np.concatenate([np.unique(J.part_keys(np.unique(x), 90, 100)) for x in t])
    _, times = np.unique(keys, return_counts=True)
    assert (times > 1).sum() < 20
