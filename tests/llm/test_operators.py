"""The operators on small tables with nulls, empty and long texts, ties, repeats, empty tables and clashing names, against brute force."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import decontaminate, jaccard, language, licenses, mixing, neighbours, quality, toxicity, urls, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("w5 ", "x ")), (4, None), (5, ""), (6, "  \n "), (7, "one"), (8, "ONE"), (9, "a b c All rights  reserved. CC-BY"),
    (10, "Das ist GENERAL public license und cc by cc by"), (11, "é" * 50 + " ü"), (12, "long " * 60_000), (13, BASE + " tail"), (None, BASE), (15, "Released under the MIT License."), (7, "one"), (16, "q r s t"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else "de", None if k % 5 == 0 else f"s{k % 3}", k, k) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, size int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def bruteforce_components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = SPACED.findall(low(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return out


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard(docs, k, num):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(docs, k, num, 100).collect())
    assert got == Counter(bruteforce_components(TEXTS, k, num, 100))


def test_jaccard_large_clusters(spark):
    """Clusters beyond one task: near copies in chains, dealt into many buckets."""
    rng = np.random.default_rng(4)
    rows = []
    for c in range(3):
        w = [f"c{c}w{i}" for i in range(80)]
        for i in range(70):
            w = list(w)
            w[rng.integers(0, 80)] = f"n{c}-{i}"
            rows.append((1000 * c + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(df, 3, 90, 100, cluster_tokens=1_500).collect())
    assert got == Counter(bruteforce_components(rows, 3, 90, 100))


@pytest.fixture
def cuts(monkeypatch):
    """Rows of the scratch tables that are written, by name."""
    rows, cut = {}, jaccard.Scratch.cut

    def counted(self, df, name):
        out = cut(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(jaccard.Scratch, "cut", counted)
    return rows


@pytest.mark.parametrize("k,num", [(5, 80), (3, 90)])
def test_jaccard_spans_of_sizes(spark, monkeypatch, cuts, k, num):
    """Prefix tokens are joined a span of sizes at a time, and copies on both sides of a span's edge still meet."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(90):
        w = [f"v{x}" for x in rng.integers(0, 3_000, 20 + 4 * i)]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join([*w, f"t{i}", "u"])), (3 * i + 2, " ".join(w[len(w) // 8 :]))]
    monkeypatch.setattr(jaccard, "SPAN_TOKENS", 1_000, raising=False)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100).collect())
    assert got == Counter(bruteforce_components(rows, k, num, 100))
    met = [n for name, n in cuts.items() if name.startswith("met")]
    assert len(met) > 3 and max(met) < sum(met) / 3


@pytest.mark.parametrize("k,num", [(5, 80), (3, 90)])
def test_jaccard_texts_with_one_passage_in_common(spark, monkeypatch, cuts, k, num):
    """A cluster beyond one task that only a passage brought together parts, and its buckets need not all meet."""
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for i in range(150):
        w = [f"v{x}" for x in rng.integers(0, 60, 100)]
        rows.append((i, " ".join(w + passage)))
        if i % 10 == 0:
            w[50] = "changed"
            rows.append((1000 + i, " ".join(w + passage)))
    monkeypatch.setattr(jaccard, "COUNT_TOKENS", 5_000, raising=False)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100, cluster_tokens=1_500).collect())
    assert got == Counter(bruteforce_components(rows, k, num, 100)) and len({c for _, _, c in got}) == 150
    assert cuts["large"] and cuts["wide"] > 100 and "rest" not in cuts


def test_jaccard_parts_large_clusters_before_sets_are_made(spark, cuts):
    """Texts that only passages bring together leave a large cluster before their sets are written."""
    rng = np.random.default_rng(12)
    lines = [" ".join(f"p{j}x{i}" for i in range(12)) for j in range(4)]
    rows = []
    for i in range(300):
        w = [f"v{x}" for x in rng.integers(0, 60, 100 + i % 9)]
        tail = [lines[j] for j in rng.choice(4, 2, replace=False)]
        rows.append((i, " ".join(w + tail)))
        if i % 10 == 0:
            w[50] = "changed"
            rows.append((1000 + i, " ".join(w + tail)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, cluster_tokens=3_000).collect())
    assert got == Counter(bruteforce_components(rows, 3, 90, 100)) and len({c for _, _, c in got}) == 300
    assert cuts["wide"] > 200 and "sets" not in cuts and cuts["parted"] < 100


@pytest.mark.parametrize("k,num", [(5, 80), (3, 90)])
def test_jaccard_sets_in_rounds(spark, docs, monkeypatch, cuts, k, num):
    """Sets of clusters stand on disk one round after the other, with the same result."""
    want = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(docs, k, num, 100).collect())
    monkeypatch.setattr(jaccard, "SET_TOKENS", 20, raising=False)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(docs, k, num, 100).collect())
    assert got == want and sum(name.startswith("edges") for name in cuts) == jaccard.ROUNDS


def test_keep_one(docs, none):
    kept = jaccard.keep_one(docs, 5, 80, 100)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want = bruteforce_components(TEXTS, 5, 80, 100)
    heads = {c for d, n, c in want if n and d is not None}
    assert Counter(d for d, t in rows if d is not None and SPACED.search(t or "")) == Counter(heads)
    assert kept.columns == docs.columns and sum(d is None for d, _ in rows) == 1 and {4, 5, 6} <= {d for d, _ in rows}
    assert jaccard.keep_one(none).count() == 0


def bruteforce_hits(text, items, window):
    w = WORD.findall(low(text))
    hit, ids = set(), set()
    for i, t in items:
        x = WORD.findall(low(t))
        for a in range(max(1, len(x) - window + 1)) if x and i is not None else ():
            p = x[a : a + window]
            for b in range(len(w) - len(p) + 1):
                if w[b : b + len(p)] == p:
                    hit |= set(range(b, b + len(p)))
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_decontaminate(spark, docs, none, block_bytes):
    items = [(1, " ".join(f"w{i}" for i in range(20, 40))), (10, "One!"), (9, "b c ALL"), (3, None), (4, ""), (None, "long"), (9, "public license")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(docs.withColumnRenamed("size", "contamination"), bench, window=13, block_bytes=block_bytes)
    mark = out.columns[-1]
    assert mark == "contamination_1"
    got = Counter((r.doc_id, *r[mark][:5]) for r in out.collect())
    assert got == Counter((d, *bruteforce_hits(t, items, 13)) for d, t in TEXTS)
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).where("contamination.n_hit > 0").count() == 0


def test_warc(spark):
    rows = [(5, "http://a", "x"), (2, None, "x"), (9, "http://c", None), (3, "d", ""), (7, "e\nf", "ü" * 9_000), (7, "g", "x"), (None, "h", "x"), (8, "i", "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", __import__("pyspark").sql.functions.lit(1))
    index, records = warc.archive(pages)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        to = first[h or ""] if first[h or ""] != i else None
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to is None else "revisit", to, True))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.sound) for r in records.collect()]
    assert Counter(got) == Counter(want) and index.count() == len(rows)
    assert warc.archive(pages.where("false"))[1].count() == 0


def test_archive_in_a_folder(spark, tmp_path):
    """An archive with a path stays, and any record is read by its index entry alone; one without leaves nothing behind."""
    import glob

    from graphloom.session import shared_dir

    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i // 2} " * 500) for i in range(200)], "page_id long, url string, html string")
    index, records = warc.archive(pages, str(tmp_path / "kept"))
    for r in index.where("page_id % 50 = 0").collect():
        with open(tmp_path / "kept" / "bundles" / r.bundle, "rb") as f:
            head, block = warc.read_record(f.read(), r.frame_at, r.frame_bytes, r.record_at)
        assert head["warc-type"] == "response" and block.decode() == f"page {r.page_id // 2} " * 500
    assert records.where("record_type = 'revisit' and refers_to = page_id - 1 and page_id % 2 = 1").count() == 100
    assert sorted(map(str, warc.archive(pages)[1].drop("bundle", "frame").collect())) == sorted(map(str, records.drop("bundle", "frame").collect()))
    assert not glob.glob(shared_dir(spark).removeprefix("file://") + "/warc-*")


def test_key_filter_holds_all_keys(spark):
    from graphloom.llm.common import KeyFilter

    keys = spark.range(0, 3_000, 3).selectExpr("cast(id as string) as k").unionByName(spark.createDataFrame([(None,)], "k string"))
    f = KeyFilter(keys, keys["k"])
    rows = spark.range(9_000).selectExpr("id", "cast(id as string) as k").unionByName(spark.createDataFrame([(-1, None)], "id long, k string"))
    got = {r.id for r in rows.withColumn("has", f.column(rows["k"])).where("has").collect()}
    assert set(range(0, 3_000, 3)) <= got and -1 not in got and len(got) < 3_500
    assert not KeyFilter(keys.where("false"), keys["k"]).has(np.array([0, -1])).any()


def test_licenses(docs, none):
    got = {(r.doc_id, r.license.n_words, r.license.n_base, r.license.first_word, r.license.last_word, r.license.base_labels, r.license.labels, r.license.score) for r in licenses.scan(docs).collect()}
    for d, t in TEXTS:
        w = WORD.findall(low(t))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        labels, best = {x for _, x in at}, 0.0
        for i in range(len(w)):
            for label, template in licenses.TEMPLATES.items():
                words = set(template.split())
                c = len(words & set(w[i : i + -(-3 * len(template.split()) // 2)])) / len(words)
                if c >= licenses.THRESHOLD:
                    labels.add(label)
                    best = max(best, c)
        want = (d, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), 1.0 if at else best)
        assert want in got, want
    assert licenses.scan(none).count() == 0
    assert licenses.scan(docs, phrases={}, templates={}).where("license.labels <> '' or license.score > 0").count() == 0
    assert licenses.scan(docs.withColumnRenamed("size", "license")).columns[-1] == "license_1"


def test_wrapped_notices(spark):
    """Notices over several lines, with words added or missing, and their words scattered over a long text."""
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted"
    far = " ".join(w + " x" * 30 for w in licenses.TEMPLATES["bsd"].split())
    rows = [(1, f"/*\n * {bsd} provided that"), (2, bsd.replace("or without", "")), (3, far), (4, "This work is licensed under\na Creative Commons Attribution\n4.0 International License"), (5, "x " * 5_000 + bsd), (6, None)]
    got = {r.doc_id: (r.license.labels, sorted({(m.template, m.at) for m in r.license.matches})[:1], round(r.license.score, 3)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("bsd", [("bsd", 0)], 1.0), 2: ("bsd", [("bsd", 0)], 0.846), 3: ("", [], 0.0), 4: ("cc-by-4.0", [("cc-by-4.0", 0)], 0.867), 5: ("bsd", [("bsd", 5_000)], 1.0), 6: ("", [], 0.0)}


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_urls(spark, bound):
    cases = {
        "http://A.Example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://example.net/de/": ("example.net", "/de/", "net/", "block"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "x://m.example.com/de/1#y": ("m.example.com", "/de/1", "example.com/de/", "block"), "http://net": ("net", "", None, "allow"), "http://b.org/fr/://z": ("b.org", "/fr/://z", "org/fr/", "allow"), "no host": ("", "", None, "allow"),
        "http://evil.test/a": ("evil.test", "/a", None, "block"), "http://x.evil.test": ("x.evil.test", "", None, "block"), "http://notevil.test/a": ("notevil.test", "/a", None, "allow"),
        "http://m.Cheap-Pills.example.com/q": ("m.cheap-pills.example.com", "/q", None, "block"), "http://cheap-pills.example.org/fr/": ("cheap-pills.example.org", "/fr/", "org/fr/", "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    rows = [(i, u, "old") for i, u in enumerate([*cases, *cases])]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("evil.test",), ("evil.test",), (None,)], "domain string")
    got = urls.judge(pages, listed=listed, shard_keys=3, broadcast_bytes=bound).collect()
    assert len(got) == len(rows)
    assert all((r.host, r.path, r.rule, r.verdict) == cases[r.url] for r in got)
    assert urls.judge(pages.where("false")).count() == 0


def test_classifiers(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, (i or 0) % 2, "x") for i in [*range(1, 17), 3]] + [(None, 1, 1, "x"), (2, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    for rows in (docs, none):
        n = rows.count()
        for m, mod in ((toxicity, toxicity.fit(rows, labels)), (quality, quality.fit(rows, labels))):
            out = m.score(rows, mod)
            assert out.where(f"{out.columns[-1]} between 0 and 1").count() == n
        out = language.identify(rows, language.fit(rows)).collect()
        assert len(out) == n and all((r.language.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in out)
        assert all(0 <= r.language.score <= 1 for r in out)


def test_mixing(docs, none):
    a, b = (sorted(map(tuple, mixing.curriculum_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source").collect()), key=str) for _ in range(2))
    assert a == b and len(a) == len(TEXTS)
    by = {}
    for d, size, total, target, taken, source in a:
        assert 0 <= taken <= 2 * size
        by.setdefault(source, [total, target, 0, 0])
        by[source][2] += taken
        by[source][3] += size
    order = sorted(by, key=lambda s: (s is None, s or ""))
    targets = mixing.fill_targets([by[s][0] for s in order], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))])
    for s, t in zip(order, targets, strict=True):
        total, target, taken, size = by[s]
        assert total == size and abs(target - t) < 1e-6 and abs(taken - t) <= 1
    out = mixing.curriculum_mix(docs).collect()
    at = [r.position for r in out if r.position is not None]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert mixing.curriculum_mix(none).count() == 0


def test_near_duplicates(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8))
    v = [(i, (centres[i % 40] + rng.normal(0, 0.1, 8)).tolist()) for i in range(300)]
    v += [(1_000 + i, [1.0] * 8) for i in range(40)] + [(7, v[7][1]), (2_000, None), (2_001, [0.0] * 8), (2_002, [float("nan")] * 8), (2_003, [None] * 8), (None, [1.0] * 8), (2_004, []), (2_005, [1.0, 2.0]), (2_006, [2.0, 4.0])]
    df = spark.createDataFrame([(i, x, 1, 5) for i, x in v], "vec_id long, embedding array<float>, label int, n_links int")
    good = [k for k, (i, x) in enumerate(v) if i is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    unit = {k: np.array(v[k][1], np.float32).astype(float) / np.linalg.norm(np.array(v[k][1], np.float32).astype(float)) for k in good}
    up = {k: k for k in good}
    find = lambda i: i if up[i] == i else find(up[i])
    n = Counter()
    for a in good:
        for b in good:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    want = Counter((i, n[k], min(v[j][0] for j in good if find(j) == find(k)) if k in up else i) for k, (i, _) in enumerate(v))
    out = neighbours.near_duplicates(df, shards=3, group_bytes=150 * 64)
    assert out.select("audit_recall", "audit_probes").distinct().count() == 1 and out.first().audit_probes > 0 and out.first().audit_recall >= 0.995
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in out.collect())
    assert got == want
    assert neighbours.near_duplicates(df.where("false")).count() == 0


def test_vectors_of_any_length_link(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [1.0, -1.0]), (6, [float("inf"), 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=2).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 4: (3, 1, False), 5: (0, 5, True), 6: (0, 6, True)}


def test_links_count_for_both_ends(spark):
    """a (2 rows) and b, c, d: a's beam found b, b's found nothing; c's scan found a and d, a's and d's beams missed c or found it too."""
    from graphloom.llm.common import Scratch

    rows = [
        ("a", 0, 2, 1, False, 1, [], [("b", 1)]), ("c", 1, 1, 0, True, 3, [], []), ("a", 0, 2, 0, None, 1, [], []), ("d", 0, 1, 1, False, 1, [], [("c", 1)]),
        ("a", 0, 2, 1, None, 1, [], []), ("d", 0, 1, 1, None, 1, [], []), ("e", 0, 1, 0, False, 1, [], [("d", 1)]), ("d", 0, 1, 0, False, 1, [], [("e", 1)]),
    ]
    said = spark.createDataFrame(rows, neighbours.SAID)
    with Scratch(spark, "ends") as scratch:
        got = {r["class"]: r.found for r in neighbours.counted(said, scratch).collect()}
    # b has a's two rows though its own search found none; a has b, c by its scan, and one row of its own shard by a scan there.
    assert got == {"a": 3, "b": 2, "c": 3, "d": 2, "e": 1}


def test_a_rare_language_keeps_its_words(spark):
    """All words and n-grams of the sampled rows count; an id that many rows have is no more than its different texts."""
    rows = [(i, " ".join(f"en{chr(97 + k)}" for k in range(20)), "en") for i in range(60)] + [(100 + i, "zorro zyx", "es") for i in range(8)]
    rows += [(200 + i, " ".join(f"en{chr(97 + k)}q{chr(97 + i)}" for k in range(20)), "en") for i in range(8)] + [(300, "again and again", "en")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(df)
    assert len(m.keys[0]) <= 20 + 2 + 160 + 2 and len(m.keys[0]) >= 120
    assert m.predict([b"zorro", b"zyx", b"xenax zorrito"], language.Seen())[0] == ["es"] * 3
    few = language.fit(df, rows=10)
    assert len(few.keys[0]) < len(m.keys[0]) and language.fit(df.where("false")).langs == []
