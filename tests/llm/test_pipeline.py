"""The pipeline on a small corpus with planted rows, each stage against what brute force keeps."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    words = {"en": [f"the{i}ing" for i in range(200)], "de": [f"der{i}ung" for i in range(200)]}
    rows, labels, toxic = [], [], set()
    for i in range(240):
        lang = "en" if i % 3 else "de"
        w = rng.choices(words[lang], k=60)
        if i % 4 == 1:
            w[rng.randrange(60)] = "dreadful"
            toxic.add(i)
        labels.append((i, 1, int(i in toxic)))
        rows.append((i, " ".join(w), lang, f"s{i % 3}", 0))
    leak = [f"bench{i}" for i in range(30)]
    clean = [r for r in rows if r[0] not in toxic]
    copies = [(1_000 + k, r[1] + " tail", r[2], "s0", 0) for k, r in enumerate(clean[:10])]
    leaked = [(2_000 + k, " ".join(rng.choices(words["en"], k=40) + leak), "en", "s1", 0) for k in range(5)]
    blank = [(3_000, None, "en", "s0", 0), (3_001, "", None, None, None), (3_002, "12 34 !!", "de", "s0", 3)]
    spark.createDataFrame(rows + copies + leaked + blank, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(leak))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {r[0] for r in rows} | {r[0] for r in copies} | {r[0] for r in leaked}
    gone = [set(), toxic, {r[0] for r in copies}, {r[0] for r in leaked}]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, ((name, stage), out) in enumerate(zip(corpus_pipeline.STAGES[:-1], gone, strict=True)):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept -= out
        assert docs.columns == columns, name
        got = sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert got == sorted(kept), name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(kept)
    assert abs(sum(r.taken for r in mixed) - 1.5 * sum(r["size"] for r in mixed)) <= 3


def test_stages_on_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, a column named like a stage's mark; and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, language string"
    text = " ".join(f"the{i}ing" for i in range(40))
    rows = [(1, text, "en", "a", 0, "x"), (1, text, "en", "a", 0, "x"), (None, text, "en", None, 0, None), (2, None, "en", "a", 0, "x"), (3, "", None, "b", None, None), (4, "the1ing " * 50_000, "en", "b", 0, "x"), (5, "z" * 20_000, "en", "b", 0, "x"), (6, "12 34", "de", "b", 0, "x")]
    spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (given, kept) in enumerate(((rows, [None, 1, 4, 5]), ([], []))):
        docs = spark.createDataFrame(given, schema)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{k}-{name}")
            assert docs.columns == columns, name
        assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted(kept, key=str)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(kept)
