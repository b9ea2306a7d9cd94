"""Measures of ranked answers, word n-grams of a query, weights of an attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_k(answers: DataFrame, k: int) -> DataFrame:
    """(query, id, rank): the ``k`` nearest of each query other than itself, ties by id, ranks from 1."""
    w = Window.partitionBy("query").orderBy("distance", "id")
    return answers.where(F.col("query") != F.col("id")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", "rank")


def recall_of_kind(answers: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """One row, ``recall``: of the first ``k`` answers (query, id, distance) the share whose kind (id, kind) is the query's."""
    rows = first_k(answers, k).join(kinds.select("id", F.col("kind").alias("_a")), "id").join(kinds.select(F.col("id").alias("query"), F.col("kind").alias("_q")), "query")
    return rows.agg(F.avg((F.col("_a") == F.col("_q")).cast("double")).alias("recall"))


def recall_at_k(answers: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row, ``recall``: of the pairs of ``truth`` (query, id) the share among the first ``k`` answers."""
    found = truth.select("query", "id").distinct().join(first_k(answers, k), ["query", "id"], "left")
    return found.agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"))


def hit_rates(answers: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(k, hit_rate): the share of queries of ``truth`` (query, id) with one of their ids among the first k answers."""
    best = truth.select("query", "id").distinct().join(first_k(answers, max(ks)), ["query", "id"], "left").groupBy("query").agg(F.min("rank").alias("best"))
    got = best.agg(*[F.avg((F.coalesce("best", F.lit(2**30)) <= k).cast("double")).alias(f"_{k}") for k in ks])
    return got.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("hit_rate")) for k in ks])).alias("x")).select("x.k", "x.hit_rate")


def ngrams(text: Column, most: int = 3, delim: str = " ") -> Column:
    """All runs of 1 to ``most`` words of a query, as an array of (n, pos, gram), by n and place; none of a null text."""

    def runs(words: Column, n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), i.cast("int").alias("pos"), F.array_join(F.slice(words, i + 1, n), delim).alias("gram")))

    # The words are an argument, so that the text is split once and not again for every run.
    cut = F.transform(F.array(F.split(text, delim)), lambda words: F.concat(*[runs(words, n) for n in range(1, most + 1)]))
    return F.when(text.isNotNull(), F.element_at(cut, 1))


def answer(text: str, vectors: DataFrame, most: int = 3) -> list[float] | None:
    """The mean vector of those n-grams of a query that are known names (name, vector); null if none is."""
    from ..functions.vectors import doubles

    spark = vectors.sparkSession
    asked = spark.createDataFrame([(text,)], "t string").select(F.explode(ngrams(F.col("t"), most)).alias("g")).select(F.col("g.gram").alias("name")).distinct()
    rows = vectors.join(F.broadcast(asked), "name").select(F.posexplode(doubles(F.col("vector"))).alias("pos", "x"))
    means = rows.groupBy("pos").agg(F.avg("x").alias("x")).orderBy("pos").collect()
    return [r.x for r in means] or None


def attention_weights(bags: DataFrame, heads: int, d_k: int, window: int | None = None) -> DataFrame:
    """(node, head, feat, other, weight): how much of ``other``'s value each feature of a node takes.

    ``bags`` (node, feats, vecs) hold vectors [Q1..Qh, K1..Kh, V1..Vh]; weights of a feature add up to 1 over the
    others within ``window`` places, itself included.
    """
    part = lambda v, at: F.slice(v, at * d_k + 1, d_k)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / float(d_k) ** 0.5
    rows = bags.select("node", "vecs", "feats", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("feats") - 1)))
    q = part(F.element_at("vecs", F.col("i") + 1), F.col("head"))
    rows = rows.withColumn("s", F.transform("vecs", lambda v, j: F.when(F.lit(True) if window is None else F.abs(j - F.col("i")) <= window, dot(q, part(v, F.col("head") + heads)))))
    rows = rows.withColumn("e", F.transform("s", lambda x: F.coalesce(F.exp(x - F.array_max("s")), F.lit(0.0))))
    rows = rows.withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return rows.select("node", "head", F.element_at("feats", F.col("i") + 1).alias("feat"), F.explode(F.arrays_zip(F.col("feats").alias("other"), F.col("e").alias("w"))).alias("x"), "z").select("node", "head", "feat", F.col("x.other").alias("other"), (F.col("x.w") / F.col("z")).alias("weight"))
