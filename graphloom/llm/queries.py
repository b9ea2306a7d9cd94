"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language, licenses, mixing, neighbours, quality, toxicity, urls, warc
from .common import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(mod: int, held: int):
    return F.coalesce(remainder(F.col("doc_id"), mod) == held, F.lit(False)).alias("held_out")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", *(F.col(f"contamination.{c}") for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = warc.archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(F.col(f"license.{c}") for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, name="score")
    return out.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs, model, name="score")
    return out.select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.identify(docs, language.fit(docs))
    return out.select("doc_id", held_out(4, 2), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept", "audit_recall", "audit_probes")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.curriculum_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_warc, op3_jaccard, op4_licenses, op5_urls, op6_toxicity, op7_quality, op8_language, op9_neighbours, op10_mixing)}


#: Words of a text in SQL: A-Z lower-cased by translate, then everything that is no word character is a cut.
_WORDS = r"list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP1 = f"""
WITH items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
patterns AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
  FROM items, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("text")} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM patterns),
places AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM docs, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT rid, item_id, places.n AS n, i FROM places JOIN patterns ON places.p = patterns.p AND places.n = patterns.n),
hit AS (SELECT rid, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + n)) AS t(j) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5 = f"""
WITH l AS (SELECT * FROM (VALUES {", ".join(f"('{d}')" for d in urls.BLOCK_LIST)}) AS t(d)),
p AS (SELECT page_id, {_HOST} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, q, v)),
m AS (SELECT page_id, host, path, (SELECT struct_pack(k := h || q, v := v) FROM r WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, q) ORDER BY len(h) + len(q) DESC LIMIT 1) AS x FROM p)
SELECT page_id, host, path, x.k AS rule, 
  coalesce(x.v, CASE WHEN EXISTS (SELECT 1 FROM l WHERE host = d OR host LIKE '%.' || d) THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""


def _op4() -> str:
    sets = licenses.template_words(licenses.TEMPLATES)
    templates = ", ".join(f"('{label}', {words!r}, {licenses.needed(len(words), licenses.THRESHOLD)}, {licenses.block_words(licenses.TEMPLATES[label])})" for label, words in sorted(sets.items()))
    phrases = ", ".join(f"('{label}', {p.split()!r})" for p, label in sorted(licenses.PHRASES.items()))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS w FROM documents),
t AS (SELECT * FROM (VALUES {templates}) AS t(label, words, k, n)),
f AS (SELECT * FROM (VALUES {phrases}) AS t(label, words)),
base AS (SELECT rid, label, i - 1 AS place FROM d, f, unnest(range(1, len(w) + 1)) AS u(i) WHERE w[i] = f.words[1] AND w[i:i + len(f.words) - 1] = f.words),
starts AS (SELECT rid, label, words, k, w[i:i + n - 1] AS b FROM d, t, unnest(range(1, len(w) + 1)) AS u(i) WHERE list_contains(words, w[i])),
met AS (SELECT rid, label, len(list_intersect(b, words)) / CAST(len(words) AS DOUBLE) AS c FROM starts WHERE len(list_intersect(b, words)) >= k),
own AS (SELECT rid, max(c) AS c FROM met GROUP BY rid),
b AS (SELECT rid, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM base GROUP BY rid),
every AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.a AS first_word, b.z AS last_word, coalesce(b.l, '') AS base_labels,
  coalesce(every.l, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(own.c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN own USING (rid) LEFT JOIN every USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op4_licenses": _op4(), "op5_urls": OP5}
