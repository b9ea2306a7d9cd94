"""License scans: an exact set-similarity join of text blocks with license templates.

Everything here is DataFrame expressions.  A block is a stretch of consecutive words that begins with a word of the template and
is half as long again as the template, or ends with the text; line ends don't matter, so wrapped notices
are found.  A block meets a template when it holds at least ``threshold`` of the template's distinct words.
Template words are ordered by their frequency over all texts of the corpus, rarest first; a block that meets a
template of m words, k of them needed, holds one of its first m - k + 1 words (prefix), has k words at
least (length), and from the first shared word at position p on at most m - p can be shared (position).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, col, fresh

#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fields of a block that meets a template, and of a place where a phrase stands.
BLOCK, PLACE = "template:string,at:int,words:int,shared:int,containment:double", "at:bigint,label:string"
#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of common notices, and their labels.
TEMPLATES = {
    "mit": "released under the mit license",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license cc by",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "all-rights": "copyright all rights reserved",
}
THRESHOLD = 0.8


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {label: sorted(set(text.split())) for label, text in templates.items()}


def needed(m: int, threshold: float) -> int:
    """Shared words that a template of ``m`` words needs: the least k with k >= threshold * m."""
    return max(1, next(k for k in range(m + 1) if k * 1000 >= round(threshold * 1000) * m))


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def cut(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.array_remove(F.split(lowered(text), GAP), "")


def block_words(template: str) -> int:
    """Words of a block of a template: half as many again as the template has."""
    return -(-3 * len(template.split()) // 2)


def frequency_order(docs: DataFrame, text_col: str, words: list[str]) -> list[str]:
    """``words`` by the number of texts of ``docs`` that hold them, rarest first, ties by the word.

    The counts cover all texts; a row per template word comes to the driver, which bounds them by the templates.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    held = docs.select(F.explode(F.array_intersect(cut(text), F.array(*map(F.lit, words)))).alias("w"))
    counts = {r.w: r.n for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def scan(
    docs: DataFrame,
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    name: str = "license",
) -> DataFrame:
    """``docs`` with a struct column ``name`` (under a name that clashes with none):

    n_words; n_base, first_word, last_word (places of the phrases, null if none); base_labels, labels
    (distinct, sorted, comma-joined; empty if none); score (1 with a phrase, else the largest containment
    met by a block, else 0); matches: array of (template, first word from 0, words, shared words, containment)
    of every block that meets the threshold, by template and place.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.  A null or empty text
    has no words and matches nothing.  Other columns, nulls and repeated rows pass through.

    Scale: two scans, no shuffle but the frequency counts of the template words; the templates are part
    of the plan.  A text is cut into words once in each; only texts that hold a prefix word of a template are searched for its blocks.
    """
    sets = template_words(templates)
    order = frequency_order(docs, text_col, sorted({w for ws in sets.values() for w in ws})) if sets else []
    name, words = fresh(docs.columns, name), fresh(docs.columns, "_lic_words")
    found, places = (fresh(docs.columns, x) for x in ("_lic_found", "_lic_places"))
    ws = F.col(words)
    empty = lambda kind: F.array().cast(f"array<struct<{kind}>>")

    def met(label: str) -> Column:
        ranked = sorted(sets[label], key=order.index)
        m, k, most = len(ranked), needed(len(ranked), threshold), block_words(templates[label])
        prefix, every = F.array(*map(F.lit, ranked[: m - k + 1])), F.array(*map(F.lit, ranked))

        def one(i: Column) -> Column:
            block = F.slice(ws, i + 1, most)
            # The first shared word in frequency order: with none in the prefix, or too few after it, the block can't meet k.
            first = reduce(lambda rest, p: F.when(F.array_contains(block, ranked[p]), F.lit(p)).otherwise(rest), reversed(range(m - k + 1)), F.lit(m))
            shared = F.when((F.size(block) >= k) & (F.lit(m) - first >= k), F.size(F.array_intersect(every, block))).otherwise(F.lit(0))
            return F.struct(F.lit(label).alias("template"), i.cast("int").alias("at"), F.size(block).alias("words"), shared.cast("int").alias("shared"), (shared / F.lit(float(m))).alias("containment"))

        starts = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.array_contains(every, F.element_at(ws, i + 1)))
        hits = F.filter(F.transform(starts, one), lambda r: r["shared"] >= k)
        return F.when(F.arrays_overlap(ws, prefix), hits).otherwise(empty(BLOCK))

    rows = docs.withColumn(words, cut(F.coalesce(col(text_col).cast("string"), F.lit(""))))
    blocks = [met(x) for x in sorted(templates)]
    rows = rows.withColumn(found, F.concat(*blocks) if blocks else empty(BLOCK))
    parts = sorted((label, phrase.split()) for phrase, label in phrases.items())
    at = [F.when(F.arrays_overlap(ws, F.array(F.lit(p[0]))), stands(ws, p, label)).otherwise(empty(PLACE)) for label, p in parts]
    rows = rows.withColumn(places, F.concat(*at) if at else empty(PLACE))
    base = F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"])))
    own = F.transform(found, lambda x: x["template"])
    result = F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform(places, lambda x: x["at"])).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base, own)))).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(found, lambda x: x["containment"])), F.lit(0.0))).alias("score"),
        F.col(found).alias("matches"),
    )
    return rows.withColumn(name, result).drop(words, found, places)


def stands(words: Column, phrase: list[str], label: str) -> Column:
    """(place, label) wherever the words of ``phrase`` stand consecutively in the array ``words``."""
    here = lambda i: reduce(lambda a, j: a & F.try_element_at(words, i + j + 1).eqNullSafe(F.lit(phrase[j])), range(1, len(phrase)), F.try_element_at(words, i + 1).eqNullSafe(F.lit(phrase[0])))
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), here), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))
