"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over training time, a piecewise linear curve on [0, 1].  Integrated,
it gives the share of the source's words that is due up to a time; inverted, it gives each document
the time at which its first word is due.  Documents are range-sorted by that position.
"""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_WORDS, Scratch, col, fresh

#: Most buckets that a source's documents are dealt into; offsets are summed over buckets, never over all documents.
MOST_BUCKETS = 65_536
ROWS_A_BUCKET = 2_000
#: Steps of the table by which a schedule is inverted.
STEPS = 4_096


def fill_targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words due from each source: ``share`` of all words by weight, none above ``most`` times its size.

    The excess of a source that stops is shared again by weight among those below their limit, until
    none is above it; with nothing left to take it, the excess stays untaken.
    """
    total, caps = share * sum(sizes), [most * s for s in sizes]
    out, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    while left:
        whole = sum(weights[i] for i in left)
        due = {i: total * weights[i] / whole for i in left}
        over = [i for i in left if due[i] > caps[i]]
        if not over:
            for i in left:
                out[i] = due[i]
            break
        for i in over:
            out[i] = caps[i]
            total -= caps[i]
        left = [i for i in left if i not in over]
    return out


def cumulative(schedule: list[tuple[float, float]], steps: int = STEPS) -> np.ndarray:
    """The share of a source's demand that is due by each of ``steps`` + 1 even times, from its (time, weight) points."""
    t = np.linspace(0, 1, steps + 1)
    w = np.interp(t, [p[0] for p in schedule], [max(p[1], 0.0) for p in schedule])
    area = np.concatenate([[0.0], np.cumsum((w[1:] + w[:-1]) / 2)])
    return area / area[-1] if area[-1] > 0 else t


def default_schedule(rank: int, n: int) -> list[tuple[float, float]]:
    """Sources take turns: early ones fall, late ones rise, all last the whole time."""
    lean = 0.5 if n < 2 else rank / (n - 1)
    return [(0.0, 1.5 - lean), (1.0, 0.5 + lean)]


def curriculum_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    schedules: dict[str | None, list[tuple[float, float]]] | None = None,
    seed: int = 17,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per input row, with where in training its copies come, sorted by position, nulls last.

    Returns the columns ``carry`` (default: all but the text; those that clash with an added one give
    way) and: size, source_size, target, taken (words), n_copies (whole and part copies), position
    (time in [0, 1] of the first copy's first word, null if none is taken), positions (of each copy).

    A source's words are laid end to end in a fixed pseudo-random order and repeated; the mix takes the
    first ``target`` of them, so the document at the cut is taken in part and no document is taken more
    than ceil(``most``) times.  Sources stand by code point, null last; weights repeat along ``cycle``.
    Ties in the order are broken by id and size, and rows alike in all three are exchangeable, so reruns agree.

    A null or blank text has size 0, is never taken and keeps a null position.  A null source is a source
    of its own.  Null and repeated ids are rows like others.  An empty table gives an empty result.

    Scale: texts are read once, to count words.  A source is dealt into at most 65,536 hash buckets;
    running sums go within a bucket and over the bucket totals, so a source that holds a third of all
    rows is spread like the rest.
    """
    spark = docs.sparkSession
    added = ["size", "source_size", "target", "taken", "n_copies", "position", "positions"]
    given = [c for c in docs.columns if c != text_col] if carry is None else carry
    keep = [c for c in given if c.lower() not in added]
    size = F.coalesce(F.regexp_count(col(text_col), F.lit(SPACE_WORDS)), F.lit(0)).cast("long")
    src, order, bucket, start, due, n_b, curve, at, key = (fresh(docs.columns, f"_mix_{x}") for x in ("source", "order", "bucket", "start", "due", "buckets", "curve", "at", "key"))
    rows = docs.select(
        *[col(c) for c in keep], size.alias("size"), col(source_col).cast("string").alias(src), col(id_col).cast("string").alias(key), F.xxhash64(F.lit(seed), col(id_col).cast("string")).alias(order)
    )
    with Scratch(spark, "mix") as scratch:
        rows = scratch.cut(rows, "sized")
        # A row per source: sources are what the mix is parametrised by, each has a weight of its own.
        per = rows.groupBy(F.col(src).alias("s")).agg(F.sum("size").cast("long").alias("size"), F.count(F.lit(1)).alias("n")).toPandas()
        per = per.assign(null=per.s.isna(), at=per.s.map(lambda s: s.encode() if isinstance(s, str) else b"")).sort_values(["null", "at"]).reset_index(drop=True)
        names, sizes = [s if isinstance(s, str) else None for s in per.s], [int(x) for x in per["size"]]
        targets = fill_targets(sizes, [cycle[i % len(cycle)] for i in range(len(names))], share, most)
        plan = spark.createDataFrame(
            [
                (s, sizes[i], targets[i], round(targets[i]), int(min(MOST_BUCKETS, max(1, -(-int(per.n[i]) // ROWS_A_BUCKET)))), json.dumps((schedules or {}).get(s) or default_schedule(i, len(names))))
                for i, s in enumerate(names)
            ],
            f"_s string, source_size long, target double, `{due}` long, `{n_b}` long, `{curve}` string",
        )
        # Broadcast only while the plan is small; a longer one is joined like any table.
        rows = rows.join(F.broadcast(plan) if len(names) <= 100_000 else plan, F.col(src).eqNullSafe(F.col("_s"))).drop("_s")
        rows = rows.withColumn(bucket, F.pmod(F.shiftright(order, 7), F.col(n_b)))
        totals = rows.groupBy(F.col(src).alias("_s"), F.col(bucket).alias("_b")).agg(F.sum("size").alias("_n"))
        before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_from"))
        rows = rows.join(totals, F.col(src).eqNullSafe(F.col("_s")) & (F.col(bucket) == F.col("_b"))).drop("_s", "_b")
        inside = Window.partitionBy(src, bucket).orderBy(order, key, "size").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(start, F.col("_from") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

        # Copy k starts at start + k * source_size of the source's endless line; it is taken up to the cut.
        starts = F.transform(F.sequence(F.lit(0), F.lit(int(np.ceil(most)) - 1)), lambda k: F.col(start) + k * F.col("source_size"))
        rows = rows.withColumn(at, F.filter(starts, lambda x: (x < F.col(due)) & (F.col("size") > 0)))
        rows = rows.withColumn("taken", F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a + F.least(F.col("size"), F.col(due) - x)))
        rows = rows.withColumn("positions", invert(F.col(curve), F.col(due), F.col(at)))
        rows = rows.withColumns({"n_copies": F.size("positions"), "position": F.try_element_at("positions", F.lit(1))})
        out = scratch.keep(rows.select(*[col(c) for c in keep], *added, F.col(order)))
    return out.orderBy(F.col("position").asc_nulls_last(), order).drop(order)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def invert(curve: pa.Array, due: pa.Array, at: pa.Array) -> pa.Array:
    """The time at which a source's integrated schedule reaches each of the word offsets ``at``."""
    lengths = np.asarray(at.value_lengths().fill_null(0)).astype(np.int64)
    share = np.asarray(at.flatten()).astype(float) / np.maximum(1, np.repeat(np.asarray(due), lengths))
    coded = curve.dictionary_encode()
    which = np.repeat(np.asarray(coded.indices), lengths)
    out, flat = np.zeros(len(share)), np.linspace(0, 1, STEPS + 1)
    for k, text in enumerate(coded.dictionary.to_pylist()):
        out[which == k] = np.interp(share[which == k], cumulative(json.loads(text)), flat)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(out))
