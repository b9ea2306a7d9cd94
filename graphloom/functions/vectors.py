"""Vector arithmetic as column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISTANCES = ("alt", "cosine", "dot", "euclidean", "hamming", "jaccard")
_INF = float("inf")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2norm(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def distance(kind: str, a: Column, b: Column) -> Column:
    """One of DISTANCES.

    alt: largest difference, 0 for empty vectors.  cosine: 1 - cosine, infinite for a zero vector.  dot: the
    negative product.  hamming: the share of places that differ.  jaccard: of sets of non-negative labels,
    NaN for two empty ones.
    """
    if kind == "alt":
        return F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0))
    if kind == "cosine":
        n = norm(a) * norm(b)
        return F.when(n > 0, 1 - F.try_divide(dot(a, b), n)).otherwise(F.lit(_INF))
    if kind == "dot":
        return -dot(a, b)
    if kind == "euclidean":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if kind == "hamming":
        return F.try_divide(total(F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))), F.size(a))
    if kind == "jaccard":
        x, y = (F.array_distinct(F.filter(v, lambda e: e >= 0)) for v in (a, b))
        both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
        return F.when(either > 0, 1 - F.try_divide(both.cast("double"), either)).otherwise(F.lit(float("nan")))
    raise ValueError(f"unknown distance {kind}")


def weighted_sums(rows: DataFrame, key: list[str], vector: str, weight: str | None = None, out: str = "vector") -> DataFrame:
    """(key, ``out``): per key the sum of ``weight`` * ``vector`` (or of vectors), dimension by dimension.

    Dimensions are summed with partial aggregation, so a key with many rows doesn't gather them in one task.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    parts = rows.select(*key, w.alias("_w"), F.posexplode(vector).alias("_pos", "_x")).groupBy(*key, "_pos").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"))
    return assemble(parts, key, out)


def assemble(parts: DataFrame, key: list[str], out: str = "vector") -> DataFrame:
    """(key, ``out``) from one row for each key and dimension (_pos, _s)."""
    return parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_s"))).alias("_v")).select(*key, F.transform("_v", lambda e: e["_s"]).alias(out))


def densify(parts: DataFrame, key: list[str], dims: int, out: str = "vector") -> DataFrame:
    """(key, ``out``): vectors of ``dims`` dimensions from sparse (_pos, _s) rows, zero elsewhere."""
    maps = parts.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_pos").cast("int"), "_s"))).alias("_m"))
    return maps.select(*key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias(out))
