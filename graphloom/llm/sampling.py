"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, remainder


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, rows: int, value: Column, id_col: str = "doc_id") -> DataFrame:
    """(_id, _y, _value): ids that carry a 0/1 ``label``, outside the held-out fold, and the ``value`` of their document.

    At most ``rows`` labels are used, those with the smallest hash of the id, so the sample is the same at
    every run, and has as many rows at most: of an id that several documents have the smallest value that is not null
    counts, reduced where the rows are read.  Ids that are null don't count; an id with different labels counts with the larger
    one; null labels don't count.  Only the chosen ids, of which there are ``rows`` at most, are broadcast.
    """
    y = col(label)
    chosen = (
        labels.where(y.isin(0, 1) & (remainder(col(id_col), mod) != held))
        .groupBy(col(id_col).alias("_id"))
        .agg(F.max(y).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    own = docs.select(col(id_col).alias("_doc"), value.alias("_value"))
    return own.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).where("_value is not null").groupBy("_id", "_y").agg(F.min("_value").alias("_value"))
