"""Graphs are static tables here; ``edges_from_stream`` keeps one up to date from a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges_from_stream(rows: DataFrame, late: str = "1 hour", window: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """Summed edge weights per window of a stream of (src, dst, weight, time), late rows allowed for ``late``."""
    return rows.withWatermark(time_col, late).groupBy(F.window(time_col, window), "src", "dst").agg(F.sum("weight").alias("weight")).select("src", "dst", "weight", F.col("window.start").alias("since"))
