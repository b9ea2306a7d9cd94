"""TSV files, gzip by suffix, and Parquet: edges, features, embeddings, rewards, aggregators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = "from_type string, from_name string, to_type string, to_name string, weight string"
FEATURES = "node_type string, node_name string, features string"
EMBEDDINGS = "node_type string, node_name string, vector string"
REWARDS = "node_type string, node_name string, reward string"


def tsv(spark: SparkSession, path: str, schema: str, skip_rows: int = 0) -> DataFrame:
    """Rows of exactly as many fields as the schema has; another number, or a bad value later, fails the read.

    ``skip_rows`` are header lines of each file; more than one is taken off by the place in the file.
    """
    names = T._parse_datatype_string(schema).fieldNames()
    lines = spark.read.text(path)
    if skip_rows:
        # The place of a line within its file: files of a graph's tables are split only past the header.
        lines = lines.withColumn("_f", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.file_block_start"))
        first = lines.where("_at = 0").withColumn("_i", F.monotonically_increasing_id())
        base = first.groupBy("_f").agg(F.min("_i").alias("_m"))
        head = first.join(F.broadcast(base), "_f").where(F.col("_i") - F.col("_m") >= skip_rows).select("value")
        lines = head.unionByName(lines.where("_at > 0").select("value"))
    cells = F.split("value", "\t", -1)
    wrong = F.raise_error(F.concat(F.lit(f"expected {len(names)} fields: "), "value")).cast("array<string>")
    rows = lines.where("value <> ''").select(F.when(F.size(cells) == len(names), cells).otherwise(wrong).alias("c"))
    return rows.select(*[F.col("c")[i].alias(n) for i, n in enumerate(names)])


def read_edges(spark: SparkSession, path: str, undirected: bool = False, weighted: bool = True, deduplicate: bool = False, skip_rows: int = 0) -> DataFrame:
    """(from_type, from_name, to_type, to_name, weight); unweighted edges weigh 1; undirected ones come both ways."""
    rows = tsv(spark, path, EDGES, skip_rows).withColumn("weight", F.col("weight").cast("double") if weighted else F.lit(1.0))
    if undirected:
        rows = rows.unionByName(rows.select(F.col("to_type").alias("from_type"), F.col("to_name").alias("from_name"), F.col("from_type").alias("to_type"), F.col("from_name").alias("to_name"), "weight"))
    return rows.groupBy("from_type", "from_name", "to_type", "to_name").agg(F.sum("weight").alias("weight")) if deduplicate else rows


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(node_type, node_name, pos, name): blank-separated features in order."""
    words = F.filter(F.split("features", r"\s+"), lambda x: x != "")
    return tsv(spark, path, FEATURES).select("node_type", "node_name", F.posexplode(words).alias("pos", "name"))


def read_embeddings(spark: SparkSession, path: str, types: list[str] | str | None = None, skip_rows: int = 0) -> DataFrame:
    """(node_type, node_name, vector); other types are left out before vectors are parsed; repeats and ragged rows fail."""
    rows = tsv(spark, path, EMBEDDINGS, skip_rows)
    if types is not None:
        rows = rows.where(F.col("node_type").isin([types] if isinstance(types, str) else list(types)))
    rows = rows.select("node_type", "node_name", F.from_json("vector", "array<double>").alias("vector"))
    bad = rows.groupBy("node_type", "node_name").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if bad.n and bad.n > 1:
        raise KeyError("an embedding is there twice")
    if bad.lo != bad.hi:
        raise ValueError(f"embeddings have {bad.lo} to {bad.hi} dimensions")
    return rows


def read_rewards(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, REWARDS).withColumn("reward", F.col("reward").cast("double"))


def write_tsv(rows: DataFrame, path: str, compression: str | None = None) -> None:
    """Columns as they are, tab-separated, without a header; vectors as [x,y,...]."""
    shown = [F.concat(F.lit("["), F.concat_ws(",", F.transform(n, lambda x: x.cast("string"))), F.lit("]")) if t.startswith("array") else F.col(n).cast("string") for n, t in rows.dtypes]
    rows.select(F.concat_ws("\t", *shown).alias("value")).write.mode("overwrite").option("compression", compression or "none").text(path)


def save_aggregator(spark: SparkSession, path: str, kind: str, **how) -> None:
    spark.createDataFrame([(json.dumps({"kind": kind, **how}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_aggregator(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)
