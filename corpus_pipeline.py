"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Models are fitted on the documents a stage is given and on ``labels``.  Null ids, null texts,
repeated rows, other columns and empty tables pass through, but for what a stage says it drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, jaccard, language, mixing, toxicity
from graphloom.session import Scratch, ship

#: SQL can't express the fitted stages.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that are null, empty or without a letter go, and all if no language is given to learn from."""
    ship(spark)
    found = language.identify(docs, language.fit(docs))
    mark = found.columns[-1]
    return found.where(F.col(f"{mark}.lang_pred") != language.UNKNOWN).drop(mark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; without labels of both kinds all score the share of toxic labels."""
    ship(spark)
    found = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    mark = found.columns[-1]
    return found.where(F.col(mark) < 0.5).drop(mark)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of their five-word shingles; rows without an id or words stay."""
    ship(spark)
    return jaccard.keep_one(docs, 5, 80, 100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no twentieth lies inside 13-word windows of benchmark items; those without words stay."""
    ship(spark)
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    mark = found.columns[-1]
    return found.where(~F.col(f"{mark}.contaminated")).drop(mark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and when."""
    ship(spark)
    return mixing.curriculum_mix(docs, carry=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stands between them is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.cut(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
