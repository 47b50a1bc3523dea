"""Corpus pipeline: from raw documents to a mixed training set, in five stages.

language -> near duplicates -> repeated passages -> benchmark items -> mix.
Each stage gets all that its predecessor kept, and its decisions take effect on
the rows; all but the last return the columns of documents, the last one adds
mix_times, how often the mix repeats the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import decontaminate, language, mixing, neardup, substrings
from larkspan.llm.shared import materialize
from larkspan.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without letters, or as good as random to all models, go."""
    ship(spark)
    return language.keep_identified(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    ship(spark)
    return neardup.keep_representatives(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of passages that stand elsewhere first; n_chars follows where a text has changed."""
    ship(spark)
    out = substrings.dedup_substrings(docs)
    cut = out.columns[-1]
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{cut}.sentences_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(cut)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with mix_times."""
    ship(spark)
    return mixing.take_mix(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_items", drop_benchmark_items),
    ("mix", mix_to_weights),
]

#: SuperMinHash families, sentence spans and the knapsack are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
