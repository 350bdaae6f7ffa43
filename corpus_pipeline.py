"""A corpus from raw documents: language, near-duplicates, benchmark contamination, source mix, shards.

Each stage takes (spark, docs, sf_dir), where docs is the table its predecessor wrote, and works on all of its rows.
Columns that it needs for itself get names that docs does not have; all stages but the last return docs' columns.
Null and empty texts: language rejects them. An empty table stays empty. Repeated rows are copies to the
near-duplicate stage, which keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontaminate, language_id, mixing, near_dedup, sharding
from docweave.llm.common import free_name, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject. The models learn from all rows that have a language: nothing is held out here."""
    model = language_id.train(docs)
    name = free_name(docs, "language")
    return docs.withColumn(name, language_id.predictor(docs, model)(F.col("text"))).where(~F.col(f"{name}.rejected")).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, of rows that agree in it any one. Texts without
    words are no copies of others and stay."""
    found = stored(near_dedup.near_duplicates(docs, words=5, percent=80), "groups")
    return near_dedup.representatives(docs, found)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: less than a twentieth of their words lie in benchmark windows."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.without(docs, found.where((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with shard, 0 to 7."""
    return sharding.text_tree(docs, leaves=8).assigned(docs)


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources to target weights", mixed_sources),
    ("sharding", sharded),
]

#: SQL cannot express the language models; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
