"""A corpus pipeline of five stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and is written as Parquet before the next one reads it. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifspark.llm import decontamination, line_dedup, mixing, ngram_join, quality
from motifspark.llm.queries import MIX_WEIGHTS, domain_of_source
from motifspark.llm.storage import read_table, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, but for their first place; n_chars follows the text."""
    out = line_dedup.line_dedup(docs, with_columns=True)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each chosen document is taken, for the target weights."""
    return mixing.mix_sources(docs, domain_of_source(F.col("source")), weights=MIX_WEIGHTS)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
