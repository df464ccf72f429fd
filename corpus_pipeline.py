"""A corpus pipeline of five operators: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage works on the table that the stage before it wrote. Lines that fail a rule go, then rejected documents, one
document of each group of near duplicates stays, contaminated documents go, sources are mixed to their weights, and the
mix is cut into shards. From the first stage on, text and n_chars are those without the failed lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, jaccard, mixing, oracles, quality, sharding
from vellum.llm.shared import discard, made_so_far, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs).withColumn("law", F.lit("bytes"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: DuckDB SQL for the rows of run().
ORACLE_SQL = oracles.pipeline()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    since = made_so_far()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, since, keep=(docs,))  # a stage's own tables, and the table before it, have served
    return docs
