"""Documents to training tokens: drop toxic documents, keep one of each group of near copies, mix, tokenise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import mixing, pieces, setjoin, toxicity
from attestra.plans.shipping import ship
from attestra.plans.staging import spent, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be toxic."""
    ship(spark)
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    ship(spark)
    return setjoin.one_of_each_group(docs, 5, (80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship(spark)
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and lossless of every row."""
    ship(spark)
    return pieces.encode(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("mixing", mix_sources), ("tokens", tokenise)]
#: SQL cannot express the label model and the merge agenda; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
            spent(before)
    return docs
