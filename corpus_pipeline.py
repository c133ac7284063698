"""From raw documents to encoded training text: STAGES in order, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orevein.llm.common import dropped, read_documents, stored
from orevein.llm.exact_dedup import first_copies
from orevein.llm.importance import keep_good
from orevein.llm.mixing import take
from orevein.llm.near_dedup import one_of_each
from orevein.llm.pieces import encoded


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance weights of good ones against all keep."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    return first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard index of 0.8 and more), the one with the smallest doc_id."""
    return one_of_each(docs, similarity=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return take(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every row."""
    return encoded(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("encoding", encoding)]

#: Sampling by hashed n-grams, MinHash and merges of pieces are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has left is deleted as soon as the next one has written its own."""
    docs, before = read_documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
