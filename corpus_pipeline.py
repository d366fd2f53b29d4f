"""A training-data pipeline over `documents`: each stage reads what its predecessor wrote.

Toxic documents go; of each group of near copies one document stays; personal data is replaced; sources are mixed to their target weights (documents are then repeated or left
out); the mix is packed into training sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entrofield.llm import jaccard_join, mixing, packing, pii, toxicity
from entrofield.llm.common import shared_dir, stored, table
from entrofield.llm.queries import PII_KEY, remainder


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more; trained on labels outside the held-out fold, from the unfiltered documents."""
    training = remainder(F.col("doc_id"), 5) != 0
    return toxicity.reject(docs, toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), training))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join stays."""
    return jaccard_join.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, PII_KEY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.plan(docs).mixed()


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", private_data),
    ("mixing", mixture),
    ("best_fit_packing", pack),
]

#: SQL has no counterpart of the trained network, the keyed draws or the packing; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{root}/{i}-{name}")
    return docs
