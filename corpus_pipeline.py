"""A corpus cleaning pipeline out of the operators in netledger/llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the
next one. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from netledger.llm import bpe, decontaminate, jaccard, pii, quality
from netledger.llm.queries import BPE_RANKS, KEEP_FROM
from netledger.llm.shipping import ship_package
from netledger.llm.storage import stage
from netledger.llm.textops import unused


def well_written(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of grade 1 or better is at least KEEP_FROM; without rated documents, all of them."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_or_none(docs, quality.ratings_from_labels(labels), grades=3)
    if model is None:
        return docs
    name = unused("quality", docs.columns)
    return docs.withColumn(name, quality.graded(model, F.col("text"))).filter(F.col(name).tail_prob >= KEEP_FROM).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship_package(spark)
    return jaccard.one_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    ship_package(spark)
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with entities and disclosing terms rewritten."""
    return pii.sanitised(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of all documents."""
    ship_package(spark)
    return bpe.encode(docs, public_tokenizers.path(BPE_RANKS), bpe.token_ids, bpe.TOKEN_FIELDS)


STAGES = [
    ("quality", well_written),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("pii", without_personal_data),
    ("bpe", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs


#: No stage but PII is expressible in SQL (a fitted model, hashing, an edit search, a merge table): see tests/llm.
ORACLE_SQL = None
