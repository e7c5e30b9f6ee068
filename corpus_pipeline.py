"""From documents to packed sequences: language ID, near-dedup, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame
that is written and read again as the next one's docs. All but the last return the columns of documents.
Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns have the results that
the operators' docstrings state; a document without a language is rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlore.llm import common, dedup, language, mixing, packing, pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.unique(docs, k=5, percent=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.clean(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return packing.pack(docs, path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("pii", private_data),
    ("mixing", target_mix),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the recurrent network, the sketches' components, raking or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written and read again; what a stage made goes once its result is written."""
    docs = common.table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES:
        mark = len(common.MADE)
        docs, path = common.write_scratch(stage(spark, docs, sf_dir), name)
        common.drop_since(spark, mark, path)
        common.drop_scratch(spark, *before)
        before = [path]
    return docs
