"""The corpus pipeline: quality rules, near-duplicate removal, personal data, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over documents' columns; the last gives the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import neardup, packing, pii, quality
from sievewright.llm.common import staged
from sievewright.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id."""
    return neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json").decode())


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("packing", pack)]
#: A chain of estimates, trained labelers and packings: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{k}")
    return docs
