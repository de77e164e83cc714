"""The corpus pipeline: documents that pass each stage, then how often each is taken.

1. quality: documents that the classifier rejects go.
2. near_copies: one document of each group of near copies stays.
3. passages: passages that an earlier document has already are cut out.
4. benchmark: documents that hold benchmark texts go.
5. mix: copies of each document, so that sources meet their shares of all words.

Every stage works on all rows the one before it kept. Null texts and empty tables
pass through as the operators say; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valora.llm import _spark, decontaminate, mixing, ngram_join, quality, substring_dedup


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def by_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_each(docs)


def by_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def by_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality", by_quality), ("near_copies", by_near_copies), ("passages", by_passages), ("benchmark", by_benchmark), ("mix", by_mix)]

#: Trees, MinHash and Newton rounds are not SQL's; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _spark.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
