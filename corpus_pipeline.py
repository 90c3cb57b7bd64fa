"""A corpus pipeline: toxic documents and near copies go, benchmark passages go, personal data is pseudonymised, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srclake.llm import decontam, ngram_join, packing, pii, queries, toxicity
from srclake.llm.common import drop_path, for_texts, freeing_shuffles, scratch_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above the threshold go.

    A null or empty text scores like the labelled examples without words and
    stays where these are mostly clean; repeated rows share their fate. An
    empty table stays empty; all columns stay.
    """
    return toxicity.reject_toxic(docs, for_texts(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Null texts and those without words are linked with nothing and stay; of
    repeated rows one stays; all columns stay. An empty table stays empty.
    """
    for_texts(spark)
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go.

    Null and empty texts stay, and all columns; repeated rows share their fate.
    An empty table, here or there, is fine.
    """
    return decontam.drop_contaminated(docs, for_texts(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes pseudonyms; rows, columns and all other text stay, null texts too."""
    for_texts(spark)
    return pii.pseudonymise(docs, queries.run_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents become pieces of training sequences; a null or empty text is its end id. No rows give no rows."""
    for_texts(spark)
    return packing.pack(docs, queries.TOKENIZER)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pii", private), ("packing", pack)]

ORACLE_SQL = None  # learning, tokenising and Feistel rounds are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again.

    A stage's output is deleted when the one after the next is written; the last
    stays as long as the result may be read.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with freeing_shuffles(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
