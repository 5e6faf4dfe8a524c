"""The corpus pipeline: quality, near-dedup, decontamination, mixing, token ids.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame that is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents. When a stage
begins, what the one before it left in the shared folder is removed: its result
has been written by then. Native memory that the driver's JVM has freed but kept
goes back to the system.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlane.llm import common, decontaminate, mixing, near_dedup, quality, token_ids

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies share 80 of 100 shingles of five words.
PERCENT = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accept(docs, quality.learn(docs, labels), quality.THRESHOLD)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs, PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards; what the shards hold of each document."""
    return token_ids.read(*token_ids.write(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_before: list = []


def _tidy(stage: Stage) -> Stage:
    """The stage, after the tables of the one before it are removed and the driver's memory is trimmed; the first one leaves an earlier run's tables alone."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if stage is not good:
            common.release(_before)
        common.trim(spark)
        held = common.made()
        out = stage(spark, docs, sf_dir)
        _before[:] = [x for x in common.made() if x not in held]
        return out

    return run


STAGES = [(name, _tidy(stage)) for name, stage in (("quality", good), ("near_dedup", one_of_each), ("decontaminate", without_benchmark), ("mixing", mix), ("token_ids", tokens))]

#: SQL has neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
