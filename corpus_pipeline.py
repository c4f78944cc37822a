"""A corpus pipeline of five stages over the documents table; each stage gets what its predecessor kept.

Null and empty texts pass all stages but the last's budget; rows with a null id stay; wholly repeated rows become one in near_dedup;
of equal scores, sizes and hashes the smaller id goes first; empty tables stay empty; other columns go along under any name,
but mix_* columns, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, mixing, near_dedup, quality, substring_dedup
from tabulon.llm.common import cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier with site priors keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier place has; n_chars follows the text."""
    return substring_dedup.remove_repeats(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and in the order that the source weights ask for."""
    own = [c for c in docs.columns if not c.startswith("mix_")]
    out = mixing.mix(docs.select(own))
    return out.select(*own, "mix_pass", "mix_block", F.col("mix_order.block").alias("mix_block_order"), F.col("mix_order.row").alias("mix_row_order"))


STAGES = [("quality", good_quality), ("near_dedup", one_of_each_group), ("substring_dedup", without_repeats), ("decontamination", without_leaks), ("mixing", mixed)]

#: Classifier, sketches and alignment are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
