"""From documents to a training mix in five stages, each over all rows that the one before it kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm.decontaminate import decontaminate
from reviewloom.llm.language_id import keep_identified
from reviewloom.llm.minhash_dedup import keep_one
from reviewloom.llm.mix_sources import mixed
from reviewloom.llm.scratch import stage
from reviewloom.llm.suffix_dedup import cut_repeats


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language for half of their letters, go."""
    return keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, 0.8 or more) stays."""
    return keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start anywhere else too are cut out of the texts; rows stay."""
    return cut_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of times as ``copies`` (last column)."""
    return mixed(docs)


STAGES = [
    ("language_id", language_stage),
    ("minhash_dedup", near_duplicate_stage),
    ("suffix_dedup", repeats_stage),
    ("decontaminate", benchmark_stage),
    ("mix_sources", mix_stage),
]

#: Viterbi, signatures and suffix buckets have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
