"""From raw documents to a training mix: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from strideframe.llm.phases import released, settled


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely of a usable grade."""
    grades = quality.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select(docs, quality.fit(docs, grades))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines taken out; documents of which nothing is left go."""
    return line_dedup.without_runs(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, Jaccard of 0.8 or more."""
    return jaccard_join.representatives(docs, size=5, threshold=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a test item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every row that is left as often as it is taken, in shards `_shard` with shuffled order `_place`."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_classifier), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free), ("mixing sources to target weights", mix),
]

ORACLE_SQL = None  # a learned model and hashed draws have no SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage writes is deleted when the next one has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for _, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir))
        released(*before)
        before = [docs]
    return docs
