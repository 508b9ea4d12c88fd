"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of `documents` and works on all rows its predecessor kept. `run` gives the
rows of the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, decontaminate, quality, simhash, suffixes
from wardline.workdir import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one document: the smallest id, and of rows with that id one text."""
    return simhash.one_of_each(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings; a character that is cut goes whole. `n_chars` is counted again."""
    return suffixes.without_repeats(docs).withColumn(
        "n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    ranks = bpe.ranks_file()
    return bpe.digests(bpe.decode(bpe.encode(docs, ranks), ranks))


STAGES: list[tuple[str, Stage]] = [
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", remove_repeated_strings),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode_and_decode),
]

# No stage is expressible in SQL: learned scores, fingerprints by XXH64, ranked merges. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
