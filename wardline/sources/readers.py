"""Reading raw sources, prepared sets and decision logs. Nothing is listed or inferred beyond the schema."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.corpus import TRAINING_SOURCES, SourceSpec, union_sources
from wardline.operators.stats import LOG_SCHEMA

EVAL_SETS = {"eval": "internal_eval", "benchmark": "benchmark_eval"}


def read_or_none(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame | None:
    """The table at `path`, or None where there is nothing."""
    try:
        return spark.read.format(file_format).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def scan_splits(splits: Mapping[str, DataFrame], split_col: str = "split") -> DataFrame:
    """All splits of a data set as one table that names the split of each row."""
    parts = [df.withColumn(split_col, F.lit(name)) for name, df in splits.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_splits(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame | None:
    """`scan_splits` over the paths that exist; None when none does."""
    found = {name: df for name, path in paths.items() if (df := read_or_none(spark, path)) is not None}
    return scan_splits(found) if found else None


def source_registry(
    spark: SparkSession,
    paths: Mapping[str, Mapping[str, str]],
    specs: Sequence[SourceSpec] = TRAINING_SOURCES,
) -> DataFrame:
    """Training rows of every registered source: `paths` maps source to {split: path}; absent ones are skipped.

    A name that no spec describes is an error: its rows would be missing without notice.
    """
    unknown = sorted(set(paths) - {spec.name for spec in specs})
    if unknown:
        raise ValueError(f"no source spec for {', '.join(unknown)}")
    frames = {name: read_splits(spark, splits) for name, splits in paths.items()}
    return union_sources({name: df for name, df in frames.items() if df is not None}, specs)


def read_eval_sets(spark: SparkSession, paths: Mapping[str, str], choice: str = "all") -> DataFrame:
    """The chosen evaluation sets ("eval", "benchmark" or "all") with a `dataset` column. A missing one is reported; fails if none exists."""
    chosen = [k for k in EVAL_SETS if choice in (k, "all")]
    frames = []
    for key in chosen:
        df = read_or_none(spark, paths[key]) if key in paths else None
        if df is not None:
            frames.append(df.withColumn("dataset", F.lit(EVAL_SETS[key])))
        else:
            logging.getLogger(__name__).warning("evaluation set %s not found: %s", key, paths.get(key, "no path given"))
    if not frames:
        raise FileNotFoundError("no evaluation sets found; prepare the corpus first")
    return reduce(DataFrame.unionByName, frames)


def read_training_columns(spark: SparkSession, path: str) -> DataFrame:
    """Only text and label: the Parquet scan reads no other column."""
    return spark.read.parquet(path).select("text", "label")


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)
