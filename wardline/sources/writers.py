"""Writing corpora, reports and decision logs."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame

from wardline.operators.corpus import to_schema
from wardline.operators.stats import log_entries

TRAIN, EVAL, BENCHMARK_EVAL = "train.parquet", "eval.parquet", "benchmark_eval.parquet"


def write_corpus(split: DataFrame, benchmark: DataFrame | None, folder: str) -> dict[str, str]:
    """Write the `train` and `eval` parts, and the benchmark rows if there are any; returns the paths."""
    paths = {"train": f"{folder}/{TRAIN}", "eval": f"{folder}/{EVAL}"}
    for part, path in paths.items():
        to_schema(split.where(split["part"] == part)).write.mode("overwrite").parquet(path)
    if benchmark is not None and not benchmark.isEmpty():
        paths["benchmark"] = f"{folder}/{BENCHMARK_EVAL}"
        to_schema(benchmark).write.mode("overwrite").parquet(paths["benchmark"])
    return paths


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object per data set."""
    report.write.mode("overwrite").json(path)


def write_decision_log(decided: DataFrame, path: str, text_col: str = "text") -> bool:
    """Append one JSON line per decision. A failing log is reported and never fails the decisions."""
    try:
        log_entries(decided, text_col).write.mode("append").option("ignoreNullFields", "false").json(path)
    except Exception as error:
        logging.getLogger(__name__).warning("decision log not written: %s", error)
        return False
    return True
