"""Grading a scorer: threshold sweep, best threshold, breakdown by attack type, report.

Counts are taken in one pass over the scored rows with two conditional counts per threshold; rows are never
multiplied by thresholds. Everything after that works on one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import settings
from wardline.functions.scores import at_least, half_even, ratio, score_or_zero
from wardline.workdir import written


def confusion_counts(
    scored: DataFrame,
    thresholds: Sequence[float] = settings.EVAL_THRESHOLDS,
    by: Sequence[str] = ("dataset",),
    score_col: str = "score",
) -> DataFrame:
    """One row per group and threshold with `tn, fp, fn, tp` and `n`; a missing score counts as 0.0."""
    score, label = score_or_zero(F.col(score_col)), F.col("label")
    sums = [F.count("*").alias("n"), F.count_if(label == 1).alias("positives"), F.count_if(label == 0).alias("negatives")]
    for i, t in enumerate(thresholds):
        predicted = at_least(score, F.lit(float(t)))
        sums += [F.count_if(predicted & (label == 1)).alias(f"tp{i}"), F.count_if(predicted & (label == 0)).alias(f"fp{i}")]
    per_threshold = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(float(t)).alias("threshold"),
            (F.col("negatives") - F.col(f"fp{i}")).alias("tn"),
            F.col(f"fp{i}").alias("fp"),
            (F.col("positives") - F.col(f"tp{i}")).alias("fn"),
            F.col(f"tp{i}").alias("tp"),
        )
        for i, t in enumerate(thresholds)
    ])
    return scored.groupBy(*by).agg(*sums).select(*by, "n", F.inline(per_threshold))


def confusion_matrix() -> Column:
    """`[[TN, FP], [FN, TP]]`."""
    return F.array(F.array("tn", "fp"), F.array("fn", "tp"))


def metric_columns(digits: int | None = 4) -> dict[str, Column]:
    """precision, recall, f1 and accuracy from the four counts; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    metrics = {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(tp * 2, tp * 2 + fp + fn),
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
    }
    return metrics if digits is None else {k: half_even(v, digits) for k, v in metrics.items()}


def threshold_sweep(
    scored: DataFrame,
    thresholds: Sequence[float] = settings.EVAL_THRESHOLDS,
    by: Sequence[str] = ("dataset",),
    score_col: str = "score",
) -> DataFrame:
    """Rounded metrics and confusion matrix per group and threshold; one given threshold overrides the list."""
    return confusion_counts(scored, thresholds, by, score_col).withColumns(
        {**metric_columns(), "confusion_matrix": confusion_matrix()}
    )


def metrics_at_threshold(
    scored: DataFrame, threshold: float, by: Sequence[str] = ("dataset",), score_col: str = "score"
) -> DataFrame:
    return threshold_sweep(scored, (threshold,), by, score_col)


def best_threshold(sweep: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """The first threshold, in list order, with the greatest rounded F1."""
    best = F.max(F.struct("f1", (-F.col("position")).alias("first"), "threshold"))
    return sweep.groupBy(*by).agg(best.alias("best")).select(
        *by, F.col("best.threshold").alias("threshold"), F.col("best.f1").alias("f1")
    )


def _typed_counts(scored: DataFrame, thresholds: Sequence[float], score_col: str, dataset_col: str) -> DataFrame:
    """Counts by data set and attack type, written: the rows are read once for all that is derived. A null type is `unknown`."""
    named = scored.withColumn("attack_type", F.coalesce("attack_type", F.lit("unknown")))
    return written(confusion_counts(named, thresholds, (dataset_col, "attack_type"), score_col), "evaluation-counts")


def _totals(typed: DataFrame, dataset_col: str) -> DataFrame:
    return typed.groupBy(dataset_col, "position", "threshold").agg(*[F.sum(c).alias(c) for c in ("n", "tn", "fp", "fn", "tp")])


def _breakdown(typed: DataFrame, dataset_col: str) -> DataFrame:
    best = best_threshold(_totals(typed, dataset_col).withColumns(metric_columns()), (dataset_col,)).select(dataset_col, "threshold")
    metrics = metric_columns()
    return typed.join(best, [dataset_col, "threshold"]).select(
        dataset_col, "attack_type", "threshold", "n", *[metrics[m].alias(m) for m in ("f1", "precision", "recall")]
    )


def attack_type_breakdown(
    scored: DataFrame,
    thresholds: Sequence[float] = settings.EVAL_THRESHOLDS,
    score_col: str = "score",
    dataset_col: str = "dataset",
) -> DataFrame:
    """Metrics per attack type at the data set's best threshold, from a single pass over the rows."""
    return _breakdown(_typed_counts(scored, thresholds, score_col, dataset_col), dataset_col)


def evaluation_report(
    scored: DataFrame,
    thresholds: Sequence[float] = settings.EVAL_THRESHOLDS,
    score_col: str = "score",
    dataset_col: str = "dataset",
) -> DataFrame:
    """One row per data set: name, n_samples, metrics per threshold, and breakdown if attack types are known.

    Nesting gathers one entry per threshold and per attack type, never rows of the input.
    """
    typed = _typed_counts(scored, thresholds, score_col, dataset_col) if "attack_type" in scored.columns else None
    counts = confusion_counts(scored, thresholds, (dataset_col,), score_col) if typed is None else _totals(typed, dataset_col)
    sweep = counts.withColumns({**metric_columns(), "confusion_matrix": confusion_matrix()})
    entry = F.struct("position", "threshold", "precision", "recall", "f1", "accuracy", "confusion_matrix")
    report = sweep.groupBy(F.col(dataset_col).alias("dataset")).agg(
        F.first("n").alias("n_samples"), F.array_sort(F.collect_list(entry)).alias("thresholds")
    ).withColumn("thresholds", F.transform("thresholds", lambda t: t.dropFields("position")))
    if typed is None:
        return report
    nested = _breakdown(typed, dataset_col).groupBy(F.col(dataset_col).alias("dataset")).agg(
        F.map_from_entries(
            F.collect_list(F.struct("attack_type", F.struct("n", "f1", "precision", "recall")))
        ).alias("attack_type_breakdown")
    )
    return report.join(nested, "dataset")


def argmax_metrics(predictions: DataFrame, by: Sequence[str] = (), benign: str = "p0", attack: str = "p1") -> DataFrame:
    """Unrounded metrics of the larger of two outputs; a tie goes to benign."""
    predicted, label = F.col(attack) > F.col(benign), F.col("label")
    counts = predictions.groupBy(*by).agg(
        F.count_if(predicted & (label == 1)).alias("tp"),
        F.count_if(predicted & (label == 0)).alias("fp"),
        F.count_if(~predicted & (label == 1)).alias("fn"),
        F.count_if(~predicted & (label == 0)).alias("tn"),
    )
    metrics = metric_columns(digits=None)
    return counts.select(*by, *[metrics[m].alias(m) for m in ("f1", "precision", "recall", "accuracy")])


def label_distribution(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "label").agg(F.count("*").alias("n"))


def source_distribution(df: DataFrame) -> DataFrame:
    """Rows per source, most frequent first."""
    return df.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")
