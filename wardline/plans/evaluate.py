"""Scoring the evaluation sets and reporting on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import settings
from wardline.operators.evaluation import evaluation_report
from wardline.workdir import written


def evaluate_scorer(
    eval_sets: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    thresholds: Sequence[float] = settings.EVAL_THRESHOLDS,
) -> DataFrame:
    """The report on the scorer alone (rules are not applied), with attack types where there are any.

    Texts are scored once; only scores are kept.
    """
    known = [c for c in ("attack_type",) if c in eval_sets.columns]
    scored = scorer(eval_sets).select("dataset", "label", *known, F.col("injection_score").alias("score"))
    return evaluation_report(written(scored, "eval-scores"), thresholds)
