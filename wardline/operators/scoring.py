"""Stage 2 scorers: an own function over batches, or a text classifier trained with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Tuple

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.scores import half_even
from wardline.operators.evaluation import argmax_metrics
from wardline.operators.gate import Scorer
from wardline.operators.verdicts import each_alone
from wardline.workdir import written


ITERATIONS = 100


class MissingModelError(RuntimeError):
    """No fitted model where one was expected."""


def score_columns(df: DataFrame, injection: Column, benign: Column | None = None) -> DataFrame:
    """Add `injection_score` and `benign_score`, rounded to 6.

    A scorer with a single output gives the benign probability; pass it as `benign` with `injection` = 1 - it.
    """
    benign = F.lit(1.0) - injection if benign is None else benign
    return df.withColumns({"injection_score": half_even(injection, 6), "benign_score": half_even(benign, 6)})


class BatchScorer:
    """A scorer that is one column, so that the cascade can score the rows it has left in the pass that matches the rules."""

    def __init__(self, score: Callable, text_col: str, load: Callable[[], object] | None) -> None:
        def batches(parts: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load() if load else None

            def run(batch: pd.Series) -> pd.Series:
                return score(model, batch) if load else score(batch)

            for texts, wanted in parts:
                chosen = wanted.to_numpy(bool)
                scores = np.full(len(texts), np.nan)
                if chosen.any():
                    scores[chosen] = each_alone(run, texts[chosen].reset_index(drop=True)).to_numpy(float, na_value=np.nan)
                yield pd.Series(scores)

        self._scored, self._text_col = F.pandas_udf(batches, T.DoubleType()), text_col

    def column(self, wanted: Column) -> Column:
        """The function's score where `wanted` holds; elsewhere null, and neither text nor call reaches Python."""
        return self._scored(F.when(wanted, F.col(self._text_col)), wanted)

    def __call__(self, df: DataFrame) -> DataFrame:
        return score_columns(df.withColumn("_p", self.column(F.lit(True))), F.col("_p")).drop("_p")


def batch_scorer(
    score: Callable[[pd.Series], pd.Series], text_col: str = "text", load: Callable[[], object] | None = None
) -> BatchScorer:
    """A scorer from a function on a pandas Series of texts.

    With `load`, the function is called as `score(model, texts)` with the model loaded once per Python task,
    not per batch. Where it fails on a batch, its texts are scored one by one; those it fails on alone get null.
    """
    return BatchScorer(score, text_col, load)


def table_scorer(scores: DataFrame, id_col: str, score_col: str = "score") -> Callable[[DataFrame], DataFrame]:
    """A scorer that looks up scores computed elsewhere; rows without one get null, of several the greatest counts."""

    def apply(df: DataFrame) -> DataFrame:
        found = scores.groupBy(id_col).agg(F.max(F.col(score_col).cast("double")).alias("_p"))
        return score_columns(df.join(found, id_col, "left"), F.col("_p")).drop("_p")

    return apply


def text_classifier(features: int = 1 << 18, reg: float = 0.0, iterations: int = ITERATIONS) -> Pipeline:
    """Tokens of the whole text, hashed counts, IDF, logistic regression: all distributed stages.

    `iterations` bounds the fit; it ends earlier where it converges.
    """
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=r"\s+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="label", regParam=reg, maxIter=iterations),
    ])


def train_text_classifier(
    train: DataFrame,
    evaluation: DataFrame,
    regs: Sequence[float] = (0.01, 0.1),
    features: Sequence[int] = (1 << 16,),
    iterations: int = ITERATIONS,
) -> tuple[PipelineModel, float]:
    """The model with the greatest F1 on the evaluation rows, over the grid of parameters, and that F1.

    Texts are read once for each number of features: their counts are written, and all fits and their grading read these.
    """
    best: tuple[PipelineModel, float] | None = None
    for size in features:
        tokenizer, counting, weighing, _ = text_classifier(size).getStages()
        counted = PipelineModel([tokenizer, counting])
        known, held_out = (written(counted.transform(rows.select("text", "label")).select("_counts", "label"), f"classifier-{part}", "zstd")
                           for part, rows in (("train", train), ("evaluation", evaluation)))
        weights = weighing.fit(known)
        for reg in regs:
            fitted = text_classifier(size, reg, iterations).getStages()[-1].fit(weights.transform(known))
            f1 = argmax_metrics(_probabilities(fitted, weights.transform(held_out))).first()["f1"]
            if best is None or f1 > best[1]:
                best = (PipelineModel([tokenizer, counting, weights, fitted]), f1)
    return best


def model_scorer(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """Scores from a fitted pipeline; label 1 is injection."""

    def apply(df: DataFrame) -> DataFrame:
        scored = score_columns(_probabilities(model, df), F.col("p1"), F.col("p0"))
        return scored.select(*df.columns, "injection_score", "benign_score")

    return apply


def _probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    pair = vector_to_array("probability")
    return model.transform(df).select(*df.columns, pair[0].alias("p0"), pair[1].alias("p1"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """The saved model; `MissingModelError` when there is none."""
    try:
        return PipelineModel.load(path)
    except Exception as error:
        raise MissingModelError(f"Model directory not found: {path}") from error


def scorer_or_none(path: str) -> tuple[Scorer, str]:
    """(scorer, "") of a saved model, or (None, why) so that the gate can report it and go on."""
    try:
        return model_scorer(load_model(path)), ""
    except MissingModelError as error:
        return None, str(error)
