"""The decision cascade: rules, then score, then verdict; one of ALLOWED, BLOCKED, REVIEW per row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import settings
from wardline.functions.rules import DEFAULT_RULES, Rule, match_rules
from wardline.functions.scores import at_least, below, effective_threshold, fixed, half_even
from wardline.operators.verdicts import ERROR_REASON, one_per_id
from wardline.workdir import BROADCAST_BYTES, BROADCAST_ROWS, written

DECISION_COLUMNS = ("decision", "stage", "score", "pattern", "reasoning")

Scorer = str | Column | Callable[[DataFrame], DataFrame] | None


def decide(
    df: DataFrame,
    score: Column | None,
    threshold: Column | None = None,
    default_threshold: float = settings.BLOCK_THRESHOLD,
    lower: float = settings.AMBIGUOUS_LOWER,
    upper: float = settings.AMBIGUOUS_UPPER,
    verdict: tuple[Column, Column, Column] | None = None,
    unavailable: str = "no scorer given",
) -> DataFrame:
    """Add the decision columns to rows that have `pattern`; all in one native CASE chain.

    `upper` appears in a message only: the ambiguous zone is [lower, threshold). `verdict` is
    (is_injection, confidence, reasoning), null where the reviewer gave nothing; None means there is none.
    """
    pattern = F.col("pattern")
    hit = pattern.isNotNull()
    hit_reason = F.concat(F.lit("Heuristic pattern matched: "), pattern)
    if score is None:
        return df.withColumns({
            "decision": F.when(hit, "BLOCKED").otherwise("REVIEW"),
            "stage": F.when(hit, 1).otherwise(2),
            "score": F.lit(None).cast("double"),
            "reasoning": F.when(hit, hit_reason).otherwise(F.lit(f"Stage 2 model unavailable: {unavailable}")),
        })

    score = score.cast("double")
    limit = effective_threshold(F.lit(None) if threshold is None else threshold, default_threshold)
    missing = score.isNull()
    block, allow = at_least(score, limit), below(score, F.lit(float(lower)))
    shown = F.when(F.isnan(score), F.lit("nan")).otherwise(fixed(score, 4))

    def branch(on_hit, on_missing, on_block, on_allow, on_ambiguous) -> Column:
        return (
            F.when(hit, on_hit).when(missing, on_missing).when(block, on_block).when(allow, on_allow)
            .otherwise(on_ambiguous)
        )

    zone = F.concat(F.lit("Score "), shown, F.lit(f" in ambiguous zone [{lower}, {upper}); Stage 3 disabled"))
    if verdict is None:
        last = (F.lit("REVIEW"), F.lit(2), score, zone)
    else:
        injection, confidence, reasoning = verdict
        last = (
            F.when(F.coalesce(injection, F.lit(False)), "BLOCKED").otherwise("ALLOWED"),
            F.lit(3),
            F.coalesce(confidence, F.lit(0.5)),
            F.coalesce(reasoning, F.lit(ERROR_REASON)),
        )
    none = F.lit(None).cast("double")
    return df.withColumns({
        "decision": branch(F.lit("BLOCKED"), F.lit("REVIEW"), F.lit("BLOCKED"), F.lit("ALLOWED"), last[0]),
        "stage": branch(F.lit(1), F.lit(2), F.lit(2), F.lit(2), last[1]),
        "reasoning": branch(
            hit_reason,
            F.lit(f"Stage 2 model unavailable: {unavailable}"),
            F.concat(F.lit("Classifier score "), shown, F.lit(" exceeds threshold "), fixed(limit, 2)),
            F.concat(F.lit("Classifier score "), shown, F.lit(" below ambiguous zone")),
            last[3],
        ),
        "score": branch(none, none, score, score, last[2]),
    })


def ambiguous(
    score: Column,
    threshold: Column | None = None,
    default_threshold: float = settings.BLOCK_THRESHOLD,
    lower: float = settings.AMBIGUOUS_LOWER,
) -> Column:
    """True for rows that no rule and no bound settles, so that a verdict is needed (NaN scores too)."""
    score = score.cast("double")
    limit = effective_threshold(F.lit(None) if threshold is None else threshold, default_threshold)
    return (
        F.col("pattern").isNull()
        & score.isNotNull()
        & ~at_least(score, limit)
        & ~below(score, F.lit(float(lower)))
    )


def score_survivors(
    df: DataFrame, scorer: Scorer, text_col: str = "text", rules: Sequence[Rule] = DEFAULT_RULES
) -> DataFrame:
    """Match the rules and add `_score` for the rows they leave.

    An expression is evaluated lazily inside the CASE chain. A scorer with a `column` method is told which rows are left and skips
    the others, in the same pass. Any other DataFrame function runs only on the rows without a rule hit.
    """
    matched = match_rules(df, text_col, rules)
    if not isinstance(scorer, Column) and hasattr(scorer, "column"):
        scored = matched.withColumn("_score", scorer.column(F.col("pattern").isNull()))
        return scored.withColumn("_score", half_even(F.col("_score"), 6))
    if callable(scorer) and not isinstance(scorer, Column):
        left = scorer(matched.where(F.col("pattern").isNull()))
        left = left.withColumn("_score", F.col("injection_score").cast("double"))
        left = left.select(*matched.columns, "_score")
        hits = matched.where(F.col("pattern").isNotNull())
        return left.unionByName(hits.withColumn("_score", F.lit(None).cast("double")))
    score = F.col(scorer) if isinstance(scorer, str) else scorer
    return matched.withColumn("_score", F.when(F.col("pattern").isNull(), score.cast("double")))


def gate(
    df: DataFrame,
    scorer: Scorer = None,
    text_col: str = "text",
    threshold_col: str | None = None,
    verdicts: DataFrame | None = None,
    id_col: str | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    default_threshold: float = settings.BLOCK_THRESHOLD,
    lower: float = settings.AMBIGUOUS_LOWER,
    upper: float = settings.AMBIGUOUS_UPPER,
    unavailable: str = "no scorer given",
) -> DataFrame:
    """Decide every row of `df`, batch or stream.

    `scorer`: a score column or expression, a function DataFrame -> DataFrame adding `injection_score`, or
    None when no model is ready. `verdicts`: (id_col, is_injection, confidence, reasoning) for ambiguous
    rows; a row without one counts as a reviewer error, of several the most severe holds. They are written when the gate is called;
    if they are small, all rows are decided in one pass beside a broadcast of them. Otherwise the ambiguous rows are shuffled to
    them, alone, in a pass of their own.
    """
    if scorer is None:
        return decide(match_rules(df, text_col, rules), None, unavailable=unavailable)
    scored = score_survivors(df, scorer, text_col, rules)
    score = F.col("_score")
    threshold = F.col(threshold_col) if threshold_col else None
    bounds = dict(threshold=threshold, default_threshold=default_threshold, lower=lower, upper=upper)
    if verdicts is None:
        return decide(scored, score, **bounds).drop("_score")
    answers = one_per_id(verdicts, id_col).select(
        F.col(id_col),
        F.col("is_injection").alias("_injection"),
        F.col("confidence").alias("_confidence"),
        F.col("reasoning").alias("_reasoning"),
    )
    verdict = (F.col("_injection"), F.col("_confidence"), F.col("_reasoning"))
    if not verdicts.isStreaming:
        answers = written(answers, "gate-verdicts")
        if _may_be_broadcast(answers, id_col):
            beside = scored.join(F.broadcast(answers), id_col, "left").select(*scored.columns, *verdict)
            return decide(beside, score, **bounds, verdict=verdict).drop("_score", "_injection", "_confidence", "_reasoning")
    open_rows = ambiguous(score, threshold, default_threshold, lower)
    settled = decide(scored.where(~open_rows), score, **bounds)
    reviewed = decide(scored.where(open_rows).join(answers, id_col, "left"), score, **bounds, verdict=verdict)
    return settled.drop("_score").unionByName(
        reviewed.drop("_score", "_injection", "_confidence", "_reasoning")
    )


def _may_be_broadcast(answers: DataFrame, id_col: str) -> bool:
    """Whether the written verdicts are few and short enough to be sent to every executor."""
    length = F.octet_length(F.col(id_col).cast("string")) + F.coalesce(F.octet_length("_reasoning"), F.lit(0))
    size = answers.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
    return size.n <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES


def ambiguous_subset(
    df: DataFrame,
    scorer: Scorer,
    text_col: str = "text",
    threshold_col: str | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    default_threshold: float = settings.BLOCK_THRESHOLD,
    lower: float = settings.AMBIGUOUS_LOWER,
) -> DataFrame:
    """The rows that need a verdict, with their `score`."""
    scored = score_survivors(df, scorer, text_col, rules)
    threshold = F.col(threshold_col) if threshold_col else None
    return (
        scored.where(ambiguous(F.col("_score"), threshold, default_threshold, lower))
        .withColumn("score", F.col("_score"))
        .drop("_score", "pattern", "s1_matched")
    )


def validate_requests(df: DataFrame, text_col: str = "text", threshold_col: str | None = "threshold") -> DataFrame:
    """Add `reject_reason`, null for valid requests: text of at least one character, threshold in [0, 1]."""
    text = F.col(text_col)
    reason = F.when(text.isNull(), "text missing").when(F.length(text) < 1, "text empty")
    if threshold_col:
        t = F.col(threshold_col).cast("double")
        reason = reason.when(t.isNotNull() & (F.isnan(t) | (t < 0.0) | (t > 1.0)), "threshold outside [0, 1]")
    return df.withColumn("reject_reason", reason)


def split_requests(df: DataFrame, text_col: str = "text", threshold_col: str | None = "threshold") -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejected requests with their reason)."""
    checked = validate_requests(df, text_col, threshold_col)
    valid = F.col("reject_reason").isNull()
    return checked.where(valid).drop("reject_reason"), checked.where(~valid)
