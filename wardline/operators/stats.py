"""Decision log projection and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scores import half_even, sanitize_score
from wardline.functions.text import text_preview

LOG_SCHEMA = (
    "timestamp timestamp, text_preview string, decision string, stage int, score double, pattern string, "
    "latency_ms double"
)
STAGES = (1, 2, 3)


def log_entries(decided: DataFrame, text_col: str = "text", at: Column | None = None) -> DataFrame:
    """One log entry per decision. `latency_ms` is taken over where the input has it, else null."""
    latency = F.col("latency_ms") if "latency_ms" in decided.columns else F.lit(None)
    return decided.select(
        (F.current_timestamp() if at is None else at).cast("timestamp").alias("timestamp"),
        text_preview(text_col).alias("text_preview"),
        "decision",
        "stage",
        sanitize_score(F.col("score")).alias("score"),
        "pattern",
        latency.cast("double").alias("latency_ms"),
    )


def decision_stats(log: DataFrame) -> DataFrame:
    """One row of totals; whatever is neither BLOCKED nor ALLOWED counts as review."""
    decision, stage = F.col("decision"), F.col("stage")
    stages = F.map_from_arrays(
        F.array(*[F.lit(f"stage_{s}") for s in STAGES]), F.array(*[F.count_if(stage == s) for s in STAGES])
    )
    return log.agg(
        F.count("*").alias("total_requests"),
        F.count_if(decision == "BLOCKED").alias("blocked_count"),
        F.count_if(decision == "ALLOWED").alias("allowed_count"),
        F.count_if(~F.coalesce(decision.isin("BLOCKED", "ALLOWED"), F.lit(False))).alias("review_count"),
        F.coalesce(half_even(F.avg("latency_ms"), 3), F.lit(0.0)).alias("average_latency_ms"),
        stages.alias("stage_distribution"),
    )
