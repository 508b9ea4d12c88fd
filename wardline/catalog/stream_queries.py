"""Registered queries: the gate, its log and its counters on streams and in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.gate_queries import LOG_SQL, gated
from wardline.catalog.inputs import pattern_sql, table_stream, with_attacks, with_attacks_sql
from wardline.catalog.registry import query
from wardline.sources.readers import read_decision_log
from wardline.sources.writers import write_decision_log
from wardline.streaming import decisions as d
from wardline.workdir import new_path


@query("write_decision_log", LOG_SQL)
def written_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "decision-log")
    assert write_decision_log(gated(spark, sf_dir), path)
    return read_decision_log(spark, path).drop("timestamp")


@query("read_decision_log", LOG_SQL.replace("SELECT substr(text, 1, 120) AS text_preview, decision", "SELECT decision"))
def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a valid time stamp; the preview column is never read."""
    path = new_path(spark, "decision-log")
    write_decision_log(gated(spark, sf_dir), path)
    log = read_decision_log(spark, path).where(F.col("timestamp") <= F.current_timestamp())
    return log.select("decision", "stage", "score", "pattern", "latency_ms")


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a file stream."""
    return table_stream(spark, sf_dir, "conversations").select(
        "conv_id", "turn", with_attacks("conv_id").alias("text"),
        ((F.col("conv_id") * 7919 + F.col("turn") * 31) % 1000 / F.lit(1000.0)).alias("given_score"),
        (F.length("text") / F.lit(8.0)).alias("latency_ms"),
    )


_TURNS_SQL = f"""
turns AS (SELECT conv_id, turn, {with_attacks_sql('conv_id')} AS text,
  ((conv_id * 7919 + turn * 31) % 1000) / 1000::DOUBLE AS given_score, length(text) / 8::DOUBLE AS latency_ms FROM conversations),
matched AS (SELECT *, {pattern_sql('text')} AS pattern FROM turns),
decided AS (SELECT conv_id, turn, text, pattern, latency_ms, CASE WHEN pattern IS NULL THEN given_score END AS score,
  CASE WHEN pattern IS NOT NULL OR given_score >= 0.65 THEN 'BLOCKED' WHEN given_score < 0.4 THEN 'ALLOWED' ELSE 'REVIEW' END AS decision,
  CASE WHEN pattern IS NOT NULL THEN 1 ELSE 2 END AS stage FROM matched)"""


@query("gate_stream", f"WITH {_TURNS_SQL} SELECT conv_id, turn, decision, stage, score, pattern FROM decided")
def gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = d.gate_stream(_arriving(spark, sf_dir), scorer="given_score")
    path = new_path(spark, "stream-decisions")
    columns = ("conv_id", "turn", "decision", "stage", "score", "pattern")
    query_ = (
        decided.select(*columns).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    return spark.read.parquet(path)


@query("decision_log_stream", f"""
WITH {_TURNS_SQL} SELECT substr(text, 1, 120) AS text_preview, decision, stage, score, pattern FROM decided""")
def logged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = d.gate_stream(_arriving(spark, sf_dir), scorer="given_score")
    path = new_path(spark, "stream-log")
    d.decision_log_stream(decided, path, new_path(spark, "stream-state"), once=True).awaitTermination()
    return read_decision_log(spark, path).drop("timestamp", "latency_ms")


@query("running_stats", f"""
WITH {_TURNS_SQL} SELECT count(*) AS total_requests, count(*) FILTER (decision = 'BLOCKED') AS blocked_count,
  count(*) FILTER (decision = 'ALLOWED') AS allowed_count, count(*) FILTER (decision = 'REVIEW') AS review_count,
  count(*) FILTER (stage = 1) AS stage_1, count(*) FILTER (stage = 2) AS stage_2, count(*) FILTER (stage = 3) AS stage_3,
  printf('%.3f', avg(latency_ms))::DOUBLE AS average_latency_ms FROM decided""")
def running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = d.gate_stream(_arriving(spark, sf_dir), scorer="given_score")
    path = new_path(spark, "stream-counts")
    d.running_stats_stream(decided, path, new_path(spark, "stream-state"), once=True).awaitTermination()
    totals = d.stats_from_counts(d.read_running_counts(spark, path))
    stages = [F.col("stage_distribution")[f"stage_{s}"].alias(f"stage_{s}") for s in (1, 2, 3)]
    return totals.select("total_requests", "blocked_count", "allowed_count", "review_count", *stages, "average_latency_ms")
