"""The gate on Structured Streaming: decisions, their log, and counters since the start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.functions.scores import half_even
from wardline.operators.gate import gate
from wardline.operators.stats import STAGES, log_entries

# The mark of a finished table of counters, and how many tables are kept.
FINISHED, KEPT_BATCHES = "_finished", 3


def gate_stream(requests: DataFrame, **options) -> DataFrame:
    """Decide each arriving text. Stateless: the batch gate as it is, so both give the same decisions."""
    return gate(requests, **options)


def decision_log_stream(decided: DataFrame, path: str, checkpoint: str, once: bool = False, text_col: str = "text") -> StreamingQuery:
    """Append each decision to JSON files, exactly once across restarts."""
    writer = (
        log_entries(decided, text_col).writeStream.format("json").option("ignoreNullFields", "false")
        .outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_counts(decided: DataFrame) -> DataFrame:
    """Counters per decision and stage since the start: at most nine keys of state, so no watermark."""
    latency = F.col("latency_ms") if "latency_ms" in decided.columns else F.lit(None).cast("double")
    return decided.groupBy("decision", "stage").agg(
        F.count("*").alias("n"), F.sum(latency).alias("latency_sum"), F.count(latency).alias("latency_count")
    )


def running_stats_stream(decided: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the counters as small tables under `path`, one for each batch; `read_running_counts` reads the newest finished one.

    A table counts as finished when its mark stands, an empty file that is created after the last row is written and goes with the table. A batch that is
    replayed writes its own table again; the last `KEPT_BATCHES` stay, for readers that have begun with an older one.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = f"{path}/batch={number}"
        batch.coalesce(1).write.mode("overwrite").parquet(table)  # at most nine rows
        files, path_of = _files(spark, path)
        files.createNewFile(path_of(f"{table}/{FINISHED}"))
        files.delete(path_of(f"{path}/batch={number - KEPT_BATCHES}"), True)

    writer = running_counts(decided).writeStream.outputMode("complete").foreachBatch(store).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def _files(spark: SparkSession, path: str):
    """The file system of `path`, and the type of its paths."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark._jsc.hadoopConfiguration()), path_of


def read_running_counts(spark: SparkSession, path: str, attempts: int = 5) -> DataFrame:
    """The counters after the newest finished batch, at most nine rows, read at once; an error where no batch is finished.

    Should the table be gone before it is read, because the reader was held up for several batches, the newest one is looked up again.
    """
    files, path_of = _files(spark, path)
    for attempt in range(attempts):
        marks = [str(mark.getPath().getParent()) for mark in files.globStatus(path_of(f"{path}/batch=*/{FINISHED}")) or ()]
        if not marks:
            raise FileNotFoundError(f"no finished batch below {path}")
        try:
            counts = spark.read.parquet(max(marks, key=lambda table: int(table.rsplit("=", 1)[1])))
            return spark.createDataFrame(counts.collect(), counts.schema)
        except Exception:
            if attempt + 1 == attempts:
                raise


def stats_from_counts(counts: DataFrame) -> DataFrame:
    """The totals of `decision_stats`, from the counters; a null decision counts as review there and here."""
    n, decision, stage = F.col("n"), F.col("decision"), F.col("stage")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    average = F.sum("latency_sum") / F.nullif(F.sum("latency_count"), F.lit(0))
    return counts.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_requests"),
        total(decision == "BLOCKED").alias("blocked_count"),
        total(decision == "ALLOWED").alias("allowed_count"),
        total(~F.coalesce(decision.isin("BLOCKED", "ALLOWED"), F.lit(False))).alias("review_count"),
        F.coalesce(half_even(average, 3), F.lit(0.0)).alias("average_latency_ms"),
        F.map_from_arrays(F.array(*[F.lit(f"stage_{s}") for s in STAGES]), F.array(*[total(stage == s) for s in STAGES])).alias(
            "stage_distribution"),
    )
