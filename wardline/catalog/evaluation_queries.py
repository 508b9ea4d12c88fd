"""Registered queries: grading, training, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.corpus_queries import SPLIT_SQL
from wardline.catalog.inputs import SCORED_SQL, counts_sql, metrics_sql, scored, table
from wardline.catalog.registry import query
from wardline.functions.scores import score_or_zero
from wardline.operators import evaluation as e
from wardline.operators.sampling import stratified_split
from wardline.operators.scoring import batch_scorer, load_model, model_scorer, save_model, train_text_classifier
from wardline.plans.evaluate import evaluate_scorer
from wardline.sources.writers import write_report
from wardline.workdir import new_path

# The matrix as JSON text, which compares the same whatever the client makes of nested arrays.
_MATRIX_SQL = "'[[' || tn || ',' || fp || '],[' || fn || ',' || tp || ']]'"
_ALL = metrics_sql("precision", "recall", "f1", "accuracy")
_SWEEP_SQL = f"{counts_sql()}, sweep AS (SELECT *, {_ALL} FROM counts)"
_BEST_SQL = "best AS (SELECT dataset, arg_max(threshold, (f1, -position)) AS threshold, max(f1) AS f1 FROM sweep GROUP BY dataset)"


@query("confusion_matrix", f"WITH {counts_sql()} SELECT dataset, threshold, {_MATRIX_SQL} AS confusion_matrix FROM counts")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.confusion_counts(scored(spark, sf_dir)).select(
        "dataset", "threshold", F.to_json(e.confusion_matrix()).alias("confusion_matrix")
    )


@query("metrics_at_threshold", f"""
WITH {counts_sql(thresholds='(0, 0.55)')} SELECT dataset, threshold, {_ALL} FROM counts""")
def metrics_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = e.metrics_at_threshold(scored(spark, sf_dir), 0.55)
    return sweep.select("dataset", "threshold", "precision", "recall", "f1", "accuracy")


SWEEP_COLUMNS = ("dataset", "position", "threshold", "n", "tn", "fp", "fn", "tp", "precision", "recall", "f1", "accuracy")


@query("threshold_sweep", f"WITH {_SWEEP_SQL} SELECT {', '.join(SWEEP_COLUMNS)} FROM sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.threshold_sweep(scored(spark, sf_dir)).select(*SWEEP_COLUMNS)


@query("best_threshold", f"WITH {_SWEEP_SQL}, {_BEST_SQL} SELECT dataset, threshold, f1 FROM best")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.best_threshold(e.threshold_sweep(scored(spark, sf_dir)))


_BREAKDOWN_SQL = f"""
WITH {_SWEEP_SQL}, {_BEST_SQL},
typed AS (SELECT dataset, attack_type, b.threshold, label, NOT isnan(coalesce(score, 0.0::DOUBLE))
    AND coalesce(score, 0.0::DOUBLE) >= b.threshold AS hit FROM scored JOIN best b USING (dataset)),
by_type AS (SELECT dataset, attack_type, threshold, count(*) AS n, count(*) FILTER (NOT hit AND label = 0) AS tn,
    count(*) FILTER (hit AND label = 0) AS fp, count(*) FILTER (NOT hit AND label = 1) AS fn,
    count(*) FILTER (hit AND label = 1) AS tp FROM typed GROUP BY dataset, attack_type, threshold)
SELECT dataset, attack_type, threshold, n, {metrics_sql('f1', 'precision', 'recall')} FROM by_type"""


@query("attack_type_breakdown", _BREAKDOWN_SQL)
def attack_type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.attack_type_breakdown(scored(spark, sf_dir))


@query("score_or_zero", f"WITH {SCORED_SQL} SELECT doc_id, coalesce(score, 0.0::DOUBLE) AS score FROM scored")
def zeroed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", score_or_zero(F.col("score")).alias("score"))


@query("argmax_metrics", f"""
WITH {SCORED_SQL}, pairs AS (SELECT dataset, label, (doc_id % 10)::DOUBLE AS p0, (doc_id % 7 + toxic * 3)::DOUBLE AS p1
    FROM scored JOIN labels USING (doc_id)),
counts AS (SELECT dataset, count(*) FILTER (p1 > p0 AND label = 1) AS tp, count(*) FILTER (p1 > p0 AND label = 0) AS fp,
    count(*) FILTER (p1 <= p0 AND label = 1) AS fn, count(*) FILTER (p1 <= p0 AND label = 0) AS tn FROM pairs GROUP BY dataset)
SELECT dataset, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END AS f1,
  CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS "precision",
  CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall,
  (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy FROM counts""")
def argmax_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    pairs = scored(spark, sf_dir).withColumns({
        "p0": (doc % 10).cast("double"), "p1": (doc % 7 + F.col("label") * 3).cast("double")
    })
    return e.argmax_metrics(pairs, by=["dataset"])


def _eval_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    kind = F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, "jailbreak").otherwise("direct_override"))
    return docs.select(
        "doc_id", "text", F.col("lang").alias("dataset"), F.col("toxic").alias("label"),
        kind.otherwise("benign").alias("attack_type"),
    )


_LENGTH_SCORED_SQL = counts_sql().replace(
    SCORED_SQL,
    """
scored AS (SELECT doc_id, lang AS dataset, toxic AS label, (length(text) % 1000) / 1000::DOUBLE AS score
  FROM documents JOIN labels USING (doc_id))""",
)
_REPORT_SQL = f"""
WITH {_LENGTH_SCORED_SQL}, sweep AS (SELECT *, {_ALL} FROM counts)
SELECT dataset, n AS n_samples, threshold, "precision", recall, f1, accuracy, {_MATRIX_SQL} AS confusion_matrix FROM sweep"""


def _flat_report(report: DataFrame) -> DataFrame:
    flat = report.select("dataset", "n_samples", F.explode("thresholds").alias("m")).select("dataset", "n_samples", "m.*")
    return flat.withColumn("confusion_matrix", F.to_json("confusion_matrix"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scorer = batch_scorer(lambda texts: texts.str.len() % 1000 / 1000.0)
    return evaluate_scorer(_eval_sets(spark, sf_dir), scorer)


@query("evaluation_report", _REPORT_SQL)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report of an own scorer, flattened again for comparison."""
    return _flat_report(_report(spark, sf_dir))


@query("write_report", _REPORT_SQL)
def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _report(spark, sf_dir)
    path = new_path(spark, "report")
    write_report(report, path)
    return _flat_report(spark.read.schema(report.schema).json(path))


def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _eval_sets(spark, sf_dir).withColumn("row_key", F.col("doc_id").cast("string"))
    return stratified_split(rows)


_HELD_OUT_SQL = f"""
examples AS (SELECT doc_id::VARCHAR AS row_key, lang AS dataset, toxic AS label FROM documents JOIN labels USING (doc_id)),
{SPLIT_SQL}"""


@query("train_text_classifier", f"""
WITH {_HELD_OUT_SQL}, thresholds AS (SELECT threshold::DOUBLE AS threshold FROM (VALUES (0.3), (0.4), (0.5), (0.6), (0.7), (0.8)) v(threshold))
SELECT dataset, threshold, count(*) AS n, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives
FROM parts, thresholds WHERE part = 'eval' GROUP BY dataset, threshold""")
def trained_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best model's confusion counts on the held-out part, added up to what the split alone determines."""
    split = _training_rows(spark, sf_dir)
    train, held_out = split.where("part = 'train'"), split.where("part = 'eval'")
    model, _ = train_text_classifier(train, held_out)
    scores = model_scorer(model)(held_out).withColumn("score", F.col("injection_score"))
    negatives, positives = (F.col("tn") + F.col("fp")).alias("negatives"), (F.col("fn") + F.col("tp")).alias("positives")
    return e.threshold_sweep(scores).select("dataset", "threshold", "n", negatives, positives)


@query("save_load_model", "SELECT doc_id, true AS same_score FROM documents")
def reloaded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document gets the same score from a model and from its copy saved and loaded again."""
    split = _training_rows(spark, sf_dir)
    model, _ = train_text_classifier(split.where("part = 'train'"), split.where("part = 'eval'"), regs=(0.05,))
    path = new_path(spark, "model")
    save_model(model, path)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    again = model_scorer(load_model(path))(model_scorer(model)(docs).withColumnRenamed("injection_score", "before").drop("benign_score"))
    return again.select("doc_id", F.col("injection_score").eqNullSafe(F.col("before")).alias("same_score"))
