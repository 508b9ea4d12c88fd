import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wardline.functions.scores import half_even, sanitize_score
from wardline.operators import evaluation as e
from wardline.operators.stats import decision_stats
from wardline.plans.evaluate import evaluate_scorer
from wardline.sources.writers import write_report

NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame(rows, "dataset string, attack_type string, label int, score double")


@pytest.mark.parametrize("digits", [2, 3, 4, 6])
def test_rounding_like_python(spark, digits):
    rng = random.Random(digits)
    values = [rng.random() for _ in range(3000)] + [k / 20000 for k in range(3000)] + [i / 32 for i in range(64)]
    values += [-v for v in values[:500]] + [12.5, 1e-9, 0.0, 99999.99995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.x for r in df.select(half_even(F.col("v"), digits).alias("x")).collect()]
    assert got == [round(v, digits) for v in values]


def test_rounding_keeps_what_is_not_finite(spark):
    df = spark.createDataFrame([(NAN,), (math.inf,), (None,)], "v double")
    got = [r.x for r in df.select(half_even(F.col("v"), 4).alias("x")).collect()]
    assert math.isnan(got[0]) and got[1:] == [math.inf, None]
    assert [r.x for r in df.select(sanitize_score(F.col("v")).alias("x")).collect()] == [None, None, None]


def python_metrics(pairs, t):
    tp = sum(1 for y, s in pairs if s >= t and y == 1)
    fp = sum(1 for y, s in pairs if s >= t and y == 0)
    fn = sum(1 for y, s in pairs if not s >= t and y == 1)
    tn = len(pairs) - tp - fp - fn
    ratio = lambda a, b: round(a / b, 4) if b else 0.0
    return [[tn, fp], [fn, tp]], ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn), ratio(tp + tn, len(pairs))


def test_sweep_like_python(spark):
    rng = random.Random(3)
    pairs = [(rng.random() < 0.3, rng.choice([0.3, 0.5, 0.8, NAN, rng.random()])) for _ in range(500)]
    pairs = [(int(y), s) for y, s in pairs]
    for row in e.threshold_sweep(frame(spark, [("d", "x", y, s) for y, s in pairs])).collect():
        got = (row.confusion_matrix, row.precision, row.recall, row.f1, row.accuracy)
        assert got == python_metrics(pairs, row.threshold)


def test_undefined_metrics_are_zero(spark):
    row = e.metrics_at_threshold(frame(spark, [("d", "x", 0, 0.1), ("d", "x", 0, None)]), 0.5).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0.0, 0.0, 0.0, 1.0)
    assert row.confusion_matrix == [[2, 0], [0, 0]]


def test_first_threshold_wins_a_tie(spark):
    sweep = e.threshold_sweep(frame(spark, [("d", "x", 1, 0.9), ("d", "x", 0, 0.1)]), thresholds=(0.7, 0.3, 0.5))
    assert e.best_threshold(sweep).first().threshold == 0.7


def test_tie_is_judged_on_rounded_f1(spark):
    # F1 differs in the fifth decimal only; the first in the list wins although the second is greater.
    rows = [("d", "x", 1, 0.9)] * 30000 + [("d", "x", 1, 0.4)] + [("d", "x", 0, 0.1)]
    sweep = e.threshold_sweep(frame(spark, rows), thresholds=(0.5, 0.3))
    assert e.best_threshold(sweep).first().threshold == 0.5


def test_breakdown(spark):
    rows = [("d", "jailbreak", 1, 0.9), ("d", "jailbreak", 1, 0.2), ("d", "benign", 0, 0.1), ("d", "benign", 0, 0.75)]
    got = {r.attack_type: r for r in e.attack_type_breakdown(frame(spark, rows), thresholds=(0.5, 0.8)).collect()}
    assert (got["jailbreak"].threshold, got["jailbreak"].n) == (0.8, 2)
    assert (got["jailbreak"].recall, got["jailbreak"].precision, got["jailbreak"].f1) == (0.5, 1.0, 0.6667)
    assert (got["benign"].f1, got["benign"].precision, got["benign"].recall) == (0.0, 0.0, 0.0)


def test_report_is_nested_json(spark, tmp_path):
    rows = [("d1", "jailbreak", 1, 0.9), ("d1", "benign", 0, 0.1), ("d2", "benign", 0, 0.6)]
    scored = frame(spark, rows)
    report = evaluate_scorer(scored.withColumn("text", F.lit("t")), lambda df: df.withColumn("injection_score", F.col("score")))
    write_report(report, str(tmp_path / "report"))
    lines = [json.loads(line) for p in (tmp_path / "report").glob("*.json") for line in p.read_text().splitlines()]
    by_name = {r["dataset"]: r for r in lines}
    assert by_name["d1"]["n_samples"] == 2 and len(by_name["d1"]["thresholds"]) == 6
    assert by_name["d1"]["thresholds"][0]["threshold"] == 0.3
    assert by_name["d1"]["attack_type_breakdown"]["jailbreak"]["f1"] == 1.0
    assert "attack_type_breakdown" not in e.evaluation_report(scored.drop("attack_type")).columns


def test_argmax_tie_goes_to_benign(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.1, 0.9)], "label int, p0 double, p1 double")
    row = e.argmax_metrics(df).first()
    assert (row.recall, row.precision, row.accuracy) == (0.5, 1.0, 0.5) and row.f1 == 2 / 3


def test_stats_of_an_empty_log(spark):
    log = spark.createDataFrame([], "decision string, stage int, latency_ms double")
    row = decision_stats(log).first()
    assert (row.total_requests, row.average_latency_ms) == (0, 0.0)
    assert row.stage_distribution == {"stage_1": 0, "stage_2": 0, "stage_3": 0}


def test_stats(spark):
    log = spark.createDataFrame([("BLOCKED", 1, 1.0), ("ALLOWED", 2, 2.0), ("REVIEW", 2, 3.0005), ("OTHER", 3, 1.0)],
                                "decision string, stage int, latency_ms double")
    row = decision_stats(log).first()
    assert (row.blocked_count, row.allowed_count, row.review_count) == (1, 1, 2)
    assert row.average_latency_ms == round(7.0005 / 4, 3)
    assert e.label_distribution(log.select(F.lit(1).alias("label"))).first().n == 4


def test_large_values_are_rounded(spark):
    values = [2000000000.1234567, 1e9 + 0.00005, 123456789012.34565, 4e15 + 0.3, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.x for r in df.select(half_even(F.col("v"), 4).alias("x")).collect()] == [round(v, 4) for v in values]


def test_report_without_attack_types_and_with_a_missing_one(spark):
    from wardline.operators import evaluation as ev

    df = spark.createDataFrame([("d", 1, 0.9, None), ("d", 0, 0.1, "benign")], "dataset string, label int, score double, attack_type string")
    assert set(ev.evaluation_report(df).first().attack_type_breakdown) == {"unknown", "benign"}
    assert "attack_type_breakdown" not in ev.evaluation_report(df.drop("attack_type")).columns
