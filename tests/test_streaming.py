import json
import os

from pyspark.sql import functions as F

from wardline.operators.gate import gate
from wardline.operators.stats import decision_stats
from wardline.sources.readers import read_decision_log
from wardline.sources.writers import write_decision_log
from wardline.streaming import decisions as d

TEXTS = ["do anything now", "a calm text", "another calm text", "é" * 200]


def requests(spark, folder, start=0):
    rows = [(start + i, t, (i * 37 % 100) / 100.0, float(i)) for i, t in enumerate(TEXTS * 5)]
    df = spark.createDataFrame(rows, "id int, text string, s double, latency_ms double")
    df.write.mode("append").parquet(folder)
    return df


def stream(spark, folder, schema):
    return d.gate_stream(spark.readStream.schema(schema).parquet(folder), scorer="s")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    folder, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    first = requests(spark, folder)
    d.decision_log_stream(stream(spark, folder, first.schema), log, state, once=True).awaitTermination()
    assert read_decision_log(spark, log).count() == 20
    second = requests(spark, folder, start=100)
    d.decision_log_stream(stream(spark, folder, first.schema), log, state, once=True).awaitTermination()
    columns = ["text_preview", "decision", "stage", "score", "pattern"]
    got = sorted(map(str, read_decision_log(spark, log).select(columns).collect()))
    batch = gate(first.unionByName(second), scorer="s").withColumn("text_preview", F.substring("text", 1, 120))
    assert got == sorted(map(str, batch.select(columns).collect()))


def test_counters_survive_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = requests(spark, folder)
    for start in (100, None):
        d.running_stats_stream(stream(spark, folder, first.schema), out, state, once=True).awaitTermination()
        if start:
            requests(spark, folder, start)
    counts = d.read_running_counts(spark, out)
    totals = d.stats_from_counts(counts).first()
    batch = decision_stats(gate(spark.read.parquet(folder), scorer="s")).first()
    assert totals.total_requests == batch.total_requests == 40
    assert (totals.blocked_count, totals.allowed_count, totals.review_count) == (
        batch.blocked_count, batch.allowed_count, batch.review_count)
    assert totals.stage_distribution == batch.stage_distribution
    assert totals.average_latency_ms == batch.average_latency_ms
    assert counts.agg(F.sum("latency_sum") / F.sum("latency_count")).first()[0] == batch.average_latency_ms


def test_a_reader_finds_whole_counters_while_batches_go_by(spark, tmp_path):
    import glob

    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = requests(spark, str(tmp_path / "first"))
    for k in range(15):
        rows.limit(4).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = d.running_stats_stream(gate(arriving, scorer="s"), out, state, once=True)
    seen = []
    while query.isActive:
        if glob.glob(f"{out}/batch=*/{d.FINISHED}"):
            seen.append(d.stats_from_counts(d.read_running_counts(spark, out)).first().total_requests)
    query.awaitTermination()
    seen.append(d.stats_from_counts(d.read_running_counts(spark, out)).first().total_requests)
    assert seen == sorted(seen) and seen[-1] == 60 and len(set(seen)) > 3
    assert sum(name.startswith("batch=") for name in os.listdir(out)) == d.KEPT_BATCHES


def test_a_table_without_its_mark_is_not_read(spark, tmp_path):
    import pytest

    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        d.read_running_counts(spark, out)
    for number in (9, 10, 11):
        spark.range(1).selectExpr(f"{number}L as n").write.parquet(f"{out}/batch={number}")
        if number < 11:
            (tmp_path / "out" / f"batch={number}" / d.FINISHED).touch()
    assert [r.n for r in d.read_running_counts(spark, out).collect()] == [10]


def test_log_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("x" * 200, float("nan")), ("[INST]", 0.1)]
    decided = gate(spark.createDataFrame(rows, "text string, s double"), scorer="s")
    assert write_decision_log(decided, path) and write_decision_log(decided, path)
    lines = [json.loads(line) for p in (tmp_path / "log").glob("*.json") for line in p.read_text().splitlines()]
    assert len(lines) == 4
    assert set(lines[0]) == {"timestamp", "text_preview", "decision", "stage", "score", "pattern", "latency_ms"}
    assert max(len(r["text_preview"]) for r in lines) == 120
    assert all(r["timestamp"].endswith("Z") for r in lines) and all(r["score"] is None for r in lines)


def test_failing_log_does_not_fail_the_job(spark, tmp_path):
    (tmp_path / "file").write_text("not a folder")
    decided = gate(spark.createDataFrame([("a text",)], "text string"))
    assert write_decision_log(decided, str(tmp_path / "file" / "log")) is False


def test_a_table_in_several_files_streams_as_one_file_does(spark, tmp_path):
    import pytest

    from wardline.catalog import stream_queries as q

    one = "/root/testdata/sf0.001"
    if not os.path.isdir(one):
        pytest.skip("test tables not present")
    turns = spark.read.parquet(f"{one}/conversations.parquet")
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    for run in (q.gate_stream, q.logged_stream, q.running_stats):
        got, expected = (sorted(map(str, run(spark, folder).collect())) for folder in (str(tmp_path), one))
        assert got == expected and got
