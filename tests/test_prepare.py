import pytest

from wardline.operators.dedup import near_dedup
from wardline.plans.prepare import PrepareOptions, deduplicated, prepare_and_write, prepare_corpus, rejected
from wardline.workdir import discard_written, join_heavy_split, shared_dir, written


def rows(spark):
    text = "the benign text about topic{0} and thing{0} or other{0} stuff{0}"
    data = [(f"{i:04d}", text.format(i // 2), 0, "a", "benign") for i in range(80)]
    data += [(f"{100 + i:04d}", f"attack number{i} with word{i} and more{i} plus again{i}", 1, "b", "jailbreak") for i in range(5)]
    return spark.createDataFrame(data, "row_key string, text string, label int, source string, attack_type string")


def test_whole_preparation(spark):
    out = prepare_corpus(rows(spark)).collect()
    assert sum(r.label for r in out) == 5
    assert sum(1 for r in out if r.label == 0) == int(5 * 0.8 / (1 - 0.8))
    assert all(int(r.row_key) % 2 == 0 for r in out if r.label == 0)  # of every pair of copies the first
    assert sum(1 for r in out if r.part == "eval") == 4


@pytest.mark.parametrize("mode,count", [("off", 85), ("exact", 45), ("minhash", 45)])
def test_dedup_modes(spark, mode, count):
    assert deduplicated(rows(spark), PrepareOptions(dedup=mode)).count() == count


def test_evaluation_only_rows_stop_the_preparation(spark):
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="evaluation-only"):
        prepare_corpus(rows(spark).withColumn("source", F.lit("ROGUE_set")))


def test_whole_job_leaves_no_work_tables(spark, tmp_path):
    import os

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    paths = prepare_and_write(rows(spark), None, str(tmp_path / "corpus"))
    assert spark.read.parquet(paths["train"]).count() + spark.read.parquet(paths["eval"]).count() == 25
    assert set(os.listdir(folder)) <= before


def test_rows_without_a_label_are_left_out(spark):
    from pyspark.sql import functions as F

    some = rows(spark).withColumn("label", F.when(F.col("row_key") != "0100", F.col("label")))
    assert {r.row_key for r in rejected(some).collect()} == {"0100"}
    assert "0100" not in {r.row_key for r in prepare_corpus(some).collect()}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_result_does_not_depend_on_partitioning(spark):
    keys = [sorted(r.row_key for r in near_dedup(rows(spark).repartition(n)).collect()) for n in (1, 7)]
    assert keys[0] == keys[1]


def test_work_tables_can_be_discarded(spark):
    import os

    table = written(rows(spark), "something")
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    discard_written(spark)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_heavy_keys_are_joined_apart(spark, monkeypatch, how):
    from pyspark.sql import functions as F

    import wardline.workdir as w

    monkeypatch.setattr(w, "HEAVY_ROWS", 50)
    big = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    small = written(big.where("k != 5").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("v")), "small")
    split = join_heavy_split(big, small, "k", "n", how)
    plain = big.join(small.drop("n"), "k", how)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.select(split.columns).collect()))
