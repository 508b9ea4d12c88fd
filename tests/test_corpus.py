import pytest
from pyspark.sql import functions as F

from wardline.functions.text import WHITESPACE, strip_text, token_set
from wardline.operators import corpus as c
from wardline.sources import readers, writers

SPECS = {s.name: s for s in (*c.TRAINING_SOURCES, c.EVAL_SOURCE)}
TEXTS = ["  a b  ", "\xa0　x\x85", "\x1cmid dle\x1f", "", " \t\n", "ÀB àb ÀB", "tab\tsep\x1cx y", "﻿keep"]


def rows_of(df):
    return [tuple(r) for r in c.to_schema(df).collect()]


def test_strip_and_tokens_like_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = df.select(strip_text("text").alias("s"), token_set("text").alias("t")).collect()
    assert [r.s for r in got] == [t.strip() for t in TEXTS]
    assert [set(r.t) for r in got] == [set(t.lower().split()) for t in TEXTS]
    assert all(ch.isspace() for ch in WHITESPACE)


def test_nested_conversation(spark):
    turns = [("user", "  hello there "), ("assistant", "an answer"), ("user", "hey"), ("user", None)]
    df = spark.createDataFrame(
        [(1, turns, False), (2, turns, True), (3, [("user", "unflagged")], None)],
        "row_id long, conversation array<struct<role:string,content:string>>, toxic boolean",
    )
    got = c.normalise(df, SPECS["wildchat"], 0)
    assert rows_of(got) == [("hello there", 0, "wildchat", "benign"), ("unflagged", 0, "wildchat", "benign")]
    keys = [r.row_key for r in got.collect()]
    assert keys == sorted(keys) and keys[0].endswith("-000000")


def test_role_filter(spark):
    df = spark.createDataFrame([(1, "prompter", "what is it"), (2, "assistant", "this it is")], "row_id long, role string, text string")
    assert rows_of(c.normalise(df, SPECS["oasst1"], 1)) == [("what is it", 0, "oasst1", "benign")]


def test_native_text_labels_differ_between_sources(spark):
    words = ["Injection", " injection", "injected", "ATTACK", "benign"]
    df = spark.createDataFrame([(i, f"text {i}", w) for i, w in enumerate(words)], "row_id long, prompt string, label string")
    train = [r[1] for r in rows_of(c.normalise(df, SPECS["neuralchemy"], 2))]
    held = [r[1] for r in rows_of(c.normalise(df, SPECS["rogue_benchmark"], 0))]
    assert train == [1, 0, 1, 1, 0] and held == [1, 0, 0, 1, 0]


def test_numeric_labels_are_cut_off_and_nulls_rejected(spark):
    df = spark.createDataFrame([(i, f"text {i}", v) for i, v in enumerate([1.7, 0.2, -0.5, 3.0, None])], "row_id long, text string, label double")
    labelled, rejected = c.reject_unlabelled(c.normalise(df, SPECS["neuralchemy"], 2))
    assert [r[1] for r in rows_of(labelled)] == [1, 0, 0, 3] and rejected.count() == 1


def test_missing_label_column(spark):
    df = spark.createDataFrame([(1, "some text")], "row_id long, prompt string")
    assert rows_of(c.normalise(df, SPECS["neuralchemy"], 2))[0][1:] == (0, "neuralchemy", "benign")
    assert rows_of(c.normalise(df, SPECS["rogue_benchmark"], 0))[0][1:] == (1, "rogue_benchmark", "unknown")


def test_split_labels(spark):
    df = spark.createDataFrame([(1, "text one", "Hijacking_ATTACKS"), (2, "text two", "defenses")], "row_id long, attack string, split string")
    assert [r[1:] for r in rows_of(c.normalise(df, SPECS["tensor_trust"], 4))] == [
        (1, "tensor_trust", "direct_override"), (0, "tensor_trust", "benign")]


@pytest.mark.parametrize("columns,expected", [
    (["text", "label"], ("text", "label")),
    (["id", "Input_x", "my_prompt", "klass", "target"], ("Input_x", "target")),
    (["id", "body"], ("id", None)),
])
def test_column_discovery(spark, columns, expected):
    df = spark.createDataFrame([], ", ".join(f"{x} string" for x in columns))
    assert c.resolve_columns(df, SPECS["neuralchemy"]) == expected


def test_short_and_null_texts_are_dropped(spark):
    df = spark.createDataFrame([(1, None), (2, " abcd "), (3, "abcde"), (4, "\U0001F600" * 5)], "row_id long, prompt string")
    assert [r[0] for r in rows_of(c.normalise(df, SPECS["advbench"], 3))] == ["abcde", "\U0001F600" * 5]


def test_guard_stops_the_job_whatever_is_read(spark):
    df = spark.createDataFrame([("t", 0, "Rogue_x", "benign")], "text string, label int, source string, attack_type string")
    with pytest.raises(Exception, match="evaluation-only source"):
        c.eval_only_guard(df).select("label").count()
    assert c.eval_only_guard(df.withColumn("source", F.lit("fine"))).count() == 1


def test_order_of_sources_and_absent_ones(spark):
    df = spark.createDataFrame([(7, "some text")], "row_id long, prompt string")
    union = c.union_sources({"advbench": df, "neuralchemy": df, "rogue_benchmark": df})
    assert [r.source for r in union.orderBy("row_key").collect()] == ["neuralchemy", "advbench"]
    with pytest.raises(ValueError):
        c.union_sources({})


def test_registry_skips_missing_paths(spark, tmp_path):
    spark.createDataFrame([(1, "some text")], "row_id long, prompt string").write.parquet(str(tmp_path / "a"))
    paths = {"advbench": {"train": str(tmp_path / "a")}, "oasst1": {"train": str(tmp_path / "none")}}
    assert readers.source_registry(spark, paths).count() == 1
    assert readers.read_splits(spark, {"x": str(tmp_path / "none")}) is None


def test_corpus_files(spark, tmp_path):
    df = spark.createDataFrame([("a text", 1, "s", "jailbreak", "train"), ("b text", 0, "s", "benign", "eval")],
                               "text string, label int, source string, attack_type string, part string")
    paths = writers.write_corpus(df, df.where("false"), str(tmp_path / "out"))
    assert set(paths) == {"train", "eval"}
    assert readers.read_training_columns(spark, paths["train"]).columns == ["text", "label"]
    got = readers.read_eval_sets(spark, {"eval": paths["eval"], "benchmark": str(tmp_path / "none")})
    assert [(r.text, r.dataset) for r in got.collect()] == [("b text", "internal_eval")]
    with pytest.raises(FileNotFoundError):
        readers.read_eval_sets(spark, {"eval": paths["eval"]}, choice="benchmark")


def test_row_keys_tell_all_rows_apart(spark):
    import random
    import uuid

    from wardline.functions.text import row_key

    rng = random.Random(8)
    signs = ["", "0", "00", "7", "a", "z", "~", "~0", "~1", "-", "-1", "a0", "b12", "z~0", " ", "\t", "é", "\U0001f600"]
    parts = [*signs, "007", "a-0", "0-000000", "1e3", "7.0", str(10**24), str(10**25), "9" * 400, *(str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(50)),
             *("".join(rng.choices(signs, k=rng.randrange(1, 5))) for _ in range(400)), *(str(n) for n in range(0, 3000, 7))]
    rows = [(rng.choice(signs), p, rng.choice(signs)) for p in parts for _ in range(4)] + [(a, b, c) for a in signs for b in signs for c in signs]
    distinct = sorted(set(rows))
    df = spark.createDataFrame(distinct, "rank string, id string, turn string")
    keys = [r.k for r in df.select(row_key(F.col("rank"), F.col("id"), F.col("turn")).alias("k")).collect()]
    assert len(set(keys)) == len(distinct) > 5000


def test_row_keys_of_numbers_sort_as_numbers(spark):
    from wardline.functions.text import row_key

    numbers = [0, 1, 7, 9, 10, 70, 99, 100, 12_345, 2**31, 2**63 - 1]
    rows = [(r, i, t) for r in (0, 5, 99, 100) for i in numbers for t in (0, 3, 999_999, 1_234_567)]
    df = spark.createDataFrame(rows, "rank int, id long, turn long")
    keys = [r.k for r in df.select(row_key(F.col("rank"), F.col("id"), F.col("turn")).alias("k")).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(rows)
    assert spark.range(1).select(row_key(F.lit(2), F.lit(41)).alias("k")).first().k == "a2b41a0"
    assert spark.range(1).select(row_key(F.lit(2), F.lit("041")).alias("k")).first().k == "a2z041~0a0"


def test_a_row_without_an_id_ends_the_job(spark):
    from wardline.functions.text import row_key

    df = spark.createDataFrame([(None,)], "id string")
    with pytest.raises(Exception, match="without an id"):
        df.select(row_key(F.lit(1), F.col("id")).alias("k")).collect()


def test_missing_evaluation_sets_and_unknown_sources_are_named(spark, tmp_path, caplog):
    path = str(tmp_path / "eval")
    spark.createDataFrame([("a", 1)], "text string, label int").write.parquet(path)
    with caplog.at_level("WARNING"):
        assert readers.read_eval_sets(spark, {"eval": path, "benchmark": str(tmp_path / "none")}).count() == 1
    assert [str(tmp_path / "none") in r.getMessage() for r in caplog.records if "evaluation set" in r.getMessage()] == [True]
    with pytest.raises(ValueError, match="nobody"):
        readers.source_registry(spark, {"nobody": {"train": path}})
