import hashlib
import math

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from wardline.operators import sampling as s


def frame(spark, labels, partitions=None):
    df = spark.createDataFrame([(f"r{i:05d}", v) for i, v in enumerate(labels)], "row_key string, label int")
    return df.repartition(partitions) if partitions else df


def drawn(keys, k, purpose="sample", seed=42):
    return sorted(sorted(keys, key=lambda r: hashlib.md5(f"{seed}|{purpose}|{r}".encode()).hexdigest())[:k])


def keys(df):
    return sorted(r.row_key for r in df.collect())


@pytest.mark.parametrize("k", [0, 1, 7, 250, 499, 500, 900])
def test_sample_is_exactly_the_smallest_keys(spark, k):
    df = frame(spark, [0] * 500)
    assert keys(s.sample_k(df, k)) == drawn(keys(df), k)


def test_draw_does_not_depend_on_partitioning(spark):
    labels = [i % 3 for i in range(300)]
    results = [keys(s.stratified_split(frame(spark, labels, n)).where("part = 'eval'")) for n in (1, 7)]
    assert results[0] == results[1]


def test_other_seed_other_rows(spark):
    df = frame(spark, [0] * 200)
    assert keys(s.sample_k(df, 20, seed=1)) != keys(s.sample_k(df, 20, seed=2))


def test_balance(spark):
    df = frame(spark, [0] * 300 + [1] * 20 + [2] * 5)
    out = s.balance_classes(df)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: int(20 * 0.8 / (1 - 0.8)), 1: 20}
    benign = [f"r{i:05d}" for i in range(300)]
    assert keys(out.where("label = 0")) == drawn(benign, counts[0], "balance")


def test_balance_never_adds_rows_and_needs_positives(spark):
    assert s.balance_classes(frame(spark, [0] * 30 + [1] * 20)).count() == 50
    assert s.balance_classes(frame(spark, [0] * 30 + [2] * 5)).count() == 35


@pytest.mark.parametrize("n,positives", [(100, 20), (1000, 333), (7, 3), (40, 20), (101, 50)])
def test_split_sizes(spark, n, positives):
    rows = s.stratified_split(frame(spark, [1] * positives + [0] * (n - positives)))
    got = {(r.part, r.label): r["count"] for r in rows.groupBy("part", "label").count().collect()}
    held = math.ceil((1 - 0.85) * n)
    train = n - held
    shares = {1: positives / n * train, 0: (n - positives) / n * train}
    whole = {k: math.floor(v) for k, v in shares.items()}
    for label in sorted(shares, key=lambda k: (-(shares[k] - whole[k]), k))[: train - sum(whole.values())]:
        whole[label] += 1
    assert sum(v for (p, _), v in got.items() if p == "eval") == held
    assert {k: got.get(("train", k), 0) for k in shares} == whole


def test_the_draw_is_a_filter(spark):
    """Rows are neither sorted nor shuffled by the draw: at most the small table of limits is broadcast."""
    df = frame(spark, [i % 2 for i in range(50)])
    for drawn_rows, join in ((s.sample_k(df, 10), False), (s.stratified_split(df), True)):
        plan = plan_of(drawn_rows)
        assert "Sort" not in plan and "Exchange hashpartitioning" not in plan
        assert ("BroadcastHashJoin" in plan) is join and "NestedLoop" not in plan


def test_cap(spark):
    df = frame(spark, [0] * 20)
    assert s.cap_training_rows(df, None).count() == 20 and s.cap_training_rows(df, 5).count() == 5


def test_shuffle_is_a_seeded_permutation(spark):
    df = frame(spark, [0] * 50)
    order = [r.row_key for r in s.shuffle_rows(df).collect()]
    assert order == [r.row_key for r in s.shuffle_rows(df.repartition(3)).collect()]
    assert sorted(order) == keys(df) and order != keys(df)
    assert s.union_classes(df, df.select(F.col("label"), F.col("row_key"))).count() == 100


def test_rows_without_a_label_are_a_class_of_their_own(spark):
    rows = [(f"r{i:05d}", None if i % 4 == 0 else i % 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_key string, label int")
    split = {(r.label, r.part): r["count"] for r in s.stratified_split(df).groupBy("label", "part").count().collect()}
    assert sum(n for (_, part), n in split.items() if part == "eval") == 151
    assert split[None, "eval"] in (37, 38) and split[1, "eval"] in (74, 75, 76)
    assert s.balance_classes(df.where("label is null or label = 0")).count() == 500
