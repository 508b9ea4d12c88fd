"""The pipeline's stages: what they keep, and the same rows as stage-wise brute force gives."""

import os

import pytest

import corpus_pipeline
from wardline.llm import quality
from wardline.workdir import written

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def test_stages(spark):
    from test_operators import brute_components, brute_print, brute_spans

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), "test-stage")
        kept[name] = docs
        if name != "byte_bpe":
            assert docs.columns == columns
    table = {name: {r.doc_id: r for r in df.collect()} for name, df in kept.items()}
    given = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}

    model = quality.learn(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = quality.score(spark.read.parquet(f"{FOLDER}/documents.parquet"), model).where("predicted = 1")
    assert set(table["quality"]) == {r.doc_id for r in good.collect()} and len(table["quality"]) < len(given)

    ids = sorted(table["quality"])
    names = brute_components([brute_print(given[i].text) for i in ids], ids)
    assert set(table["near_duplicates"]) == {i for i, name in zip(ids, names) if i == name}

    left = sorted(table["near_duplicates"])
    for i, _, removed, _, text in brute_spans([(i, given[i].text.encode()) for i in left], 200):
        row = table["repeated_strings"][i]
        assert row.text == text.decode(errors="ignore") or removed  # characters that are cut go whole
        assert row.n_chars == len(row.text) and len(row.text.encode()) <= len(text)

    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = {i for i, r in table["repeated_strings"].items() if any(item in r.text for item in items)}
    assert dirty <= set(table["repeated_strings"]) - set(table["decontamination"])
    assert set(table["byte_bpe"]) == set(table["decontamination"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, table["byte_bpe"].values()))


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "one two three four five six", "en"), (1, "one two three four five six", "en"), (None, "seven", "en"), (2, "one two three four five six", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([rows[0], rows[2]], key=repr)


A, B = "one two three four five six", "completely other words stand in this text, and many more of them than there"


@pytest.mark.parametrize("given,left", [
    ([(3, A), (5, A), (5, B)], [(3, A), (5, B)]),
    ([(1, A), (1, B)], [(1, A), (1, B)]),
    ([(None, A), (None, A), (5, A)], [(5, A)]),
    ([(None, A), (None, A), (None, B)], [(None, A), (None, B)]),
    ([(2, B), (2, A), (2, A), (2, B), (1, None), (0, "")], [(2, B), (2, A), (0, "")]),
    ([], []),
], ids=["id of two groups", "id of two texts", "copies without id", "no ids", "repeated rows", "empty"])
def test_a_text_goes_only_for_one_of_its_own_group(spark, given, left):
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(given)], "doc_id long, text string, identity string, row int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(left, key=repr)
