"""Importance resampling against a row-by-row version, and its parts on awkward input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import awkward

from wardline.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def brute(rows, targets, percent=5, min_words=20):
    """(doc_id, n_features, weight, score, rank) of (id, text) rows, one after the other."""
    bucket = {}

    def buckets(text):
        return [bucket.setdefault(f, zlib.crc32(f.encode()) % 10000) for f in features(text)[1]]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets(text))
    for text in targets:
        t.update(buckets(text))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    scored = []
    for place, (doc_id, text) in enumerate(rows):
        found = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc_id, len(found), weight, score, features(text)[0] >= min_words, place))
    able = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[5]: k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(r[5])) for r in scored]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_crcs_of_slices():
    random.seed(2)
    data = bytes(random.randrange(256) for _ in range(5000))
    slices = [(a, random.choice([0, 1, 2, 7, 40, 1024, 1025, 3000])) for a in random.choices(range(2000), k=800)]
    starts, lengths = (np.array(x, np.int64) for x in zip(*slices))
    got = rs.crc_of_slices(np.frombuffer(data, np.uint8), starts, lengths)
    assert got.tolist() == [zlib.crc32(data[a : a + n]) for a, n in slices]


def test_matrices_are_cut_into_slabs(monkeypatch):
    monkeypatch.setattr(rs, "SLAB_BYTES", 30)
    data = np.arange(200, dtype=np.uint8)
    got = rs.crc_of_slices(data, np.arange(100), np.full(100, 9))
    assert got.tolist() == [zlib.crc32(bytes(range(k, k + 9))) for k in range(100)]


def test_features_of_texts():
    random.seed(4)
    letters = ["a", "B", "c9", " ", "  ", ".", "\n", "é", "É", "Z-", "_", "\x7f", "\0", "中", "x" * 700]
    texts = ["".join(random.choices(letters, k=random.randint(0, 25))) for _ in range(500)] + ["", "one", "one two"]
    found = rs.Features([t.encode() for t in texts])
    for k, text in enumerate(texts):
        n_words, own = features(text)
        assert found.words[k] == n_words and found.n[k] == len(own)
        assert Counter(found.bucket[found.text == k].tolist()) == Counter(zlib.crc32(f.encode()) % 10000 for f in own)


@pytest.mark.parametrize("percent,min_words", [(5, 20), (40, 0), (100, 3)])
def test_resampling_against_brute_force(spark, percent, min_words):
    rows = [(i, t) for i, t, _ in awkward()] + [(100 + i, " ".join(f"w{(i * k) % 17}" for k in range(15 + i))) for i in range(30)]
    docs = spark.createDataFrame([(*r, 1, 2.0, "w") for r in rows], "doc_id long, text string, rank int, weight double, bucket string")
    targets = ["W1 w2, w3 w4", None, "", "the quick brown fox"]
    target = spark.createDataFrame([(t, 3) for t in targets], "text string, n int")
    got = rs.resample(docs, target, percent, min_words).collect()
    want = brute(rows, targets, percent, min_words)
    # Rows equal in id and score take their places in any order.
    assert in_order(r[:4] for r in got) == in_order(r[:4] for r in want)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 1 + sum(r[4] is not None for r in want)))
    unique = {r[0] for r in want if sum(r[0] == q[0] for q in want) == 1}
    assert in_order(r for r in got if r.doc_id in unique) == in_order(r for r in want if r[0] in unique)


def test_ranks_run_through_all_ranges(spark):
    rows = [(i % 50 or None, (i * 7) % 13) for i in range(2000)]
    scored = spark.createDataFrame(rows, "doc_id long, score long").repartition(7)
    got = rs.ranked(rs.written(scored, "test-scores"), range_rows=100).collect()
    by_rank = [(r.score, r.doc_id) for r in sorted(got, key=lambda r: r["rank"])]
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 2001))
    assert by_rank == sorted(((s, i) for i, s in rows), key=lambda r: (-r[0], r[1] is None, r[1] or 0))


def test_equal_rows_are_ranked_in_several_ranges(spark):
    scored = rs.written(spark.range(0, 3000, 1, 4).selectExpr("cast(null as long) as doc_id", "5L as score"), "test-equal")
    dealt = rs.ranked(scored, range_rows=300)
    assert sorted(r["rank"] for r in dealt.collect()) == list(range(1, 3001))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    assert rs.resample(docs, target).collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in rs.resample(one, target, 100, 1).collect()] == brute([(1, "a b c")], [], 100, 1)


def test_the_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    targets = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert in_order(rs.op12_importance_resampling(spark, folder).collect()) == in_order(brute(rows, targets))
