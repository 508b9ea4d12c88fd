"""Phrase mining against plain counting, from good samples, bad ones and none."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import awkward

from wardline.llm import collocations as co


def pieces_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute_counts(rows, longest=4):
    """Counter of (lang, words of the phrase); the empty phrase counts words."""
    out = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        out[lang, ()] += 0
        for words in pieces_of(text):
            out[lang, ()] += len(words)
            out.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return out


def brute(rows, minimum=30, top=2000):
    """(lang, rank, phrase, a, l, r, n, score)."""
    f = brute_counts(rows)
    found = {}
    for (lang, words), a in f.items():
        if len(words) > 1 and a >= minimum:
            score, cut = min((2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
            found[lang, words] = (-score, -a, " ".join(words).encode(), f[lang, words[:cut]], f[lang, words[cut:]])
    kept = {}
    for (lang, words), row in found.items():
        inside = lambda longer: any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
        if not any(g == lang and len(v) > len(words) and inside(v) and 100 * f[g, v] >= 80 * f[lang, words] for g, v in found):
            kept.setdefault(lang, []).append(row)
    return sorted((lang, k + 1, p.decode(), -a, l, r, f[lang, ()], -s)
                  for lang, some in kept.items() for k, (s, a, p, l, r) in enumerate(sorted(some)[:top]))


def made_up(n, seed=1):
    random.seed(seed)
    words = ["a", "B", "the", "Of", "to\x1cgo", "é", "É", "x\xa0y", "in", "New", "york", "city", "中"]
    ends = [" ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "\x0b", "\x0c", "\r\n", "; "]
    def text():
        return "".join(random.choice(words[: random.randint(3, 13)]) + random.choice(ends) for _ in range(random.randint(0, 60))) + "New York city hall"
    return [(text(), random.choice(["en", "en", "de", None])) for _ in range(n)] + [(t, lang) for _, t, lang in awkward()]


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, "p", 2.0) for k, (t, lang) in enumerate(rows)],
                                 "doc_id long, text string, lang string, n int, phrase string, words double").repartition(3)


def counts_of(frequent):
    rows = frequent.collect()
    got = {(r.lang, tuple(r.phrase.split(" ")) if r.words else ()): r.n for r in rows}
    assert len(got) == len(rows)  # no phrase is counted twice
    assert all(len(key[1]) == r.words for key, r in zip(got, rows))
    return got


@pytest.mark.parametrize("percent,sample_minimum", [(0, 1), (100, 1), (100, 40), (10, 1), (30, 3), (50, 9)])
def test_frequent_phrases_whatever_the_sample_says(spark, percent, sample_minimum):
    rows = made_up(120)
    got = counts_of(co.frequent_phrases(table(spark, rows), 12, 4, percent, sample_minimum))
    assert got == {key: n for key, n in brute_counts(rows).items() if n >= 12 or not key[1]}


def test_a_full_filter_only_costs_time(spark, monkeypatch):
    rows = made_up(60, 2)
    full = co.Proposals(np.full(1 << 10, (1 << 64) - 1, np.uint64))
    docs = table(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    frequent, _ = co.mine(docs, 9, 4, full)
    assert counts_of(frequent) == {key: n for key, n in brute_counts(rows).items() if n >= 9 or not key[1]}


def test_failures_of_the_border_start_further_passes(spark, monkeypatch):
    rows = made_up(60, 3)
    passes = []
    one = co.count_pass
    monkeypatch.setattr(co, "count_pass", lambda docs, before, *more: passes.append(before is None) or one(docs, before, *more))
    docs = table(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    _, enough = co.mine(docs, 9, 4)
    assert passes == [True, False, False, False]
    co.mine(docs, 9, 4, enough)
    assert passes[4:] == [True]


def test_filters_forget_nothing_when_they_grow(spark, monkeypatch):
    monkeypatch.setattr(co, "BITS_EACH", 4000)
    def phrases(name, n):
        return spark.createDataFrame([("en", f"{name} {k} é") for k in range(n)], "lang string, phrase string")
    small = co.proposed(phrases("a", 10))
    large = co.proposed(phrases("b", 200), small)
    assert len(large.bitmap) > len(small.bitmap) >= len(co.NONE.bitmap) and large.size == 210
    assert co._not_proposed(phrases("a", 10), large).count() == 0 and co._not_proposed(phrases("b", 200), large).count() == 0
    assert co._not_proposed(phrases("c", 500), large).count() > 490


@pytest.mark.parametrize("chunk", [8 << 20, 200])
def test_collocations_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(co, "CHUNK_BYTES", chunk)
    rows = made_up(100, 4)
    got = sorted(tuple(r) for r in co.collocations(co.frequent_phrases(table(spark, rows), 10), top=25).collect())
    want = brute(rows, 10, 25)
    assert got == want and len(want) > 20


def test_products_beyond_64_bits(spark):
    big = 3 * 10**18
    rows = [("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)]
    got = co.collocations(spark.createDataFrame(rows, co.COUNTED)).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big - 2, big, big - 1, big, 2000000 * (big - 2) // (2 * big - 1))]


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(co, "CHUNK_BYTES", 50)
    text = ("one two three. " * 30 + "no end here " * 20).encode()
    parts = list(co._fragments(text))
    assert b"".join(parts) == text and len(parts) > 8
    assert [w for p in parts for w in pieces_of(p.decode()) if w] == [w for w in pieces_of(text.decode()) if w]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert co.collocations(co.frequent_phrases(docs)).collect() == []
    one = spark.createDataFrame([(None, None, None)], docs.schema)
    assert co.collocations(co.frequent_phrases(one)).collect() == []
