"""Every operator against a brute-force version, and on awkward rows."""

import base64
import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardline.llm import bpe, decontaminate, langid, lm_score, phrases, quality, rules, simhash, suffixes, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = (
    "the quick brown fox jumps over the lazy dog while many other animals look on in wonder and say nothing at all about it "
    "because they are quiet today and tomorrow and forever more so be it dear friend of mine who reads these lines now and then"
)
BIG = 9_007_199_254_740_993


def awkward():
    other = " ".join(f"word{i * 7 % 50}" for i in range(90))
    return [
        (1, BASE, "en"), (1, BASE, "en"), (2, BASE + " x", "en"), (None, BASE, None), (None, None, None), (3, "", "en"),
        (4, None, "fr"), (5, "  \n\t ", "de"), (6, "!!! 123", "de"), (BIG, BASE.upper(), "en"), (BIG + 1, BASE.upper(), "en"),
        (7, "x" * 3000 + " " + "é" * 100, "en"), (8, "ab " * 2000, "fr"), (9, other, "de"), (10, other + " " + BASE[:300], "de"),
        (11, other.replace("word3 ", "wird3 "), "de"), (12, "don't we'll 'S 's\r\n  you　're", "fr"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with nulls, empty and long texts, ties and repeats; other columns with names that operators use themselves."""
    names = "doc_id long, text string, lang string, block int, seed string, score double, packed string, spans int, print int, label int, id long"
    return spark.createDataFrame([(*r, 1, "c", 2.0, "t", 3, 4, 5, 6) for r in awkward()], names)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (5, 0, 0), (7, 0, None), (None, 1, 1), (4, None, None), (9, 1, 0), (1, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def rows_of(df, *columns):
    """Rows in an order that does not depend on nulls."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_bpe_equals_the_library(docs):
    import tiktoken

    ranks = bpe.read_ranks(docs.sparkSession, bpe.ranks_file())
    import public_tokenizers

    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    decoded = bpe.decode(bpe.encode(docs, bpe.ranks_file()), bpe.ranks_file())
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in decoded.collect()), key=repr)
    assert got == sorted(((i, whole.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in awkward()), key=repr)


def test_pre_tokens_equal_the_pattern():
    import random

    import public_tokenizers
    import regex

    random.seed(3)
    letters = " \n\t  '''sstrevemlld'aZ1²½é中!?.-_ 　́\x1c\x85"
    texts = ["".join(random.choices(letters, k=random.randint(0, 14))) for _ in range(20_000)] + ["a" * 300, "a" * 299, " " * 600, ""]
    counts, places, _, words = bpe.distinct_tokens([t.encode() for t in texts])
    words, at = words(), iter(places.tolist())
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert all([words[next(at)] for _ in range(n)] == pattern.findall(t) for t, n in zip(texts, counts.tolist()))


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "_token_hashes", lambda codes, starts, ends: __import__("numpy").array(
        [[7] * len(starts), (ends - starts).tolist()], "uint64"))
    counts, places, _, words = bpe.distinct_tokens([b"ab abc", b"abc"])
    assert [words()[i] for i in places] == ["ab", " abc", "abc"] and counts.tolist() == [2, 1]


def brute_spans(rows, length):
    count = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(t), sum(gone), sum(a and not b for a, b in zip(gone, [False, *gone])), bytes(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("crowd", [1, 2000])
def test_suffixes_against_brute_force(docs, crowd, monkeypatch):
    monkeypatch.setattr(suffixes.repeated_spans, "__defaults__", (200, "doc_id", "text", crowd))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_spans([(i, (t or "").encode()) for i, t, _ in awkward()], 200), key=repr)


def test_ranges_of_equal_rows_are_listed_once(spark):
    text = " ".join(f"word{i} of a long passage" for i in range(60))
    sizes = []
    for copies in (5, 20):
        rows = spark.createDataFrame([(None, text)] * copies + [(1, text[7:])], "doc_id long, text string")
        sizes.append({len(r.spans) for r in suffixes.repeated_spans(rows).collect() if r.doc_id is None})
    assert sizes[0] == sizes[1] and len(sizes[0]) == 1


def test_documents_without_repeats_keep_their_columns(docs):
    out = suffixes.without_repeats(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id in (4, 6, 7)}
    assert texts[4] is None and texts[6] == "!!! 123" and set(texts[7]) == {" ", "é"}


def brute_print(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, errors=4):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= errors:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    named = {x: min((i for i, y in zip(ids, label) if y == x and i is not None), default=None) for x in label}
    return [named[x] for x in label]


def test_simhash_against_brute_force(docs):
    rows = awkward()
    prints = [brute_print(t) for _, t, _ in rows]
    want = [(i, p, c) for (i, _, _), p, c in zip(rows, prints, brute_components(prints, [r[0] for r in rows]))]
    got = [(r.doc_id, r["print"] % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_trie_links_of_close_and_crowded_fingerprints(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    near = [c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for c in centres for a, b in rng.integers(0, 64, (15, 2))]
    values = np.unique(np.array([*centres, *near, *rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    i, j = simhash.trie_links(values, None, 4)
    close = np.bitwise_count(values[:, None] ^ values[None]) <= 4
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1)))))
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "print long").cache()
    groups = []
    for limit in (8, 4096):  # with the low limit most subtries are cut into parts
        edges = simhash.components(simhash.links(table, 4, limit))
        groups.append(sorted((r.node, r.label) for r in edges.collect()))
    assert groups[0] == groups[1] and groups[0]


def test_phrases_against_brute_force(docs):
    rows = [(i, WORD.findall(t or "")) for i, t, _ in awkward()]
    first = {}
    for i, words in rows:
        for k in range(len(words) - 12):
            if i is not None:
                window = tuple(words[k : k + 13])
                first[window] = min(first.get(window, i), i)
    want = []
    for i, words in rows:
        gone = [False] * len(words)
        for k in range(len(words) - 12):
            if i is not None and first[tuple(words[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g).encode()))
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in phrases.remove_phrases(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(w[2] for w in want)


def _phrases_by_force(rows):
    first, want = {}, []
    for i, text in rows:
        words = WORD.findall(text)
        for k in range(len(words) - 12):
            window = tuple(words[k : k + 13])
            first[window] = min(first.get(window, i), i)
    for i, text in rows:
        words = WORD.findall(text)
        gone = [False] * len(words)
        for k in range(len(words) - 12):
            if first[tuple(words[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g).encode()))
    return sorted(want)


def _passages_in_many_places(n):
    """Texts with one passage in different surroundings, copies of whole texts, parts of others, and repeats inside a text."""
    import random

    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    common = [draw.choice(vocabulary) for _ in range(40)]
    texts = []
    for k in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(5, 90))]
        if k % 3 == 0:
            at, a = draw.randrange(len(words)), draw.randrange(15)
            words[at:at] = common[a : a + draw.randrange(13, 26)]
        if k % 7 == 0 and texts:
            words += draw.choice(texts).split()[:50]
        if k % 11 == 0:
            words += words
        texts.append(draw.choice(texts) if k % 5 == 4 else " ".join(words))
    ids = list(range(n))
    draw.shuffle(ids)
    return [*zip(ids, texts), (ids[0], texts[1])]


@pytest.mark.parametrize("held, run", [(1 << 20, 64), (40, 2)])
def test_phrases_whatever_is_sent_at_once(spark, monkeypatch, held, run):
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "RUN", run)
    rows = _passages_in_many_places(300)
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in phrases.remove_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == _phrases_by_force(rows)


@pytest.mark.parametrize("least", [1, 10])
def test_phrases_of_frequent_seeds_are_dealt_by_windows(spark, monkeypatch, least):
    monkeypatch.setattr(phrases, "HOT_LEAST", least)
    monkeypatch.setattr(phrases, "HOT_SHARE", 1 << 40)
    monkeypatch.setattr(phrases, "HELD", 200)
    rows = _passages_in_many_places(300)
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in phrases.remove_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == _phrases_by_force(rows)
    import numpy as np

    # One seed with a form in each document: its windows do not all go to one shard.
    n = np.full(200, 5)
    windows = np.random.default_rng(1).integers(0, 1 << 62, 1000)
    seed, doc = np.full(200, 77 << 40), np.arange(200)
    assert len(list(phrases._messages(seed, n, doc, doc % 6, windows, 12, phrases._short(seed[:1])))) == 12
    assert len(list(phrases._messages(seed, n, doc, doc % 6, windows, 12, np.zeros(0, np.int64)))) == 1


def test_phrases_fill_shards_evenly():
    """Seeds are smallest hashes: dealt as they are, one shard in 40 would get a fifth of all pieces."""
    import random

    import numpy as np

    draw = random.Random(5)
    pieces = phrases.Pieces([" ".join(f"w{draw.randrange(3000)}" for _ in range(200)).encode() for _ in range(400)])
    share = np.bincount(phrases._shards_of(phrases._short(pieces.seed), 40), minlength=40)
    assert len(pieces.seed) > 10_000 and share.max() < 1.5 * share.mean()


def test_phrases_shards_grow_with_what_recurs(spark, monkeypatch):
    """Six copies of each text: shards are as many as their pieces need, not as the bytes of the texts say."""
    monkeypatch.setattr(phrases, "SHARD_PIECES", 50, raising=False)
    texts = _passages_in_many_places(40)
    rows = [(1000 * k + i, text) for k in range(6) for i, text in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    passages = phrases.confirmed_passages(docs.withColumn("block", F.expr("pmod(xxhash64(doc_id, text), 6)").cast("int")), 6)
    assert passages.count() > 6 * 12
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in phrases.remove_phrases(docs).collect()]
    assert sorted(got) == _phrases_by_force(rows)


def test_phrases_are_sent_packed(spark):
    """Work tables and passages do not have a row for each piece or window of each document."""
    rows = spark.createDataFrame(_passages_in_many_places(600), "doc_id long, text string")
    passages = phrases.confirmed_passages(rows.withColumn("block", F.expr("pmod(xxhash64(doc_id, text), 6)").cast("int")), 6)
    assert 0 < passages.count() <= 6 * 12


def test_base_rules_against_brute_force(docs, labels):
    want = []
    for i, t, _ in awkward():
        words = WORD.findall(t or "")
        count = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = [False] * len(words)
        for k in range(len(words) - 4):
            if count[tuple(words[k : k + 5])] > 1:
                again[k : k + 5] = [True] * 5
        lines = [line for line in (t or "").split("\n") if WORD.search(line)]
        failed = len(words) < 10 or 100 * sum(again) > 20 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(again), failed))
    judged = rules.judge(docs, rules.log_ratios(rules.bucket_counts(docs, rules.trusted_ids(labels))))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(judged, *columns) == sorted(want, key=repr)
    assert judged.where("base_failed and kept").isEmpty()


def test_all_trusted_documents_are_counted(spark):
    n = 50_010  # more than were once counted
    given = spark.range(n).selectExpr("id as doc_id", "'calm' as text").unionByName(spark.createDataFrame([(None, "calm"), (0, "calm")], "doc_id long, text string"))
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert [(r.raw, r.target) for r in rules.bucket_counts(given, rules.trusted_ids(labels)).collect()] == [(n + 2, n + 1)]


def test_lm_scores(docs, labels, spark):
    scores = {r.doc_id: r for r in lm_score.score(docs, lm_score.trusted_ids(labels)).collect()}
    assert len(scores) == len({i for i, _, _ in awkward()}) and scores[3].n_tokens == 0 and scores[3].score == 0.0
    assert scores[11].score < scores[8].score  # like a trusted document, and unlike any
    assert scores[2].score > 0  # trusted, yet no other trusted text has its words
    none = lm_score.score(docs, lm_score.trusted_ids(labels.limit(0)))
    assert none.where("score <> 0").isEmpty()


def test_lm_counts_every_word_and_pair(spark):
    import math
    import random

    draw = random.Random(4)
    # Far more words than any fixed number of classes, and most pairs rare.
    texts = [" ".join(f"W{draw.randrange(3000)}" if draw.random() < 0.7 else f"w{draw.randrange(9)}" for _ in range(90)) for _ in range(120)]
    rows = [(i, text) for i, text in enumerate(texts)] + [(3, texts[3]), (None, "w1 never-seen w2"), (200, None), (201, "w1")]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    trusted = spark.createDataFrame([(i,) for i in range(0, 120, 3)] + [(3,), (999,)], "id long")
    found = {r.doc_id: r for r in lm_score.score(given, trusted).collect()}
    words = [["^", *(text or "").lower().split()] for _, text in rows]
    kinds = len({w for ws in words for w in ws[1:]})
    trusted_rows = [i is not None and i < 120 and i % 3 == 0 for i, _ in rows]
    assert lm_score.score(given, trusted).count() == len(rows)
    for at, ((i, _), ws) in enumerate(zip(rows, words)):
        losses = []
        others = sum(len(o) - 1 for k, o in enumerate(words) if k != at)
        for target in (True, False):  # models of all other rows
            some = [other for k, other in enumerate(words) if k != at and (trusted_rows[k] or not target)]
            one, followed = Counter(w for o in some for w in o[1:]), Counter(w for o in some for w in o[:-1])
            two = Counter(p for o in some for p in zip(o, o[1:]))
            share = one.total() / others
            unigram = {w: (one[w] + share) / (one.total() + share * kinds) for w in ws}
            prior = lm_score.PRIOR * share
            losses.append(sum(-math.log((two[c, w] + prior * unigram[w]) / (followed[c] + prior))
                              for c, w in zip(ws, ws[1:])) / max(1, len(ws) - 1))
        assert found[i].n_tokens == len(ws) - 1
        assert (found[i].target_loss, found[i].background_loss) == (pytest.approx(losses[0]), pytest.approx(losses[1]))


def test_lm_probabilities_add_up():
    import numpy as np

    draw = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in draw.zipf(1.3, 30) % 40).encode() for _ in range(25)] + [b" ".join(b"w%d" % k for k in range(40))]
    trusted = np.arange(27) % 2 == 0
    for first in ("w1", "w39"):
        total = np.zeros(2)
        for k in range(40):  # the models without the last text are the same for all its endings
            block = lm_score.Block([*texts, f"{first} w{k}".encode()])
            words, pairs = block.counts(trusted)
            losses = lm_score.token_losses(block, trusted, words, pairs, words[:2].sum(axis=1), 40)
            total += np.exp([-loss[-1] for loss in losses])
        assert np.abs(total - 1).max() < 1e-9


def test_lm_scores_tell_likeness_not_membership(spark):
    import random

    draw = random.Random(9)
    calm, loud = [f"calm{k}" for k in range(400)], [f"loud{k}" for k in range(400)]
    rows = [(i, " ".join(draw.choice(calm if i < 300 else loud) for _ in range(80))) for i in range(500)]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "id long")
    found = {r.doc_id: r.score for r in lm_score.score(given, trusted).collect()}
    inside, left_out, other = ([found[i] for i in some] for some in (range(0, 300, 2), range(1, 300, 2), range(300, 500)))
    assert abs(sum(inside) / 150 - sum(left_out) / 150) < 0.1
    assert sum(a < b for a in inside for b in left_out) / 150**2 < 0.6
    assert max(left_out) < min(other)


def test_languages(docs, spark):
    found = {r.doc_id: r for r in langid.identify(docs, langid.profiles(docs.where("doc_id <> 2"))).collect()}
    assert found[2].lang_pred == "en" and 0.5 <= found[2].score <= 1 and found[8].lang_pred == "fr" and found[10].lang_pred == "de"
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (3, 4, 5, 6))
    nothing = langid.identify(docs, langid.profiles(docs.limit(0)), keep=["doc_id"])
    assert {tuple(r)[1:] for r in nothing.collect()} == {("und", 0.0)}


def test_profiles_are_limited_before_the_sort(docs, spark):
    found = langid.profiles(docs, 5)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    ranks = {}
    for r in found.collect():
        ranks.setdefault(r.lang, []).append(r.rank)
    assert {lang: sorted(x) for lang, x in ranks.items()} == {lang: [0, 1, 2, 3, 4] for lang in ("en", "de", "fr")}


def test_rows_without_an_id_are_not_held_out(docs, labels, tmp_path, spark):
    import zlib

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for query, parts, part in ((langid.op1_language_id, 4, 2), (quality.op3_quality_mil, 3, 1)):
        want = [(i, i is not None and zlib.crc32(str(i).encode()) % parts == part) for i, _, _ in awkward()]
        assert rows_of(query(spark, str(tmp_path)), "doc_id", "held_out") == sorted(want, key=repr)


def test_rank_order_distance():
    rows = [("a", gram, k) for k, gram in enumerate(langid.gram_counts("abba")[0].tolist())]
    table = langid.Profiles(rows + [("b", 1, 0)], len(rows))
    codes, counts = langid.gram_counts("abba")
    order = sorted(zip((-counts).tolist(), codes.tolist()))
    distance = sum(abs(dict((g, k) for _, g, k in rows)[g] - k) for k, (_, g) in enumerate(order))
    assert table.predict("abba") == ("a", pytest.approx(len(order) * len(rows) / (distance + len(order) * len(rows))))


def test_quality(docs, labels):
    import numpy as np

    rng = np.random.default_rng(0)
    good = [quality.passages([" ".join(rng.choice(["some", "calm", "plain", "words"], 90)).encode()])[0] for _ in range(60)]
    bad = [quality.passages([" ".join(rng.choice(["BUY!!", "NOW!!", "$$$"], 90)).encode()])[0] for _ in range(60)]
    model = quality.fit_bags(good + bad, np.array([1] * 60 + [0] * 60))
    p = quality.forward(model, *quality.passages([b"calm words some plain " * 40, b"NOW!! $$$ BUY!! " * 40]))["p"]
    assert p[0] > 0.9 > 0.1 > p[1]
    scored = quality.score(docs, quality.fit(docs, labels), keep=["doc_id", "score"])
    assert scored.count() == len(awkward()) and scored.where("score not between 0 and 1 or (score >= 0.5) <> (predicted = 1)").isEmpty()
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_long_labelled_documents_are_fitted_on(spark, monkeypatch):
    import numpy as np

    texts = [" ".join(f"{'calm' if k % 2 else 'BUY!!'}{i}" for i in range(64 * (120 + k))) for k in range(4)] + ["few words"]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_bags", lambda bags, y: seen.append((bags, y)) or {})
    quality.fit(given, known)
    (bags, y), = seen
    assert sorted(map(len, bags)) == [1, 96, 96, 96, 96] and y.sum() == 2
    whole = {tuple(np.unique(bag[:, -1])): bag for bag in bags}
    for text in texts:  # passages of the text itself, each with the text's own number of passages
        x, _ = quality.passages([text.encode()])
        assert {row.tobytes() for row in whole[tuple(np.unique(x[:, -1]))]} <= {row.tobytes() for row in x}


def test_attention_gradients():
    import numpy as np

    rng = np.random.default_rng(4)
    bags = [rng.normal(size=(n, 6)).astype(np.float32) for n in (1, 3, 2)]
    y, weight, counts = np.array([1.0, 0.0, 1.0]), np.ones(3), np.array([1, 3, 2])
    model = {k: v.astype(np.float64) for k, v in quality.fit_bags(bags, np.array([1, 0, 1]), 5, 4, epochs=1).items()}
    x = np.concatenate(bags).astype(np.float64)

    def loss():
        p = quality.forward(model, x, counts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, gradient in quality._gradients(model, x, counts, y, weight).items():
        at = (0,) * model[name].ndim
        model[name][at] += 1e-5
        up = loss()
        model[name][at] -= 2e-5
        down = loss()
        model[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - gradient[at]) < 1e-6, name


def test_items_are_found(spark, docs):
    items = [(1, BASE[:200]), (2, None), (None, ""), (3, "Which animals look on in wonder? many other animals look on in wonder and say nothing at all"), (4, BASE)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, table).collect()}
    assert got == {(d, i) for d in (1, 2, None, BIG, BIG + 1) for i in (1, 4)} | {(10, 1), (10, 4)}
    clean = decontaminate.without_items(docs, table)
    assert clean.schema == docs.schema and {r.doc_id for r in clean.collect()} == {None, 3, 4, 5, 6, 7, 8, 9, 11, 12}
    assert decontaminate.overlaps(docs, table.limit(0)).isEmpty() and decontaminate.without_items(docs, table.limit(0)).count() == docs.count()


def test_scores_do_not_depend_on_the_shards(spark, monkeypatch):
    # Every other item is given twice, one more with a null id; the only item of its length is among them.
    texts = [f"Which w{k} and w{k * 3 % 40} are here or there? it is w{k} of {' '.join('lot' for _ in range(k % 7))}" for k in range(40)] + ["lone words"]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts[::2])] + [(None, texts[3])], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"some text first {t} then x{k} more") for k, t in enumerate(texts)], "doc_id long, text string")
    want = Counter(tuple(r) for r in decontaminate.overlaps(docs, items).collect())
    assert {(k, k) for k in range(41)} | {(3, None), (4, 102)} <= {key[:2] for key in want}
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 15)
    shards = list(decontaminate.item_shards(items))
    assert len(shards) == 3 and sum(len(part) for part, _ in shards) == len(texts)
    got = Counter(tuple(r) for r in decontaminate.overlaps(docs, items).collect())
    rounded = lambda rows: Counter((*key[:2], *(round(x, 9) for x in key[2:])) for key in rows.elements())
    assert rounded(got) == rounded(want)


def test_wand_finds_all_items_above_the_threshold():
    import random

    random.seed(1)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(random.choices(words, k=random.randint(3, 30)))) for k in range(150)]
    shard = decontaminate.Shard(items)
    texts = [decontaminate.words_of(" ".join(random.choices(words, k=random.randint(0, 200)))) for _ in range(40)]
    found = decontaminate.Found(texts, shard.terms)
    hits = 0
    for threshold in (0.3, 0.6):
        for index in shard.classes:
            got, want = set(), set()
            for t, run, block in zip(*(x.tolist() for x in index.passages(found, threshold))):
                own = {shard.terms[w] for w in texts[t][run * index.length : (run + 2) * index.length] if w in shard.terms}
                got |= {(t, run, rank) for rank, _ in index.search(own, block, threshold)}
            for t, text in enumerate(texts):
                runs = -(-len(text) // index.length)
                for run in range(max(1, runs - 1) if runs else 0):
                    own = {shard.terms[w] for w in text[run * index.length : (run + 2) * index.length] if w in shard.terms}
                    score = Counter()
                    for term in own:
                        for ranks, weights in index.postings.get(term, {}).values():
                            score.update(dict(zip(ranks, weights)))
                    want |= {(t, run, rank) for rank, value in score.items() if value >= threshold - 1e-9}
            assert got == want
            hits += len(want)
    assert hits


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "hi"), (2, None, "hi"), (None, "u", "hi"), (3, "é b", None), (4, "u", ""), (2, "v", "hi"), (5, "w", "x\r\n\r\n" * 9999)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, first string")
    index = warc.write_archives(pages, str(tmp_path / "all"))
    records = warc.read_records(index, str(tmp_path / "all")).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, _, html in rows:
        payload, head = (html or "").encode(), first[html or ""]
        kind = "response" if i == head else "revisit"
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, None if i == head else head))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {bytes(r.payload).decode() for r in records if r.payload is not None} == {"hi", "", "x\r\n\r\n" * 9999}
    small = warc.read_records(index, str(tmp_path / "all"), task_bytes=200)
    assert small.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    assert sorted(small.collect(), key=repr) == sorted(records, key=repr)
    only = warc.read_records(index.where("page_id = 5"), str(tmp_path / "all")).collect()
    assert [r.page_id for r in only] == [5]
    large = warc.write_archives(pages, str(tmp_path / "large"), min_bytes=3)
    assert large.where("record_type = 'revisit'").isEmpty()


def test_near_ranges_share_a_request():
    assert warc.coalesced([(0, 10), (10, 5), (30, 5), (500, 1)], gap=20, read_bytes=100) == [(0, 3, 35), (3, 4, 501)]
    assert warc.coalesced([(0, 10), (10, 95)], gap=20, read_bytes=100) == [(0, 1, 10), (1, 2, 105)]
    assert warc.coalesced([]) == []


def test_empty_tables(docs, labels, tmp_path, spark):
    none = docs.limit(0)
    model = quality.fit(none, labels)
    results = [
        bpe.encode(none, bpe.ranks_file()), langid.identify(none, langid.profiles(none)), quality.score(none, model),
        suffixes.remove_repeats(none), simhash.near_duplicates(none), phrases.remove_phrases(none),
        rules.judge(none, rules.log_ratios(rules.bucket_counts(none, rules.trusted_ids(labels)))),
        lm_score.score(none, lm_score.trusted_ids(labels)),
        warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path)),
    ]
    assert all(df.isEmpty() for df in results)
