import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from wardline.operators import dedup as d
from wardline.operators.minhash import PRIME, minhash_bands, minhash_dedup
from wardline.functions.text import token_set


def greedy(rows, percent):
    """First kept wins, one row after the other; also each dropped row's earliest kept match."""
    kept, match = [], {}
    for key, text in rows:
        tokens = set(text.lower().split())
        close = [k for k, s in kept if (100 * len(tokens & s) >= percent * len(tokens | s) if tokens | s else True)]
        if close:
            match[key] = close[0]
        else:
            kept.append((key, tokens))
    return [k for k, _ in kept], match


def frame(spark, texts, partitions=None):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return df.repartition(partitions) if partitions else df


def ids(df):
    return sorted(r.id for r in df.collect())


def words(*numbers):
    return " ".join(f"w{n}" for n in numbers)


def test_chain_is_not_closed_transitively(spark):
    # 20 tokens each; neighbours share 19 of 21, the ends share 18 of 22.
    chain = [words(*range(20)), words(*range(1, 21)), words(*range(2, 22))]
    assert ids(d.near_dedup(frame(spark, chain), order_cols=["id"])) == [0, 2]


def test_exact_tie_is_close(spark):
    texts = [words(*range(18), "a"), words(*range(18), "b"), words(*range(17), "x", "y", "z"), words(*range(17))]
    assert ids(d.near_dedup(frame(spark, texts), order_cols=["id"])) == greedy(list(enumerate(texts)), 85)[0]
    pair = [words(*range(20)), words(*range(17))]  # 17 of 20
    assert ids(d.near_dedup(frame(spark, pair), order_cols=["id"])) == [0]
    assert ids(d.near_dedup(frame(spark, pair), order_cols=["id"], percent=86)) == [0, 1]


def random_texts(seed, count):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [rng.choices(vocabulary[:25], k=rng.choice([1, 2, 3, 8, 12, 20, 30, 34, 40, 60])) for _ in range(10)]
    texts = []
    for _ in range(count):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        texts.append(" ".join(text))
    return texts + ["   ", ""]


@pytest.mark.parametrize("percent,hot_limit", [(85, 256), (85, 3), (40, 4)])
def test_same_as_brute_force(spark, percent, hot_limit):
    texts = random_texts(percent + hot_limit, 150)
    kept, match = greedy(list(enumerate(texts)), percent)
    df = frame(spark, texts, partitions=5)
    assert ids(d.near_dedup(df, order_cols=["id"], percent=percent, hot_limit=hot_limit)) == kept
    pairs = d.near_duplicate_pairs(df, order_cols=["id"], percent=percent, hot_limit=hot_limit).collect()
    assert {r.duplicate: r.kept for r in pairs} == match
    assert all(100 * r.shared >= percent * r.total for r in pairs)


def test_order_by_several_columns(spark):
    df = spark.createDataFrame([(1, 5, words(*range(9))), (0, 7, words(*range(9))), (0, 8, "other text")], "rank int, id long, text string")
    kept = d.near_dedup(df, order_cols=["rank", "id"]).collect()
    assert sorted((r.rank, r.id) for r in kept) == [(0, 7), (0, 8)]


def test_large_group_of_near_copies_costs_one_comparison_per_copy(spark, monkeypatch):
    """A third of the rows differs from one template by a word: candidates stay linear in the rows."""
    copies = [words(*range(40), f"n{i}") for i in range(400)]
    others = [words(*range(1000 + 50 * i, 1030 + 50 * i)) for i in range(800)]
    seen = []
    verify = d._verify

    def counting(candidates, *rest):
        seen.append(candidates.distinct().count())
        return verify(candidates, *rest)

    monkeypatch.setattr(d, "_verify", counting)
    kept = ids(d.near_dedup(frame(spark, copies + others), order_cols=["id"], hot_limit=8))
    assert kept == [0, *range(400, 1200)]
    assert sum(seen) < 3 * 400


def test_exact_copies_are_collapsed_before_comparison(spark, monkeypatch):
    seen = []
    verify = d._verify
    monkeypatch.setattr(d, "_verify", lambda candidates, *rest: seen.append(candidates.count()) or verify(candidates, *rest))
    texts = [words(*range(30))] * 300 + [words(*range(100, 130))]
    assert ids(d.near_dedup(frame(spark, texts), order_cols=["id"])) == [0, 300]
    assert sum(seen) == 0


def test_only_the_first_rows_of_a_key_reach_its_task(spark):
    postings = spark.range(1000).select((F.col("id") % 2).alias("key"), F.col("id").alias("ord"))
    earliest = d._earliest(postings, 8)
    assert plan_of(earliest).count("WindowGroupLimit") == 2
    assert sorted(r.ord for r in earliest.collect()) == list(range(16))


def test_minhash_dedup_same_as_sequential_rule(spark):
    texts = random_texts(5, 200)
    df = frame(spark, texts, partitions=3)
    bands = {r.id: set(r.bands) for r in minhash_bands(df, token_set("text")).collect()}
    taken, kept = set(), []
    for key in range(len(texts)):
        if not bands[key] & taken:
            kept.append(key)
            taken |= bands[key]
    assert ids(minhash_dedup(df, order_cols=["id"])) == kept


def test_minhash_shuffles_no_tokens(spark, monkeypatch):
    from wardline.operators import minhash as m

    plans = []
    monkeypatch.setattr(m, "written", lambda df, name: plans.append(plan_of(df)) or __import__("wardline.workdir").workdir.written(df, name))
    texts = [words(*range(k % 5, 400)) for k in range(12)] + ["short one", "short one"]
    assert ids(m.minhash_dedup(frame(spark, texts), order_cols=["id"]))[0] == 0
    moved = [line for line in plans[0].splitlines() if "Exchange" in line or "HashAggregate" in line or "SortAggregate" in line]
    assert moved and not any("tokens" in line or "text" in line for line in moved)


def test_minhash_of_empty_text(spark):
    bands = [r.bands for r in minhash_bands(frame(spark, ["", "  "]), token_set("text")).collect()]
    assert bands[0] == bands[1] and PRIME == 2**31 - 1


def test_hot_keys_of_unrelated_sets_are_replaced_by_pairs(spark, monkeypatch):
    """Sets that share frequent words only would take a round per `hot_limit` of them."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(12)]
    texts = [" ".join(rng.sample(common, 10) + [f"r{rng.randrange(40)}"]) for _ in range(120)]
    levels = []
    set_keys = d.set_keys
    monkeypatch.setattr(d, "set_keys", lambda *args: levels.append((args[5:] or (1,))[0]) or set_keys(*args))
    assert ids(d.near_dedup(frame(spark, texts), order_cols=["id"], hot_limit=4)) == greedy(list(enumerate(texts)), 85)[0]
    assert levels == list(range(1, len(levels) + 1)) and len(levels) > 1


def test_sets_with_many_hot_keys_are_not_refined_further(spark, monkeypatch):
    monkeypatch.setattr(d, "MOST_HOT", 3)
    texts = random_texts(21, 60)
    kept, match = greedy(list(enumerate(texts)), 85)
    pairs = d.near_duplicate_pairs(frame(spark, texts), order_cols=["id"], hot_limit=2).collect()
    assert {r.duplicate: r.kept for r in pairs} == match


def unrelated(count):
    """Sets of ten common words and ten of their own."""
    return [words(*range(10), *(f"x{i}y{k}" for k in range(10))) for i in range(count)]


@pytest.mark.parametrize("function", ["near_dedup", "near_duplicate_pairs"])
def test_rounds_do_not_grow_with_unrelated_sets(spark, monkeypatch, function):
    rounds = []
    earliest = d._earliest
    monkeypatch.setattr(d, "_earliest", lambda *args: rounds.append(1) or earliest(*args))
    counts = []
    for count in (12, 120):
        texts = unrelated(count) + [unrelated(count)[3] + " more", unrelated(count)[5] + " else"]
        out = getattr(d, function)(frame(spark, texts), order_cols=["id"], hot_limit=2)
        if function == "near_dedup":
            assert ids(out) == list(range(count))
        else:
            assert sorted((r.duplicate, r.kept) for r in out.collect()) == [(count, 3), (count + 1, 5)]
        counts.append(len(rounds))
        rounds.clear()
    assert counts[1] <= counts[0] <= 4


def test_a_round_moves_only_what_its_candidates_need(spark):
    """The tokens of sets that no candidate names stay in the scan: they are left out below the first exchange."""
    sets = d._distinct_sets(d._ordered_rows(frame(spark, [words(*range(i, i + 30)) for i in range(300)]), "text", ["id"]))
    candidates = spark.createDataFrame([(0, 1), (1, 2)], "a_ord long, b_ord long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        _check_round(d._verify(candidates, sets, 85))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _check_round(found):
    assert "LeftSemi" in plan_of(found)
    assert sorted((r.a_ord, r.b_ord) for r in found.collect()) == [(0, 1), (1, 2)]
    moved = [int(x) for x in _shuffled_rows(found)]
    assert moved and max(moved) <= 3


def _shuffled_rows(df):
    """Rows written by each shuffle of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "isFinalPlan=true" in text
    counts = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
            return
        if name.endswith("QueryStage"):
            walk(node.plan())
            return
        if name == "Exchange":
            counts.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    return counts


def test_frequencies_are_exact_for_frequent_tokens(spark):
    import numpy as np

    texts = [words("all", *(("half",) if i % 2 else ()), *(f"r{i}k{k}" for k in range(20))) for i in range(200)]
    sets = d._distinct_sets(d._ordered_rows(frame(spark, texts), "text", ["id"]))
    known = d.token_frequencies(sets, buckets=16, heavy_tokens=100)
    by_hash = {h: t for r in sets.collect() for t, h in zip(r.tokens, r.hashes)}
    names = {t: h for h, t in by_hash.items()}
    exact = known.of(np.array([names["wall"], names["whalf"]]))
    assert exact.tolist() == [200, 100] and len(known.heavy) == 2
    rare = known.of(np.array([h for h, t in by_hash.items() if t.startswith("wr")]))
    assert rare.max() <= 4000 / 8 and known.rest.sum() == 4000


def test_keys_of_unrelated_sets_stay_cold_at_ten_thousand_million_sets():
    """Frequencies far beyond 22 bits: a bucket of rare tokens counts millions, and segments still tell sets apart."""
    import numpy as np

    from wardline.operators import setkeys as k

    rng = np.random.default_rng(3)
    total, per_set = 10**10, 100
    heavy = np.sort(rng.integers(-(2**63), 2**63 - 1, 300))
    counts = np.full(300, total // 10)
    rest = (total * per_set - counts.sum()) // d.SKETCH_BUCKETS
    buckets = np.full(d.SKETCH_BUCKETS, rest)
    np.add.at(buckets, heavy % d.SKETCH_BUCKETS, counts)
    assert rest > 1 << 20 and buckets.max() > 1 << 22
    known = k.Frequencies(buckets, heavy, counts)
    assert set(known.of(heavy)) == {total // 10} and known.of(rng.integers(0, 2**63 - 1, 10)).max() <= rest
    marks = k.marks_of(heavy[:2], np.array([1 << 40, (1 << 40) + (1 << 36)]))
    assert marks[0] >> k.HASH_BITS < marks[1] >> k.HASH_BITS < 1 << 22
    bounds = k.class_bounds(85, per_set)
    seen = {}
    for _ in range(300):
        hashes = np.concatenate((rng.choice(heavy, 30, replace=False), rng.integers(-(2**63), 2**63 - 1, per_set - 30)))
        for key in k._segment_keys(k.marks_of(hashes, known.of(hashes)), 85, total, bounds):
            seen[key] = seen.get(key, 0) + 1
    crowded = sorted(seen.values())[-5:]
    assert crowded[-1] <= 3, crowded


@pytest.mark.parametrize("percent", [70, 85, 95])
def test_close_sets_share_a_key(percent):
    import numpy as np

    from wardline.operators import setkeys as k

    rng = random.Random(percent)
    vocabulary = [int(k.marks_of(np.array([rng.getrandbits(k.HASH_BITS)]), np.array([rng.choice([1, 5, 400, 900])]))[0]) for _ in range(3000)]
    bounds = k.class_bounds(percent, 400)
    checked = 0
    for _ in range(3000):
        a = rng.sample(vocabulary, rng.randrange(6, 300))
        b = list(a)
        for _ in range(rng.randrange(0, len(a) // 6 + 2)):
            b[rng.randrange(len(b))] = rng.choice(vocabulary)
        b = b[: len(b) - rng.randrange(0, len(b) // 10 + 1)]
        a, b = set(a), set(b)
        if a == b or 100 * len(a & b) < percent * len(a | b):
            continue
        checked += 1
        marks = [np.array(sorted(s), dtype=np.int64) for s in (a, b)]
        keys = [k._segment_keys(m, percent, 1000, bounds) for m in marks]
        shared = np.intersect1d(*keys)
        assert len(shared)
        # With all shared keys hot, the refined keys still meet, on every level that is refined.
        for level in range(2, k.SHARED + 1):
            if level > 2 and len(shared) > 60:
                break
            again = [k._segment_keys(m, percent, 1000, bounds, shared, level) for m in marks]
            met = np.intersect1d(*again)
            assert len(met)
            shared = np.union1d(shared, met)
    assert checked > 100


@pytest.mark.parametrize("size", [1000, 5000, 20000])
@pytest.mark.parametrize("hot", [False, True])
def test_number_of_keys_is_linear_in_the_size(size, hot):
    import numpy as np

    from wardline.operators import setkeys as k

    rng = np.random.default_rng(size)
    marks = k.marks_of(rng.integers(0, 1 << k.HASH_BITS, size), rng.integers(1, 1000, size))
    bounds = k.class_bounds(85, size)
    keys = k._segment_keys(marks, 85, 10**6, bounds)
    if hot:
        keys = k._segment_keys(marks, 85, 10**6, bounds, keys)
    assert 0 < len(keys) < size


def test_large_close_sets_share_a_key_also_when_hot():
    import numpy as np

    from wardline.operators import setkeys as k

    rng = np.random.default_rng(1)
    pool = k.marks_of(rng.permutation(1 << 20)[:4000], rng.integers(1, 500_000, 4000))
    for size in (450, 520, 800, 2500):
        for _ in range(20):
            other = pool[: size + int(size * 0.15)]
            a, b = rng.permutation(other)[:size], other
            if 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
                continue
            bounds = k.class_bounds(85, len(b))
            first = [k._segment_keys(x, 85, 10**6, bounds) for x in (a, b)]
            common = np.intersect1d(*first)
            assert len(common)
            refined = [k._segment_keys(x, 85, 10**6, bounds, common) for x in (a, b)]
            assert len(np.intersect1d(*refined))


def exchanged(node):
    """Bytes that each shuffle of a plan that ran has written."""
    name = node.nodeName()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
    found = [node.metrics().apply("dataSize").value()] if name == "Exchange" else []
    children = node.children()
    return found + [n for child in (*inner, *(children.apply(k) for k in range(children.size()))) for n in exchanged(child)]


def test_tokens_travel_once_per_set_not_once_per_pair(spark):
    """All pairs of a block of near copies are compared, but each set's tokens are shuffled once."""
    texts = [words(*range(300), f"own{i}") for i in range(60)]
    sets = d._distinct_sets(d._ordered_rows(frame(spark, texts), "text", ["id"]))
    candidates = spark.createDataFrame([(a, b) for b in range(60) for a in range(b)], "a_ord long, b_ord long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = d._verify(candidates, sets, 85)
        found.collect()
        moved = sum(exchanged(found._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.count() == 60 * 59 // 2
    assert moved < 2 * sum(map(len, texts)) + 64 * 60 * 59 // 2, moved


def test_keys_are_met_in_one_pass_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    keys = np.sort(np.concatenate((rng.integers(0, 40, 90), np.full(50, 17), np.full(5, 99))))
    numbers = rng.permutation(len(keys))
    for size in (1, 7, 1000):
        batches = [pa.record_batch([pa.array(keys[k:k + size]), pa.array(numbers[k:k + size])], names=["key", "id"]) for k in range(0, len(keys), size)]
        rows = [r for batch in d._meeting(4)(iter(batches)) for r in batch.to_pylist()]
        held = {k: sorted(numbers[keys == k].tolist()) for k in np.unique(keys).tolist()}
        pairs = {(a, b) for ids_ in held.values() if len(ids_) <= 4 for a in ids_ for b in ids_ if a < b}
        hot = sorted((k, a) for k, ids_ in held.items() if len(ids_) > 4 for a in ids_)
        assert {(r["a"], r["b"]) for r in rows if r["key"] is None} == pairs
        assert sorted((r["key"], r["a"]) for r in rows if r["key"] is not None) == hot and hot and pairs


def test_signatures_rule_out_unrelated_sets_and_no_close_ones(spark):
    rng = random.Random(2)
    pool = [f"t{i}" for i in range(5000)]
    texts = []
    for size in (14, 40, 200, 900):
        base = rng.sample(pool, size)
        texts += [" ".join(base), " ".join(base[: size - size // 14] + rng.sample(pool, size // 14)), " ".join(rng.sample(pool, size))]
    sets = d._distinct_sets(d._ordered_rows(frame(spark, texts), "text", ["id"]))
    pairs = spark.createDataFrame([(b, a) for b in range(len(texts)) for a in range(b)], "a long, b long")
    found = {(r.a_ord, r.b_ord) for r in d._plausible(pairs, sets, 85).collect()}
    close = {(a, b) for b in range(len(texts)) for a in range(b)
             if 100 * len({*texts[a].split()} & {*texts[b].split()}) >= 85 * len({*texts[a].split()} | {*texts[b].split()})}
    assert close and close <= found and len(found) <= len(close) + 1


def test_large_sets_share_no_key_by_single_tokens():
    """A token in a few large sets made them candidates of each other, and their number grew with its square. Weak sets still meet by prefixes."""
    import numpy as np

    from wardline.operators import setkeys as k

    rng = np.random.default_rng(8)
    hashes = rng.permutation(1 << 20)[:4000]
    bounds = k.class_bounds(85, 2000)
    rare = k.marks_of(hashes, rng.integers(2, 200, 4000))
    a, b = rng.permutation(rare)[:1000], rng.permutation(rare)[:1000]
    assert len(np.intersect1d(a, b)) > 200
    assert not len(np.intersect1d(*(k._segment_keys(x, 85, 10**6, bounds) for x in (a, b))))
    for frequencies in (rng.integers(2, 200, 1100), rng.integers(900_000, 10**6, 1100), np.where(rng.random(1100) < 0.3, 5, 999_000)):
        marks = k.marks_of(hashes[:1100], frequencies)
        for size in (1000, 1050):
            close = [k._segment_keys(x, 85, 10**6, bounds) for x in (marks, rng.permutation(marks)[:size])]
            shared = np.intersect1d(*close)
            assert len(shared)
            assert len(np.intersect1d(*(k._segment_keys(x, 85, 10**6, bounds, shared) for x in (marks, marks))))


def test_low_limits_take_few_rounds(spark, monkeypatch):
    """Unrelated texts that share one key that can't be refined: 45 rounds if each settled no more than `hot_limit` of them."""
    rounds = []
    earliest = d._earliest
    monkeypatch.setattr(d, "_earliest", lambda *args: rounds.append(args[1]) or earliest(*args))
    texts = [f"alpha{i} beta{i} common gamma{i}" for i in range(90)] + ["common alpha7 gamma7", "delta common gamma8 beta8"]
    kept = ids(d.near_dedup(frame(spark, texts), order_cols=["id"], percent=20, hot_limit=2))
    assert kept == greedy(list(enumerate(texts)), 20)[0] == list(range(90))
    assert rounds[0] == 2 and 1 < len(rounds) <= 5


def test_shared_frequencies_need_no_package(spark, monkeypatch):
    """Broadcast values are pickled by reference, so none may be of a class of this package."""
    import pickle
    import pickletools

    seen = []
    context = spark.sparkContext
    share = type(context).broadcast
    monkeypatch.setattr(type(context), "broadcast", lambda self, value: seen.append(value) or share(self, value))
    df = spark.createDataFrame([("1", "a b c d e f"), ("2", "a b c d e f g")], "row_key string, text string")
    assert d.near_dedup(df).count() == 1
    names = [str(arg) for value in seen for _, arg, _ in pickletools.genops(pickle.dumps(value)) if isinstance(arg, str)]
    assert seen and not any("wardline" in name for name in names)


def test_long_signatures_rule_out_pairs_of_large_sets(spark, monkeypatch):
    """Tokens of large unlike sets are not fetched: 64 bytes don't tell these apart. No close pair is lost, whatever the lengths of the signatures."""
    monkeypatch.setattr(d, "BUCKET_PAIRS", 8)
    rng, texts = random.Random(3), []
    for size in (1100, 1950, 2100, 4000):
        tokens = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for part in (1.0, 0.95, 0.9, 0.84):
            texts.append(" ".join([*tokens[: int(size * part)], f"u{rng.random()}"]))
        texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(size)) for _ in range(3)]
    tables = {}
    write = d.written
    monkeypatch.setattr(d, "written", lambda df, name, *more: tables.setdefault(name, write(df, name, *more)))
    sets = d._distinct_sets(d._ordered_rows(frame(spark, texts), "text", ["id"]))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    got = {(r.a_ord, r.b_ord) for r in d._verify(spark.createDataFrame(pairs, "a_ord long, b_ord long"), sets, 85).collect()}
    words = [set(text.split()) for text in texts]
    expected = {(a, b) for a, b in pairs if 100 * len(words[a] & words[b]) >= 85 * len(words[a] | words[b])}
    like = {(r.a_ord, r.b_ord) for r in tables["dedup-like"].collect()}
    assert got == expected and len(expected) >= 16
    assert expected <= like and len(like) < len(pairs) / 4


def near_sets(count):
    """Sets of three tokens in common and some of their own, and after every fifth two near copies of it."""
    texts = []
    for i in range(count):
        texts.append(words("all", "of", "them", *(f"v{i}y{k}" for k in range(20 + i % 3))))
        if i % 5 == 0:
            texts += [f"{texts[-1]} more", f"{texts[-1]} other"]
    return texts


def test_hot_keys_lose_sets_that_no_other_is_like():
    """A pass over postings with signatures: pairs that may be close, of hot keys only the sets that have such a partner, however the rows are batched."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    bases = [rng.integers(-2**62, 2**62, size) for size in rng.choice([30, 200, 1500], 60)]
    sets = bases + [np.append(bases[i][: int(len(bases[i]) * 0.97)], rng.integers(0, 99)) for i in (0, 0, 0, 7, 9, 9, 20, 30, 31, 32, 33)]

    def signature(h):
        odd = lambda bits: np.packbits((np.bincount(h >> 7 & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)
        return [*odd(d.SIGNATURE_BITS), *(odd(d.WIDE_BITS) if len(h) > d.LONG_SIGNATURE else [])]

    holders = {1: range(len(sets)), 2: range(0, len(sets), 2), 3: [0, 60, 61, 62], 4: [1, 2], 5: [7, 63], 9: [5]}
    rows = [(key, i) for key, members in holders.items() for i in members]
    close = lambda i, j: 100 * len({*sets[i]} & {*sets[j]}) >= 85 * len({*sets[i]} | {*sets[j]})
    for size in (1, 13, 1000):
        for limit in (2, 256):
            batches = [
                pa.record_batch([
                    pa.array([key for key, _ in part], pa.int64()), pa.array([i for _, i in part], pa.int64()),
                    pa.array([len(sets[i]) for _, i in part], pa.int32()), pa.array([signature(sets[i]) for _, i in part], pa.list_(pa.int64())),
                ], names=["key", "id", "n", "signature"])
                for part in (rows[k:k + size] for k in range(0, len(rows), size))
            ]
            found = [r for batch in d._meeting(limit, 85)(iter(batches)) for r in batch.to_pylist()]
            pairs, hot = {(r["a"], r["b"]) for r in found if r["key"] is None}, {(r["key"], r["a"]) for r in found if r["key"] is not None}
            met = {(i, j) for members in holders.values() for i in members for j in members if i < j and close(i, j)}
            assert met == pairs | {(i, j) for key, i in hot for other, j in hot if other == key and i < j and close(i, j)} and len(met) > 11
            assert all(any(close(i, j) for other, j in hot if other == key and i != j) for key, i in hot)
            assert {key for key, _ in hot} == ({1, 2, 3} if limit == 2 else set())


def test_keys_that_one_set_has_go_no_further():
    import numpy as np
    import pyarrow as pa

    keys = np.sort(np.concatenate((np.arange(50), np.arange(0, 50, 7), np.full(30, 14))))
    for size in (1, 9, 1000):
        batches = [pa.record_batch([pa.array(keys[k:k + size]), pa.array(np.arange(k, min(k + size, len(keys))))], names=["key", "id"]) for k in range(0, len(keys), size)]
        rows = [r for batch in d._shared(8)(iter(batches)) for r in batch.to_pylist()]
        assert sorted(r["key"] for r in rows) == [k for k in keys.tolist() if k % 7 == 0]
        assert {r["key"] for r in rows if r["many"]} == {14} and {r["many"] for r in rows if r["key"] == 14} == {True}


@pytest.mark.parametrize("function", ["near_dedup", "near_duplicate_pairs"])
def test_unlike_sets_of_shared_keys_are_never_written(spark, monkeypatch, function):
    """Unlike sets that share a key were pairs, or postings of hot keys that went from round to round."""
    monkeypatch.setattr(d, "COMPARED_PART", 1)
    monkeypatch.setattr(d, "SHARED", 1)
    monkeypatch.setattr(d, "set_keys", lambda hashes, *rest: F.array_distinct(F.transform(hashes, lambda h: F.pmod(h, F.lit(20)))))
    tables, write = {}, d.written
    monkeypatch.setattr(d, "written", lambda df, name, *more: tables.setdefault(name, []).append(write(df, name, *more)) or tables[name][-1])
    texts = near_sets(40)
    kept, match = greedy(list(enumerate(texts)), 85)
    for hot_limit in (2, 256):
        tables.clear()
        out = getattr(d, function)(frame(spark, texts), order_cols=["id"], hot_limit=hot_limit)
        assert ids(out) == kept if function == "near_dedup" else {r.duplicate: r.kept for r in out.collect()} == match
        met = tables["dedup-met"][0]
        assert met.where("key IS NULL").select("a", "b").distinct().count() <= 3 * 8
        assert met.where("key IS NOT NULL").select("a").distinct().count() <= (3 * 8 if hot_limit == 2 else 0)


def test_finer_keys_only_where_a_round_leaves_sets_out(spark):
    hot = spark.createDataFrame([(1, i) for i in range(10)] + [(2, i) for i in range(4)], "key long, ord long")
    still = spark.createDataFrame([(0,), (1,), (2,), (20,)], "ord long")
    assert d._any_beyond(hot, still, 2) and not d._any_beyond(hot, still, 3)


def test_texts_of_pairs_are_split_once(spark):
    """Rows of sets with copies were found again by splitting all texts a second time."""
    texts = [words(*range(30)), words(*range(30)), words(*range(29)), words(*range(50, 80))]
    out = d.near_duplicate_pairs(frame(spark, texts), order_cols=["id"])
    assert sorted((r.duplicate, r.kept) for r in out.collect()) == [(1, 0), (2, 0)]
    assert "sha2" not in plan_of(out) and "split" not in plan_of(out)
