"""SimHash near-duplicates (operator 6): a binary trie of the fingerprints is joined with itself.

Node pairs are traversed together from the root down; a pair carries the bits in which its prefixes differ and is dropped
when they exceed the error budget. Spark holds the upper levels: of k+e blocks of a fingerprint (k errors allowed), e
must agree between linked ones, so the trie is rooted once for every choice of e blocks, and a group of fingerprints that agree
in them is one subtrie whose traversal starts with no errors. e grows with the number of fingerprints, so subtries stay small.
A subtrie above `GROUP_ROWS` is cut into parts by hash, and every pair of parts is a task of its own, so that no task
holds an unbounded group; nothing is capped.

A traversal returns a spanning forest of its links, not all pairs; components come from label propagation over these
links, in tables. Equal fingerprints are one row before the join, so copies cost nothing.

Null text is empty and, having no words, gets fingerprint zero. Repeated rows give one result each. A null id takes part
in links, but never names a component unless all its rows are null. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.registry import query
from wardline.llm.common import frugal, frugal_group, id_and_text
from wardline.workdir import written

BITS = 64
GROUP_ROWS = 4096
_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SHIFTS = np.arange(BITS, dtype=np.uint64)


def fingerprint(text: bytes, shingle_words: int = 4) -> int:
    """SimHash of the XXH64 (seed 42) of all word shingles, repeats included."""
    import xxhash

    words = text.translate(_UPPER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[:n].tolist()
    last = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, last)), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.bitwise_or.reduce((2 * ones > n).astype(np.uint64) << _SHIFTS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """(doc_id, print, *more): one row per row of `docs`; the fingerprint as a signed long, `more` as texts."""

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints), *batch.columns[2:]], ["doc_id", "print", *batch.schema.names[2:]])

    schema = ", ".join(["doc_id long, print long", *(f"{name} string" for name in more)])
    return id_and_text(docs, id_col, text_col, **more).mapInArrow(frugal(sign), schema)


def root_choices(count: int, errors: int, group: int = 512) -> list[list[tuple[int, int]]]:
    """The ways to root the trie: which blocks of bits (from, to) must agree. Subtries get about `group` rows or less."""
    for exact in range(1, 4):
        if count >> int(BITS / (errors + exact) * exact) <= group:
            break
    cuts = [round(i * BITS / (errors + exact)) for i in range(errors + exact + 1)]
    return [list(chosen) for chosen in combinations(zip(cuts, cuts[1:]), exact)]


def _mask(blocks: list[tuple[int, int]]) -> int:
    bits = sum(((1 << (b - a)) - 1) << a for a, b in blocks)
    return bits - (1 << 64) if bits >> 63 else bits


def rooted(prints: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprints with their bits permuted: the agreeing blocks come first."""
    edges = sorted({0, BITS, *(x for block in blocks for x in block)})
    rest = [block for block in zip(edges, edges[1:]) if block not in blocks]
    out, top = np.zeros(len(prints), np.uint64), BITS
    for a, b in [*blocks, *rest]:
        top -= b - a
        out |= (prints >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)) << np.uint64(top)
    return out


def trie_links(
    left: np.ndarray, right: np.ndarray | None, errors: int, agreed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of sorted distinct fingerprints that differ in `errors` bits at most and agree in the first `agreed`.

    With `right` None the trie of `left` is joined with itself, and pairs have i < j. Nodes are ranges of the sorted
    array; a pair of nodes advances one bit, splits into its child pairs, and dies when its prefixes differ too much.
    All pairs of a level advance together.
    """
    own = right is None
    right = left if own else right
    found_i, found_j = [], []
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    drop = np.uint64(BITS - agreed)
    tops = np.unique(left >> drop) if agreed else np.zeros(1, np.uint64)

    def ranges(values):
        if not agreed:
            return np.array([0]), np.array([len(values)])
        return np.searchsorted(values >> drop, tops), np.searchsorted(values >> drop, tops, "right")

    (a, b), (c, d) = ranges(left), ranges(right)
    stack = [(BITS - 1 - agreed, a, b, c, d, np.zeros(len(a), np.int64))]

    def split(values, low, high, bit):
        # First place in each range whose bit is set: its rows are sorted and agree in all higher bits.
        above = np.uint64(bit + 1)
        first = values[low] >> above << above if bit < BITS - 1 else np.zeros(len(low), np.uint64)
        return np.clip(np.searchsorted(values, first | np.uint64(1 << bit)), low, high)

    while stack:
        bit, a, b, c, d, spent = stack.pop()
        small = (b - a) * (d - c) <= 64
        if bit < 0:
            small[:] = True
        if small.any():
            n, m = (b - a)[small], (d - c)[small]
            pairs = n * m
            which = np.repeat(np.arange(len(pairs)), pairs)
            offset = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            i, j = a[small][which] + offset // m[which], c[small][which] + offset % m[which]
            near = np.bitwise_count(left[i] ^ right[j]) <= errors
            if own:
                near &= i < j
            found_i.append(i[near])
            found_j.append(j[near])
        keep = ~small
        if not keep.any():
            continue
        a, b, c, d, spent = (x[keep] for x in (a, b, c, d, spent))
        p, q = split(left, a, b, bit), split(right, c, d, bit)
        children = [(a, p, c, q, spent), (p, b, q, d, spent), (a, p, q, d, spent + 1)]
        crossed = (p, b, c, q, spent + 1)
        if own:  # of a node with itself, one of the mirrored child pairs is enough
            other = a != c
            crossed = tuple(x[other] for x in crossed)
        children.append(crossed)
        a, b, c, d, spent = (np.concatenate(x) for x in zip(*children))
        alive = (a < b) & (c < d) & (spent <= errors)
        if alive.any():
            parts = max(1, int(alive.sum()) // 500_000 + 1)
            for piece in np.array_split(np.flatnonzero(alive), parts):
                stack.append((bit - 1, a[piece], b[piece], c[piece], d[piece], spent[piece]))
    return np.concatenate(found_i or [np.zeros(0, np.int64)]), np.concatenate(found_j or [np.zeros(0, np.int64)])


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links of n rows, for each row that has any, one to the first row of its component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if np.array_equal(before, label):
            break
    rows = np.flatnonzero(label != np.arange(n))
    return label[rows], rows


def links(prints: DataFrame, errors: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(src, dst): links between distinct fingerprints (column `print`, distinct, written) that connect all linked ones."""
    count = prints.count()
    choices = root_choices(count, errors)
    roots = F.array(*[
        F.struct(F.lit(k).alias("root"), F.col("print").bitwiseAND(_mask(blocks)).alias("prefix"))
        for k, blocks in enumerate(choices)
    ])
    keyed = prints.select("print", F.explode(roots).alias("at")).select("print", "at.*")
    hot = written(keyed.groupBy("root", "prefix").count().where(F.col("count") > group_rows)
                  .select("root", "prefix", F.ceil(F.col("count") / (group_rows // 2)).cast("int").alias("parts")),
                  "simhash-hot")
    # Many small subtries are traversed by one call; a bucket holds some 20,000 rows.
    zero = F.lit(0)
    buckets = count // 20_000 + 1
    cool = keyed.join(hot, ["root", "prefix"], "left_anti").select(
        "print", "root", F.pmod(F.xxhash64("prefix"), F.lit(buckets)).alias("bucket"), F.lit(0).cast("long").alias("prefix"),
        zero.alias("a"), zero.alias("b"), zero.alias("side"))
    dealt = cool
    if not hot.isEmpty():
        # A row of part p meets every other part once: as (p, q) for q >= p, and as (q, p) for q < p.
        cells = F.transform(
            F.sequence(zero, F.col("parts") - 1),
            lambda q: F.struct(F.least(q, F.col("p")).alias("a"), F.greatest(q, F.col("p")).alias("b"),
                               (q < F.col("p")).cast("int").alias("side")),
        )
        part = F.pmod(F.xxhash64("print"), F.col("parts").cast("long")).cast("int")
        split_up = keyed.join(hot, ["root", "prefix"]).withColumn("p", part)
        dealt = cool.unionByName(split_up.select(
            "print", "root", F.lit(0).cast("long").alias("bucket"), "prefix", F.explode(cells).alias("c")
        ).select("print", "root", "bucket", "prefix", "c.*"))

    def traverse(key, group):
        import pandas as pd

        prints, side = group["print"].to_numpy().view(np.uint64), group["side"].to_numpy()
        blocks = choices[int(key[0])]
        agreed = sum(b - a for a, b in blocks)
        turned = rooted(prints, blocks)
        order = np.lexsort((turned, side))
        cut = int((side == 0).sum())
        prints, turned = prints[order].view(np.int64), turned[order]
        if key[3] == key[4]:
            i, j = trie_links(turned, None, errors, agreed)
        else:
            i, j = trie_links(turned[:cut], turned[cut:], errors, agreed)
            j = j + cut
        src, dst = spanning(len(prints), i, j)
        return pd.DataFrame({"src": prints[src], "dst": prints[dst]})

    return dealt.groupBy("root", "bucket", "prefix", "a", "b").applyInPandas(frugal_group(traverse), "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of the links (src, dst).

    Each round hooks every node to the smallest label around it (large star), then shortens paths (small star); the
    rounds grow with the logarithm of the longest chain. All sides are small rows and are aggregated before they shuffle.
    """
    edges = written(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
                    .where("u <> v").distinct(), "simhash-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "simhash-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").where("u <> v").distinct()
        small = written(small, "simhash-small")
        if small.count() == edges.count() and small.exceptAll(edges).isEmpty():
            return small.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
        edges = small


def _firsts(signed: DataFrame, errors: int, first: Column) -> DataFrame:
    """(print, first): for every distinct fingerprint the least `first` of all rows of its component."""
    distinct = written(signed.groupBy("print").agg(F.min(first).alias("first")), "simhash-distinct")
    label = written(components(links(distinct.select("print"), errors)), "simhash-labels")
    named = distinct.join(label, distinct["print"] == label["node"], "left").select(
        "print", "first", F.coalesce("label", "print").alias("label"))
    # One row per fingerprint, joined with few rows per component.
    return named.drop("first").join(named.groupBy("label").agg(F.min("first").alias("first")), "label").select("print", "first")


def near_duplicates(docs: DataFrame, errors: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print, component_id) of every row: the component is named by its smallest id."""
    signed = written(fingerprints(docs, id_col, text_col), "simhash-prints")
    # With all documents, whose hot prints are split.
    return signed.join(_firsts(signed, errors, F.col("doc_id")), "print").select(
        "doc_id", "print", F.col("first").alias("component_id"))


def one_of_each(docs: DataFrame, errors: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, with all columns of `docs`.

    The row with the smallest id stays (rows without an id come last), of several texts with that id the one with the smallest
    digest, of rows equal in id and text any one. Rows are told apart by id and text together, so an id that several texts
    share, or that is null, never decides about a text of another component.
    """
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    identity = F.concat(id_text, F.lit(":"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    signed = written(fingerprints(docs, id_col, text_col, identity=identity), "simhash-prints")
    best = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "identity")
    marked = written(signed.join(_firsts(signed, errors, best), "print").select(
        "identity", (F.col("identity") == F.col("first.identity")).alias("stays")), "simhash-marked")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), identity.alias("identity"))
    kept = rows.join(marked.where("not stays").select("identity").distinct(), "identity", "left_anti")
    repeated = written(marked.where("stays").groupBy("identity").count().where("count > 1").select("identity"), "simhash-repeated")
    if not repeated.isEmpty():
        once = kept.join(repeated, "identity", "left_semi").dropDuplicates(["identity"])
        kept = kept.join(repeated, "identity", "left_anti").unionByName(once)
    return kept.select("row.*")


@query("op6_simhash")
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
