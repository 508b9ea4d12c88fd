"""Benchmark decontamination (operator 4): a BM25 inverted index of test items, searched by block-max WAND.

Every passage of every document is a query against the index: windows of twice the longest item's words, half overlapping, so any run
of an item's length lies in one. An item's BM25 score is given as a share of what the item scores against itself, and all items at or above
the threshold are retrieved. The sum of the term maxima rules out passages, the sum of the block maxima rules out blocks of items,
both for many passages at once; in the blocks that remain, WAND's pivots skip to the items that can reach the threshold. What is retrieved is then verified: the question's five-word shingles and the words of the answer must
be found in the passage, four fifths of each.

The index, not the corpus, is cut: a shard holds some 4,000 items or 8 MB at most, is broadcast, and all documents are searched
against one shard after the other, in one pass each and without a shuffle. Items of one shard are searched in length
classes, so one long item does not widen the passages for all. Document frequencies and the average length are counted once over all items, and a
shard gets those of its own terms, so a score does not depend on the shards. Items of equal text are searched once.

Words are lower-cased and stripped of ASCII punctuation. Null or wordless texts and items match nothing; an item without an answer
is verified by its question alone. Repeated rows, items with equal texts and null ids are reported like others. An empty
table on either side gives no rows. Whole texts are searched, however long.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.registry import query
from wardline.llm.common import frugal
from wardline.workdir import written

K1, B = 1.2, 0.75
BLOCK = 8
SHARD_ITEMS, SHARD_BYTES = 4000, 8_000_000
THRESHOLD, VERIFY, SHINGLE = 0.7, 0.8, 5
_FOLD = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_FOLD).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's parts: up to its last question mark and after it, or else its last sentence as the answer."""
    text = text.strip()
    cut = text.rfind("?") + 1
    if not words_of(text[cut:]) or not cut:
        cut = max(text.rfind(mark, 0, len(text) - 1) for mark in ".!?\n") + 1
    question, answer = words_of(text[:cut]), words_of(text[cut:])
    return (question, answer) if question else (answer, [])


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """Inverted index of one length class: per term its postings, cut into blocks of `BLOCK` items, with each block's maximum.

    Weights are shares of the items' self-scores.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], terms: dict[bytes, int], idf: dict[int, float], average: float):
        self.numbers = [number for number, _ in items]
        self.length = max(len(words) for _, words in items)
        tf = [Counter(terms[w] for w in words) for _, words in items]
        # term -> block -> ([ranks], [weights])
        self.postings: dict[int, dict[int, tuple[list[int], list[float]]]] = {}
        for rank, ((_, words), counts) in enumerate(zip(items, tf)):
            norm = K1 * (1 - B + B * len(words) / average)
            share = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in counts.items()}
            whole = sum(share.values())
            for t, value in share.items():
                ranks, weights = self.postings.setdefault(t, {}).setdefault(rank // BLOCK, ([], []))
                ranks.append(rank)
                weights.append(value / whole)
        self.blocks = -(-len(items) // BLOCK)
        self.highest = np.zeros(len(terms))
        lists: list[tuple[list[int], list[float]]] = [([], []) for _ in range(len(terms))]
        for t, blocks in self.postings.items():
            lists[t] = list(blocks), [max(weights) for _, weights in blocks.values()]
            self.highest[t] = max(lists[t][1])
        self.count = np.array([len(blocks) for blocks, _ in lists], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.block = np.array([x for blocks, _ in lists for x in blocks], np.int64)
        self.block_max = np.array([x for _, maxima in lists for x in maxima])

    def passages(self, found: "Found", threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, run, block) of the passages and item blocks that the maxima do not rule out; a passage is runs k and k+1 of a text.

        A term counts once in a passage: where it first stands in the first run, and in the second if it is not in the first. The
        sum of the term maxima rules out whole passages, the sum of the block maxima the blocks of items for the others.
        """
        runs = -(-found.sizes // self.length)
        base = np.cumsum(runs) - runs
        run = base[found.text] + found.place // self.length
        before = np.where(found.previous >= 0, base[found.text] + found.previous // self.length, -2)
        new = before != run
        fresh = new & (before != run - 1) & (run > base[found.text])
        passage = np.concatenate((run[new], run[fresh] - 1))
        term = np.concatenate((found.term[new], found.term[fresh]))
        total = int(runs.sum())
        # The last run of a text is part of the passage before it, unless it is the only one.
        usable = np.ones(total, bool)
        usable[(base + runs - 1)[runs > 1]] = False
        usable &= np.bincount(passage, self.highest[term], total) >= threshold - 1e-9
        pick = usable[passage] & (self.count[term] > 0)
        passage, term = passage[pick], term[pick]
        n = self.count[term]
        at = np.repeat(self.first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row = np.repeat(passage, n)
        slots = np.flatnonzero(usable)
        dense = np.zeros(total, np.int64)
        dense[slots] = np.arange(len(slots))
        bound = np.bincount(dense[row] * self.blocks + self.block[at], self.block_max[at], len(slots) * self.blocks)
        likely = np.flatnonzero(bound >= threshold - 1e-9)
        passage = slots[likely // self.blocks] if len(likely) else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(runs)), runs)[passage]
        return text, passage - base[text], likely % self.blocks

    def search(self, terms: set[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """The items of a block (by rank) that reach the threshold for the terms of a passage, by WAND's pivots."""
        cursors = []
        for t in terms:
            if t in self.postings and block in self.postings[t]:
                ranks, weights = self.postings[t][block]
                cursors.append([ranks[0], 0, ranks, weights, max(weights)])
        found, least = [], threshold - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for cursor in cursors:
                bound += cursor[4]
                if bound >= least:
                    pivot = cursor[0]
                    break
            if pivot is None:  # no later item can reach the threshold
                break
            if cursors[0][0] == pivot:
                score = sum(c[3][c[1]] for c in cursors if c[0] == pivot)
                if score >= least:
                    found.append((pivot, score))
                pivot += 1
            for cursor in cursors:
                if cursor[0] < pivot:
                    cursor[1] = bisect_left(cursor[2], pivot, cursor[1])
                    cursor[0] = cursor[2][cursor[1]] if cursor[1] < len(cursor[2]) else math.inf
            cursors = [c for c in cursors if c[0] < math.inf]
        return found


class Found:
    """Where the words of some texts are terms of an index, and where each term stood before in its text (or -1)."""

    def __init__(self, texts: list[list[bytes]], terms: dict[bytes, int]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        unknown = len(terms)
        ids = np.fromiter(map(terms.get, chain.from_iterable(texts), repeat(unknown)), np.int64, int(self.sizes.sum()))
        known = np.flatnonzero(ids != unknown)
        self.term = ids[known]
        self.text = np.repeat(np.arange(len(texts)), self.sizes)[known]
        self.place = known - (np.cumsum(self.sizes) - self.sizes)[self.text]
        key = self.text * unknown + self.term
        order = np.argsort(key, kind="stable")
        again = key[order[1:]] == key[order[:-1]]
        self.previous = np.full(len(known), -1, np.int64)
        self.previous[order[1:][again]] = self.place[order[:-1][again]]


class Shard:
    """What a task needs to search texts for one shard of items, each with what identifies it.

    `statistics` are the number of all items with words, their average length and the document frequencies of (at least) the shard's
    terms; without, the shard's items are all there are.
    """

    def __init__(self, items: list[tuple[object, str | None]], statistics: tuple[int, float, dict[bytes, int]] | None = None):
        self.ids = [item_id for item_id, text in items]
        self.parts = [question_and_answer(text or "") for _, text in items]
        words = [question + answer for question, answer in self.parts]
        self.shingles = [shingles(question) for question, _ in self.parts]
        self.answers = [set(answer) for _, answer in self.parts]
        self.terms: dict[bytes, int] = {}
        classes: dict[int, list[tuple[int, list[bytes]]]] = {}
        for number, own in enumerate(words):
            if own:
                classes.setdefault(len(own).bit_length(), []).append((number, own))
                for word in own:
                    self.terms.setdefault(word, len(self.terms))
        if statistics is None:
            worded = [own for own in words if own]
            statistics = len(worded), sum(map(len, worded)) / max(1, len(worded)), Counter(w for own in worded for w in set(own))
        total, average, df = statistics
        idf = {t: math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) for w, t in self.terms.items()}
        self.classes = [Index(members, self.terms, idf, average) for members in classes.values()]

    def hits(self, texts: list[str | None], threshold: float, verify: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text number, item number) -> (score, question overlap, answer overlap) of the best verified passage."""
        words = [words_of(text) for text in texts]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not self.classes:
            return best
        found = Found(words, self.terms)
        for index in self.classes:
            for text, run, block in zip(*(x.tolist() for x in index.passages(found, threshold))):
                passage = words[text][run * index.length : (run + 2) * index.length]
                present = set(passage)
                by_size: dict[int, set] = {}
                for rank, score in index.search({self.terms[w] for w in present if w in self.terms}, block, threshold):
                    number = index.numbers[rank]
                    asked, answer = self.shingles[number], self.answers[number]
                    size = len(next(iter(asked)))
                    if size not in by_size:
                        by_size[size] = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
                    question = len(asked & by_size[size]) / len(asked)
                    answered = len(answer & present) / len(answer) if answer else 1.0
                    if min(question, answered) >= verify:
                        best[text, number] = max(best.get((text, number), (0.0, 0.0, 0.0)), (score, question, answered))
        return best


def in_chunks(column, chars: int = 1 << 19) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of an Arrow column in runs of bounded size, with the number of the first; a longer text is a run of its own."""
    begin, run, size = 0, [], 0
    for k, text in enumerate(column):
        text = text.as_py()
        if run and size + len(text or "") > chars:
            yield begin, run
            begin, run, size = k, [], 0
        run.append(text)
        size += len(text or "")
    if run:
        yield begin, run


def item_shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[list, tuple]]:
    """The items, a bounded shard at a time, as (ids, text) with each id's number of rows, and the shard's statistics."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = F.collect_list(F.struct("item_id", "n"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / SHARD_ITEMS).cast("int")),
                         lambda k: F.slice("ids", k * SHARD_ITEMS + 1, SHARD_ITEMS))
    # A text of very many ids is an item for every `SHARD_ITEMS` of them.
    texts = written(rows.groupBy("text", "item_id").agg(F.count("*").alias("n")).groupBy("text").agg(ids.alias("ids")).select(
        "text", F.posexplode(pieces).alias("piece", "ids")), "items")
    count, size = texts.agg(F.count("*"), F.sum(F.octet_length("text") + 16 * F.size("ids"))).first()
    shards = max(1, -(-count // SHARD_ITEMS), -(-(size or 0) // SHARD_BYTES))
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("text", "piece"), F.lit(shards)))

    def list_terms(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for shard, text, n in zip(*(column.to_pylist() for column in batch.columns)):
                question, answer = question_and_answer(text)
                words = question + answer
                if words:
                    out.append((shard, None, n, n * len(words)))
                    out += [(shard, word, n, 0) for word in set(words)]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "word", "n", "length"])

    copies = F.aggregate("ids", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    terms = written(texts.select("shard", "text", copies.alias("n")).mapInArrow(
        frugal(list_terms), "shard long, word binary, n long, length long").groupBy("shard", "word").agg(
        F.sum("n").alias("n"), F.sum("length").alias("length")), "items-terms")
    total, length = terms.where("word is null").agg(F.sum("n"), F.sum("length")).first()
    frequency = terms.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = written(terms.select("shard", "word").join(frequency, "word"), "items-frequencies")
    for k in range(shards):
        part = [([(i.item_id, i.n) for i in r.ids], r.text) for r in texts.where(F.col("shard") == k).collect()]
        df = {bytes(r.word): r.n for r in frequency.where(F.col("shard") == k).collect()}
        yield sorted(part, key=lambda item: item[1]), (total or 0, (length or 0) / max(1, total or 0), df)


def overlaps(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, verify: float = VERIFY,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document and test item found in it."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    result = None
    for shard_of_items in item_shards(items):
        held = context.broadcast(shard_of_items)

        def search(batches, held=held):
            import pyarrow as pa

            shard = Shard(*held.value)
            for batch in batches:
                out, ids = [], batch.column(0).to_pylist()
                for begin, texts in in_chunks(batch.column(1)):
                    hits = shard.hits(texts, threshold, verify)
                    out += [(ids[begin + k], item_id, *hits[k, n]) for k, n in sorted(hits) for item_id, rows in shard.ids[n] for _ in range(rows)]
                columns = list(zip(*out)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = rows.mapInArrow(frugal(search), schema)
        result = found if result is None else result.unionByName(found)
    return result


def without_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, verify: float = VERIFY,
                  text_col: str = "text") -> DataFrame:
    """The documents, all columns, in which no test item is found."""
    for shard_of_items in item_shards(items):
        held = docs.sparkSession.sparkContext.broadcast(shard_of_items)
        place = docs.columns.index(text_col)

        def keep(batches, held=held):
            import pyarrow as pa

            shard = Shard(*held.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for begin, texts in in_chunks(batch.column(place)):
                    clean[[begin + k for k, _ in shard.hits(texts, threshold, verify)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(frugal(keep), docs.schema)
    return docs


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
