"""Language identification by rank-order profiles (operator 1).

A profile is the list of a language's most frequent letter n-grams (1 to 3 characters, words with their edges), learned from all
training texts: tasks count n-grams, Spark sums the counts. A text is ranked the same way and compared to each
profile by the out-of-place distance: the sum of rank differences, with the profile's length for n-grams it lacks. The
nearest language wins; ties go to the alphabetically first. Profiles are `size` n-grams for each language (as many as languages,
which labels bound), so they are broadcast.

The score is the second distance's share of the first two (0.5: undecided, 1: certain); with one language only it is the share of
ranks found. A null text, or one without a letter, is `und` with score 0, as is every text if nothing could be learned.
Training rows with a null text or language are left out. Ties between n-grams are ordered by length, then letters. Repeated rows get equal results.
Whole texts are counted, however long; an empty table gives no rows. In the query a row without an id is predicted, never learned from, and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.catalog.registry import query
from wardline.llm.common import frugal
from wardline.llm.bpe import LETTER, character_classes
from wardline.llm.quality import remainder

PROFILE = 400
_PIECE = 1 << 20
_FLUSH = 200_000
_BITS, _EDGE = 21, 95  # a code point takes 21 bits; "_" stands for the edges of a word


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text as packed code points, a piece of a million characters at a time (cut at a space if there is one)."""
    begin = 0
    while begin < len(text):
        end = begin + _PIECE
        end = len(text) if end >= len(text) else text.rfind(" ", begin + 1, end) + 1 or end
        codes = np.frombuffer(text[begin:end].lower().encode("utf-32-le"), np.uint32)
        begin = end
        letter = character_classes()[codes] == LETTER
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        words = np.where(letter, codes, _EDGE)[keep].astype(np.int64)
        if not len(words):
            continue
        edge = np.array([_EDGE])
        words = np.concatenate((edge, words, edge[: int(words[-1] != _EDGE)]))
        two = words[:-1] << _BITS | words[1:]
        three = two[:-1] << _BITS | words[2:]
        yield np.concatenate((words[words != _EDGE], two, three[words[1:-1] != _EDGE]))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal codes added up."""
    if len(parts) == 1:
        return parts[0]
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes in order, counts) of a whole text; empty if it has no letter."""
    parts = [np.unique(codes, return_counts=True) for codes in gram_codes(text)]
    return merged(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) from rows (lang, text): the `size` most frequent n-grams (packed) of each language, ranked from 0."""

    def count(batches):
        import pyarrow as pa

        def rows(lang, parts):
            codes, n = merged(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = held.setdefault(lang, [])
                parts.append(gram_counts(text.as_py()))
                if sum(len(codes) for codes, _ in parts) > 2 * _FLUSH:
                    held[lang] = [merged(parts)]
                    if len(held[lang][0][0]) > _FLUSH:
                        yield rows(lang, held.pop(lang))
        for lang, parts in held.items():
            yield rows(lang, parts)

    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = rows.mapInArrow(frugal(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The bare row number is compared, so that Spark limits each language's rows before it shuffles and sorts them.
    best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    return best.select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Profiles:
    """Profiles as one table: a row of ranks for each n-gram, a column for each language; -1 where it is missing."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.size = size
        column = {lang: k for k, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([gram for _, gram, _ in rows], np.int64))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int64)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), column[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text or "")
        if not self.langs or not len(codes):
            return "und", 0.0
        if len(codes) > self.size:
            last = np.partition(counts, len(counts) - self.size)[len(counts) - self.size]
            pick = counts >= last
            codes, counts = codes[pick], counts[pick]
        top = codes[np.argsort(-counts, kind="stable")[: self.size]]  # codes are in order, so ties are too
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == top)[:, None], self.ranks[at], -1)
        distance = np.where(ranks >= 0, np.abs(ranks - np.arange(len(top))[:, None]), self.size).sum(0)
        best = int(distance.argmin())
        nearest = int(distance[best])
        if len(self.langs) == 1:
            return self.langs[0], 1 - nearest / (self.size * len(top))
        second = int(np.partition(distance, 1)[1])
        return self.langs[best], second / (nearest + second) if nearest + second else 0.5


def identify(docs: DataFrame, profile_rows: DataFrame, size: int = PROFILE, text_col: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (default all), `lang_pred` and `score`."""
    table = Profiles([tuple(r) for r in profile_rows.collect()], size)  # at most `size` rows for each language
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = [c for c in docs.columns if (keep is None or c in keep) and c.lower() not in ("lang_pred", "score")]
    rest = docs.select(*[F.col(f"`{c}`") for c in names])
    n = len(names)
    place = names.index(text_col) if text_col in names else n
    given = rest if place < n else docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias("__text"))

    def predict(batches):
        import pyarrow as pa

        for batch in batches:
            found = [shared.value.predict(text.as_py()) for text in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [*batch.schema.names[:n], "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return given.mapInArrow(frugal(predict), T.StructType([*rest.schema.fields, *added]))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    learned = profiles(docs.where(remainder(F.col("doc_id"), 4) != 2))
    found = identify(docs.select("doc_id", "text"), learned, keep=["doc_id"])
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
