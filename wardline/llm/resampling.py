"""Importance resampling towards a target text by hashed n-grams (operator 12).

Features are runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo `BUCKETS`. The buckets of all documents and of the
target give each bucket a gain (the floor of 1000 times a smoothed log ratio), a document's weight is the sum of its features' gains, and Gumbel noise
drawn from its id makes the greatest scores a sample without replacement in proportion to exp(weight / 1000).

CRCs are computed for distinct features only, in matrices: a chunk's words are numbered, pairs and triples are numbered from these, and one sample of
each distinct feature is taken as a slice of the words joined by single spaces. Slices of equal length form a matrix of bytes, and one vector step
per column updates the CRCs of all its rows; the buckets are scattered back to the places of the features. Matrices are cut into slabs of
`SLAB_BYTES`; features of more than `LONG_FEATURE` bytes, of which a matrix would have one row, are given to zlib.

Two passes read the texts, neither shuffles them: tasks add up their bucket counts (at most `BUCKETS` rows each go out), then the gains, one number per bucket, are
broadcast. Ranks come from a range-partitioned sort of (score, id) over narrow rows: the rows before a range are known from the counts of the ranges.

Null and empty texts have no words and weight 0. Rows without an id draw the noise of the text `42:` and come last among equal scores; repeated rows take
places of their own, in any order. Without target texts all gains still follow the formula. An empty table gives no rows. Words that follow each other beyond marks and line ends are neighbours.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.catalog.registry import query
from wardline.llm.common import frugal, id_and_text
from wardline.workdir import written

BUCKETS, LONGEST_RUN = 10_000, 3
MIN_WORDS, DRAWN_PERCENT = 20, 5
SEED = 42
CHUNK_BYTES, SLAB_BYTES, LONG_FEATURE = 4 << 20, 4 << 20, 1024
RANGE_ROWS = 1 << 18
# A to Z in lower case; what is no word character becomes a space.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_POLYNOMIAL = 0xEDB88320
_table = None


def crc_table() -> np.ndarray:
    """The CRC-32 of every single byte's register, by eight shifts of the reflected polynomial."""
    global _table
    if _table is None:
        register = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            register = np.where(register & np.uint32(1), register >> np.uint32(1) ^ np.uint32(_POLYNOMIAL), register >> np.uint32(1))
        _table = register
    return _table


def crc_of_slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each slice of `data`, length by length in matrices of bytes."""
    table, out = crc_table(), np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, edges):
        length = int(lengths[rows[0]]) if len(rows) else 0
        if length > LONG_FEATURE:
            view = memoryview(data)
            for row in rows.tolist():
                out[row] = zlib.crc32(view[starts[row] : starts[row] + length])
            continue
        slab = max(1, SLAB_BYTES // max(1, length))
        for at in range(0, len(rows), slab):
            part = rows[at : at + slab]
            # One row of the matrix holds one byte of all features: columns of the features, contiguous for the update.
            matrix = data[np.arange(length)[:, None] + starts[part]]
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = table[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            out[part] = ~crc
    return out


class Features:
    """The features of some texts: how many words each text has, and of every feature its text and its bucket."""

    def __init__(self, texts: list[bytes], buckets: int = BUCKETS):
        words = [text.translate(_NORMAL).split(b" ") for text in texts]
        words = [[w for w in some if w] if b"" in some else some for some in words]
        self.words = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        n = len(flat)
        ids: dict[bytes, int] = {}
        number = np.fromiter((ids.setdefault(w, len(ids)) for w in flat), np.int64, n)
        # All words joined by single spaces: every feature is a slice of this.
        data = np.frombuffer(b" ".join(flat), np.uint8)
        sizes = np.fromiter(map(len, flat), np.int64, n)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.repeat(np.arange(len(texts)), self.words)
        of_text, of_bucket = [], []
        kinds, run = len(ids), number
        for length in range(1, LONGEST_RUN + 1):
            if length > 1:
                # A run's number: that of the run without its last word, and that word's. Runs end with their text.
                at = np.flatnonzero(text[: n - length + 1] == text[length - 1 :]) if n >= length else np.zeros(0, np.int64)
                run_at = run[at] * len(ids) + number[at + length - 1]
            else:
                at, run_at = np.arange(n), number
            _, sample, place = np.unique(run_at, return_index=True, return_inverse=True)
            begin, last = starts[at[sample]], at[sample] + length - 1
            crc = crc_of_slices(data, begin, starts[last] + sizes[last] - begin) if len(sample) else np.zeros(0, np.uint32)
            of_text.append(text[at])
            of_bucket.append((crc % np.uint32(buckets)).astype(np.int64)[place])
            kinds = len(sample)
            run = np.zeros(n, np.int64)
            run[at] = place
        self.text, self.bucket = np.concatenate(of_text), np.concatenate(of_bucket)
        self.n = np.bincount(self.text, minlength=len(texts))


def chunks(column) -> list[bytes]:
    """The texts of an Arrow column in runs of about `CHUNK_BYTES`."""
    texts, size = [], 0
    for value in column:
        texts.append(value.as_buffer().to_pybytes())
        size += len(texts[-1])
        if size >= CHUNK_BYTES:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all texts by bucket."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in chunks(batch.column(0).cast(pa.binary())):
                total += np.bincount(Features(texts, buckets).bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(frugal(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, from two tables of counts."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for table, numbers in ((raw, s), (target, t)):
        for row in table.collect():  # one row per bucket at most
            numbers[row.bucket] = row.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [np.zeros((3, 0), np.int64)]
            for texts in chunks(batch.column(1).cast(pa.binary())):
                found = Features(texts, len(shared.value))
                # Sums of gains stay far below 2^53, so doubles hold them exactly.
                total = np.bincount(found.text, shared.value[found.bucket], len(texts)).astype(np.int64)
                parts.append(np.array([found.words, found.n, total]))
            columns = np.concatenate(parts, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight"])

    return id_and_text(docs, id_col, text_col).mapInArrow(frugal(look), "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`scored` (written) with `rank`: places from 1 by score descending, then id ascending, counted over all rows.

    Rows are dealt by ranges of that order; a row's rank is the number of rows in ranges before its own and its place in it.
    """
    # The place in the table parts rows that are equal in score and id, so that a range can end between them.
    placed = scored.withColumn("place", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    dealt = placed.repartitionByRange(max(2, -(-scored.count() // range_rows)), *order)
    dealt = written(dealt.withColumn("range", F.spark_partition_id()), "resampling-ranges")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    # One row for a range.
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "range").select(
        *scored.columns, (F.col("before") + F.col("inside")).cast("long").alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = DRAWN_PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; `rank` is null for those not drawn.

    Of the N rows with at least `min_words` words, the floor(percent * N / 100) greatest scores are drawn.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    weighed = weights(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = written(weighed, "resampling-scores")
    can_be = F.col("n_words") >= min_words
    drawn = scored.where(can_be).count() * percent // 100
    places = ranked(scored.where(can_be)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.where(~can_be).withColumn("rank", F.lit(None).cast("long"))
    return places.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_importance_resampling")
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target)
