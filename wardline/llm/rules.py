"""Quality rules with a hashed n-gram log-likelihood ratio (operator 8).

Words and word pairs are hashed to `BUCKETS` features. Two multinomials are estimated over them: the target from trusted documents, the raw
one from the counts of all documents, summed by Spark. A document's score is the sum of its features' log ratios divided by their
number, so length does not matter; it is kept from a fixed `threshold` on. Beside this stand base rules on lengths, symbols,
repeated lines and repeated five-word windows, all over whole texts and found with exact counts.

The target is smoothed by the raw model (`PRIOR` pseudo-counts), so a feature unseen in it is unlikely, not impossible. Trusted rows are
those of all documents labelled good by each of their rows; a shuffle join marks them.

Null and empty texts have no words and fail the base rules; their score is 0. Without trusted documents every ratio is 0. Repeated rows
count as often as they stand in the table and get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.registry import query
from wardline.llm.common import PrefixHash, frugal, id_and_text, mix, word_spans
from wardline.llm.quality import in_chunks

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
PRIOR = 20_000.0
THRESHOLD = -0.2
WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


class Words:
    """The words of some texts: which text each belongs to, and its hash."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, self.n)
        self.begins = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        self.starts, self.ends = word_spans(self.data)
        self.text = np.searchsorted(self.begins, self.starts, "right") - 1
        self.count = np.bincount(self.text, minlength=self.n)
        self.table = PrefixHash(self.data)
        self.hash = mix(self.table.slices(self.starts, self.ends))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of every word and every pair of neighbours."""
        pair = self.text[1:] == self.text[:-1]
        with np.errstate(over="ignore"):
            pairs = mix(self.hash[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.hash[1:])[pair]
        shift = np.uint64(64 - BUCKET_BITS)
        return (np.concatenate((self.text, self.text[1:][pair])),
                np.concatenate((self.hash >> shift, pairs >> shift)).astype(np.int64))

    def base(self) -> dict[str, np.ndarray]:
        """Exact counts of the base rules for each text."""
        of_byte = np.repeat(np.arange(self.n), self.sizes + 1)[: len(self.data)]
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.starts] = 1
        inside[self.ends] -= 1
        in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        lead = (self.data & 0xC0) != 0x80
        ends = np.flatnonzero(np.append(self.data == 10, True))
        starts = np.concatenate(([0], ends[:-1] + 1))
        worded = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[worded], ends[worded]
        line_text = np.searchsorted(self.begins, starts, "right") - 1
        with np.errstate(over="ignore"):
            lines = mix(mix(self.table.slices(starts, ends)) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, sample = np.unique(lines, return_index=True)
        repeats = np.bincount(line_text, minlength=self.n) - np.bincount(line_text[sample], minlength=self.n)
        return {
            "word_chars": np.bincount(of_byte[in_word & lead], minlength=self.n),
            "n_symbols": np.bincount(of_byte[_SYMBOL[self.data]], minlength=self.n),
            "n_dup_lines": repeats,
            "n_repeat_words": self._repeat_words(),
        }

    def _repeat_words(self) -> np.ndarray:
        n = len(self.hash) - WINDOW + 1
        if n <= 0:
            return np.zeros(self.n, np.int64)
        at = np.flatnonzero(self.text[:n] == self.text[WINDOW - 1 :])
        with np.errstate(over="ignore"):
            windows = self.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for k in range(WINDOW):
                windows = windows * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + k]
        _, place, count = np.unique(mix(windows), return_inverse=True, return_counts=True)
        again = at[count[place] > 1]
        change = np.zeros(len(self.hash) + 1, np.int64)
        np.add.at(change, again, 1)
        np.add.at(change, again + WINDOW, -1)
        return np.bincount(self.text[np.cumsum(change[:-1]) > 0], minlength=self.n)


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, raw, target): feature counts of all documents and of the trusted ones (column `id`)."""

    def count(batches):
        import pyarrow as pa

        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            known = np.array(batch.column(0).to_pylist(), bool)
            at = 0
            for run in in_chunks(batch.column(1).cast(pa.binary()).to_pylist()):
                text, bucket = Words(run).features()
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[known[at : at + len(run)][text]], minlength=BUCKETS)
                at += len(run)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    rows = id_and_text(docs, id_col, text_col)
    # Trusted ids grow with the corpus, so both sides are shuffled, at every size alike.
    good = trusted.select(F.col("id").alias("doc_id"), F.lit(True).alias("good")).distinct()
    named, nameless = rows.where("doc_id is not null"), rows.where("doc_id is null")
    marked = named.join(good.hint("merge"), "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("trusted"), "text").unionByName(
        nameless.select(F.lit(False).alias("trusted"), "text"))
    return marked.mapInArrow(frugal(count), "bucket int, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled good and not toxic by every one of their rows."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 and coalesce(toxic, 0) = 0").select("id")


def log_ratios(counts: DataFrame, prior: float = PRIOR) -> np.ndarray:
    """Log of target over raw probability of each bucket; `BUCKETS` numbers."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.collect():  # one row per bucket at most
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    if not target.sum():
        return np.zeros(BUCKETS)
    background = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + prior * background) / (target.sum() + prior)) - np.log(background)


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base counts, base_failed, llr, kept) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            parts = []
            for run in in_chunks(batch.column(1).cast(pa.binary()).to_pylist()):
                words = Words(run)
                text, bucket = words.features()
                features = np.maximum(1, np.bincount(text, minlength=words.n))
                parts.append({"n_words": words.count, **words.base(),
                              "llr": np.bincount(text, shared.value[bucket], words.n) / features})
            columns = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {
                k: np.zeros(0) for k in [*longs, "llr"]}
            failed = (columns["n_words"] < 10) | (100 * columns["n_repeat_words"] > 20 * columns["n_words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(columns[k].astype(np.int64)) for k in longs), pa.array(failed),
                 pa.array(columns["llr"].astype(np.float64)), pa.array(~failed & (columns["llr"] >= threshold))],
                ["doc_id", *longs, "base_failed", "llr", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in longs) + ", base_failed boolean, llr double, kept boolean"
    return id_and_text(docs, id_col, text_col).mapInArrow(frugal(look), schema)


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    trusted = trusted_ids(spark.read.parquet(f"{folder}/labels.parquet"))
    return judge(docs, log_ratios(bucket_counts(docs, trusted)))
