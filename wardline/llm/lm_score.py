"""Cross-entropy difference of two n-gram models (operator 9).

A target model (trusted documents) and a background model (all documents) share one vocabulary: all words of the corpus. Both are word
bigram models; nothing is left out of either. A document's score is the mean over its tokens of (target loss - background loss), in nats:
the lower, the more like the target.

Every document is scored by models without it: its own counts are taken off both (off the target's only if it is trusted), so a score tells
likeness, not membership. Copies of a document in other rows are not taken off. The models are matched in their smoothing: in the
background one count is added for each word of the vocabulary, in the target that times its share of all tokens, so a word new to both is
equally likely. A pair has the probability (count + prior * unigram) / (followers of the first word + prior), with PRIOR in the background
and its share in the target: what was seen once does not take all mass, and new continuations cost some.

Blocks of documents list their distinct words and pairs of neighbours by 64-bit hashes, with their counts. Shards of hash ranges bring equal ones
of all blocks together, where counts are summed; the sums go back to the blocks in the order of their lists, and tokens are looked up
by position. Texts cross the network once, compressed. A pair that fills a third of the corpus is one entry per block, and shards grow
in number with the blocks; the driver holds no counts. Only rows equal in id and text all fall into one block, however many they are.

All words are lower-cased `[^\\x20\\x09-\\x0D]+`. A sentence start stands before the first word. Null and empty texts have no token and score 0.
Trusted documents are all those labelled good by each of their rows; without any, the models are equal and all scores 0.
Repeated rows count as often as they stand in the table and get equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.registry import query
from wardline.llm.common import block_count, block_of, compressed_blocks, frugal_group, id_and_text, ids_of, mix, unpacked
from wardline.llm.quality import in_chunks
from wardline.llm.rules import Words, trusted_ids

# Tokens that the unigram stands for beside a context's own followers (Dirichlet prior of the bigram).
PRIOR = 64.0
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_START = np.uint64(0x9E3779B97F4A7C15)  # stands before the first word


class Block:
    """The distinct words and pairs of neighbours of some texts as sorted hashes, and the places of each token's in them."""

    def __init__(self, texts: list[bytes]):
        parts = [Words([text.translate(_LOWER) for text in run]) for run in in_chunks(texts)]
        token = np.concatenate([np.zeros(0, np.uint64), *(p.hash for p in parts)])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *(p.count for p in parts)])
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        last = np.cumsum(self.sizes)[self.sizes > 0] - 1
        first = last + 1 - self.sizes[self.sizes > 0]
        before = np.roll(token, 1)
        before[first] = _START
        with np.errstate(over="ignore"):
            self.pairs, self.pair = np.unique(mix(before * np.uint64(0xD6E8FEB86659FD93) + token), return_inverse=True)
        self.words, place = np.unique(np.append(token, _START), return_inverse=True)
        self.word, start = place[:-1], place[-1]
        self.before = np.roll(self.word, 1)
        self.before[first] = start
        self.last = last
        self.start = start

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token, how often its text has its word, the word before it as one before another, and the pair."""
        found = []
        for place, n in ((self.word, len(self.words)), (self.before, len(self.words)), (self.pair, len(self.pairs))):
            _, at, count = np.unique(self.text * n + place, return_inverse=True, return_counts=True)
            found.append(count[at])
        return tuple(found)

    def counts(self, trusted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(raw, target) of all words and of pairs; words also have how often less than that they were followed by another."""
        good = trusted[self.text]
        n, words, pairs = len(self.words), [], []
        ends = []
        for some in (np.ones(len(good), bool), good):
            words.append(np.bincount(self.word[some], minlength=n))
            pairs.append(np.bincount(self.pair[some], minlength=len(self.pairs)))
            last = self.last[some[self.last]]
            ends.append(np.bincount(self.word[last], minlength=n))
            ends[-1][self.start] -= len(last)  # the sentence start is no token, and always followed
        return np.array(words + ends), np.array(pairs)


def packed_list(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as differences, equal bytes of all together, and their counts."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    planes = steps.view(np.uint8).reshape(len(steps), 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + counts.astype("<i4").tobytes())


def unpacked_list(packed: bytes, columns: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n = len(data) // (8 + 4 * columns)
    steps = np.ascontiguousarray(data[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), data[8 * n :].view("<i4").reshape(columns, n)


def summed(lists: list[bytes], columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sums of equal hashes' counts over all lists (columns, distinct hashes), and the places of each list's hashes in them."""
    parts = [unpacked_list(packed, columns) for packed in lists]
    _, place = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    counts = np.concatenate([c for _, c in parts], axis=1)
    total = np.array([np.bincount(place, column) for column in counts]).astype(np.int64)  # sums below 2^53 are exact
    return total, np.split(place, np.cumsum([len(h) for h, _ in parts])[:-1])


def token_losses(block: Block, trusted: np.ndarray, words: np.ndarray, pairs: np.ndarray, tokens: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(target, background) losses of a block's tokens, from the corpus's counts of its words and pairs less those of each token's own text.

    `trusted` tells for each text whether it is part of the target, `tokens` are the raw and target tokens of the corpus, `kinds` its distinct words.
    """
    own_word, own_before, own_pair = block.own()
    size = block.sizes[block.text]
    out = []
    for k in (1 if tokens[1] else 0, 0):  # without trusted texts both models are equal
        inside = trusted[block.text] if k else np.ones(len(size), bool)
        others = tokens[k] - size * inside
        share = np.maximum(1, others) / np.maximum(1, tokens[0] - size)
        unigram = (words[k][block.word] - own_word * inside + share) / (others + share * kinds)
        followed = (words[k] - words[k + 2])[block.before] - own_before * inside
        out.append(-np.log((pairs[k][block.pair] - own_pair * inside + PRIOR * share * unigram) / (followed + PRIOR * share)))
    return out[0], out[1]


def score(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row; `trusted` has the ids of trusted documents (column `id`)."""
    rows = id_and_text(docs, id_col, text_col)
    blocks = block_count(rows)
    dealt = compressed_blocks(rows, blocks).repartition(F.col("block"))
    # Trusted ids grow with the corpus, so both sides are shuffled, at every size alike.
    places = rows.where("doc_id is not null").select("doc_id", block_of(blocks).alias("block")).distinct()
    good = places.join(trusted.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id").select(
        "block", F.col("doc_id").cast("string").alias("good"))
    shards = max(64, blocks // 4)

    def edges(hashes):
        inner = np.searchsorted(hashes.astype(np.float64) * (shards / 2.0**64), np.arange(1, shards))
        return [0, *inner.tolist(), len(hashes)]

    def list_counts(key, texts, good):
        import pandas as pd

        if not len(texts):
            return pd.DataFrame({"block": [], "shard": [], "words": [], "pairs": []})
        block, known = Block(unpacked(texts["packed"])), set(good["good"])
        counts = block.counts(np.array([i in known for i in texts["doc_id"]], bool))
        lists = []
        for hashes, table in zip((block.words, block.pairs), counts):
            at = edges(hashes)
            lists.append([packed_list(hashes[a:b], table[:, a:b]) for a, b in zip(at, at[1:])])
        # Empty lists go out, too: every block needs every shard's sums.
        return pd.DataFrame({"block": np.int32(key[0]), "shard": np.arange(shards, dtype=np.int32), "words": lists[0], "pairs": lists[1]})

    def sum_shard(key, group):
        import pandas as pd

        press = zstandard.ZstdCompressor(level=1)
        words, places = summed(list(group["words"]), 4)
        sums = np.array([(words[0] > 0).sum(), words[0].sum(), words[1].sum()])
        words = [press.compress(np.append(sums, words[:, at]).astype("<i8").tobytes()) for at in places]
        pairs, places = summed(list(group["pairs"]), 2)
        pairs = [press.compress(pairs[:, at].astype("<i8").tobytes()) for at in places]
        return pd.DataFrame({"block": group["block"], "shard": np.int32(key[0]), "words": words, "pairs": pairs})

    def look(key, texts, parts):
        import pandas as pd

        known = {i.decode() for i in parts["words"][parts["shard"] < 0]}
        trusted = np.array([i in known for i in texts["doc_id"]], bool)
        parts = parts[parts["shard"] >= 0].sort_values("shard")
        block = Block(unpacked(texts["packed"]))
        words = [np.frombuffer(part, "<i8") for part in unpacked(parts["words"])]
        kinds, *tokens = np.sum([part[:3] for part in words], axis=0)
        words = np.concatenate([part[3:].reshape(4, -1) for part in words], axis=1)
        pairs = np.concatenate([np.frombuffer(part, "<i8").reshape(2, -1) for part in unpacked(parts["pairs"])], axis=1)
        target, background = (np.bincount(block.text, losses, len(texts)) / np.maximum(1, block.sizes)
                              for losses in token_losses(block, trusted, words, pairs, tokens, kinds))
        return pd.DataFrame({"doc_id": pd.array(ids_of(texts["doc_id"]), "Int64"), "n_tokens": block.sizes,
                             "target_loss": target, "background_loss": background, "score": target - background})

    lists = "block int, shard int, words binary, pairs binary"
    counts = (
        dealt.groupBy("block").cogroup(good.groupBy("block")).applyInPandas(frugal_group(list_counts), lists)
        .groupBy("shard").applyInPandas(frugal_group(sum_shard), lists)
    )
    # A cogroup has two sides only: trusted ids of a block come with its sums, as rows of no shard.
    counts = counts.unionByName(good.select("block", F.lit(-1).alias("shard"), F.encode("good", "UTF-8").alias("words"), F.lit(b"").alias("pairs")))
    return (
        dealt.groupBy("block").cogroup(counts.groupBy("block"))
        .applyInPandas(frugal_group(look), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
    )


@query("op9_lm_score")
def op9_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return score(docs, trusted_ids(spark.read.parquet(f"{folder}/labels.parquet")))
