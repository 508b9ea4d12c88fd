"""Byte-level BPE (operator 2): every distinct pre-token of the corpus is encoded once, after a shuffle of words.

Blocks of documents list their distinct pre-tokens in the order of a hash, so a word's position is its place in its block's list.
The lists are cut into shards of hash ranges; a shuffle brings the equal shards of all blocks together, where every distinct
word is encoded once; the ids go back to the blocks, and the texts are put together again by position. Texts cross the
network once, compressed. What the word shuffle carries is bounded by the distinct words of each block, so a word that
fills a third of the corpus is one entry per block; shards grow in number with the blocks. Decoding looks every id up in the
token-byte table.

Null text is encoded as the empty text (no ids). Repeated rows give one result each; null ids stay null. An empty
table gives no rows. Very long texts are a block of their own.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Callable
from itertools import chain

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.registry import query
from wardline.llm.common import block_count, compressed_blocks, frugal, frugal_group, id_and_text, ids_of, mix, unpacked

_SPACE, LETTER, _NUMBER, _OTHER, _BREAK = range(5)
# The endings that the pattern's contractions allow.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_END = 0x110000  # stands between texts; no character has this code
_CHUNK = 1 << 19
_LONG = 256
_classes = None
_weights = None


def character_classes() -> np.ndarray:
    """The class of every code point, as the pattern's \\s, \\p{L} and \\p{N} see it."""
    global _classes
    if _classes is None:
        import regex

        every = "".join(map(chr, (c for c in range(_END) if not 0xD800 <= c < 0xE000)))
        table = np.full(_END + 1, _OTHER, np.uint8)
        table[_END] = _BREAK
        for kind, pattern in ((_SPACE, r"\s+"), (LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
        _classes = table
    return _classes


def token_starts(codes: np.ndarray) -> np.ndarray:
    """Where the matches of the pre-tokenizer's pattern start, found from runs of character classes.

    A run of letters, numbers or other characters is one match, with the plain space before it. Of a longer run of
    white space before something else, all but the last character is a match. A contraction ends at its last letter.
    """
    kind = character_classes()[codes]
    space, stop = kind == _SPACE, kind == _BREAK
    starts = np.ones(len(codes), bool)
    starts[1:] = (kind[1:] != kind[:-1]) & ((codes[:-1] != 32) | stop[1:])
    starts[:-1] |= space[:-1] & ~space[1:] & ~stop[1:]
    end = 0
    for at in np.flatnonzero((codes == 39) & starts).tolist():
        if at < end:
            continue
        following = "".join(chr(c) if c < _END else "\n" for c in codes[at + 1 : at + 3].tolist())
        for tail in _CONTRACTIONS:
            if following.startswith(tail):
                end = at + 1 + len(tail)
                starts[at + 1 : end] = False
                starts[end : end + 1] = True
                break
    return starts


def _token_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each token (rows)."""
    global _weights
    if _weights is None:
        _weights = np.random.default_rng(1).integers(0, 1 << 64, (2, _LONG), np.uint64) | np.uint64(1)
    offset = np.arange(len(codes), dtype=np.int32) - np.repeat(starts.astype(np.int32), ends - starts)
    np.minimum(offset, _LONG - 1, out=offset)
    with np.errstate(over="ignore"):
        symbols = codes.astype(np.uint64) + np.uint64(1)
        both = np.stack([mix(np.add.reduceat(symbols * w[offset], starts)) for w in _weights])
    for at in np.flatnonzero(ends - starts > _LONG):
        import xxhash

        whole = codes[starts[at] : ends[at]].tobytes()
        both[:, at] = xxhash.xxh64_intdigest(whole, 1), xxhash.xxh64_intdigest(whole, 2)
    return both


def distinct_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[], list[str]]]:
    """Of the texts' pre-tokens: how many each text has, the place of each in the list of distinct ones, these ones' hashes, and the list.

    The list is in the order of a hash of its words, so it depends on the set of words alone.
    """
    chunks, sizes, hashes, per_text = [], [], [], []
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) < _CHUNK):
            size, end = size + len(texts[end]), end + 1
        strings = [t.decode() for t in texts[begin:end]]
        codes = np.frombuffer(b"".join(t.encode("utf-32-le") + b"\0\0\x11\0" for t in strings), np.uint32)
        starts = np.flatnonzero(token_starts(codes))
        both = _token_hashes(codes, starts, np.append(starts[1:], len(codes)))
        real = codes[starts] != _END
        # The breaks of texts without tokens follow each other; each ends the text it stands for.
        breaks = np.flatnonzero(codes == _END)
        per_text.append(np.diff(np.searchsorted(starts[real], breaks), prepend=0))
        chunks.append(("\n".join([*strings, ""]), *(x[real].astype(np.int32) for x in (starts, np.append(starts[1:], len(codes))))))
        hashes.append(both[:, real])
        sizes.append(int(real.sum()))
        begin = end
    counts = np.concatenate(per_text) if per_text else np.zeros(0, np.int64)
    first, second = np.concatenate(hashes, axis=1) if hashes else np.zeros((2, 0), np.uint64)
    known, sample, place = np.unique(first, return_index=True, return_inverse=True)
    bounds = [0, *np.cumsum(sizes).tolist()]

    def word(at: int) -> str:
        k = bisect_right(bounds, at) - 1
        chunk, starts, ends = chunks[k]
        at -= bounds[k]
        return chunk[starts[at] : ends[at]]

    if not np.array_equal(second[sample][place], second):  # two words share a hash: compare the words themselves
        words, place = np.unique([word(i) for i in range(len(first))], return_inverse=True)
        return counts, place, np.linspace(0, 1 << 63, len(words)).astype(np.uint64), words.tolist
    return counts, place, known, lambda: [word(i) for i in sample.tolist()]


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank. Its size is that of the tokenizer, not of the data."""
    if path.startswith("/"):
        with open(path, "rb") as lines:
            rows = lines.read().split(b"\n")
    else:
        rows = [r.value.encode() for r in spark.read.text(path).collect()]
    return {base64.b64decode(token): int(rank) for token, rank in (row.split() for row in rows if row.strip())}


def word_encoder(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """The merges of one pre-token: the pattern of this encoding takes its whole input as one match."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as a row-wise encoder without special tokens would give them."""
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    ranks = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))
    blocks = block_count(rows)
    dealt = compressed_blocks(rows, blocks).repartition(F.col("block"))

    shards = max(64, blocks // 16)

    def list_words(key, group):
        import pandas as pd

        *_, hashes, words = distinct_tokens(unpacked(group["packed"]))
        words = [w.encode() for w in words()]
        # Equal words of all blocks fall into equal shards; the shards of a block follow the order of its list.
        edges = np.searchsorted(hashes.astype(np.float64) * (shards / 2.0**64), np.arange(shards + 1)).tolist()
        press = zstandard.ZstdCompressor(level=5)
        parts = [(k, press.compress(b"\xff".join(words[a:b]))) for k, (a, b) in enumerate(zip(edges, [*edges[1:-1], len(words)])) if a < b]
        return pd.DataFrame({"block": np.int32(key[0]), "shard": [k for k, _ in parts], "words": [w for _, w in parts]})

    def encode_shard(key, group):
        import pandas as pd

        encode_word, known = word_encoder(ranks.value), {}
        press, out = zstandard.ZstdCompressor(level=5), []
        for words in unpacked(group["words"]):
            words = words.split(b"\xff")
            for word in words:
                if word not in known:
                    known[word] = encode_word(word.decode())
            ids = [known[word] for word in words]
            sizes = np.fromiter(map(len, ids), "<u4", len(ids))
            flat = np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum()))
            out.append(press.compress(np.concatenate((np.array([len(ids)], "<u4"), sizes, flat)).tobytes()))
        return pd.DataFrame({"block": group["block"], "shard": np.int32(key[0]), "ids": out})

    def put_together(key, texts, words):
        import pandas as pd

        parts = [np.frombuffer(part, "<u4") for part in unpacked(words.sort_values("shard")["ids"])]
        none = [np.zeros(0, "<u4")]
        size = np.concatenate([part[1 : 1 + part[0]] for part in parts] or none).astype(np.int64)
        flat = np.concatenate([part[1 + part[0] :] for part in parts] or none).astype(np.int32)
        first = np.cumsum(size) - size
        n_tokens, place, *_ = distinct_tokens(unpacked(texts["packed"]))
        out = []
        for at in np.split(place, np.cumsum(n_tokens)[:-1]):
            n = size[at]
            where = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(flat[where])
        return pd.DataFrame({"doc_id": pd.array(ids_of(texts["doc_id"]), "Int64"), "ids": out})

    words = (
        dealt.groupBy("block").applyInPandas(frugal_group(list_words), "block int, shard int, words binary")
        .groupBy("shard").applyInPandas(frugal_group(encode_shard), "block int, shard int, ids binary")
    )
    return (
        dealt.select("block", "doc_id", "packed").groupBy("block").cogroup(words.groupBy("block"))
        .applyInPandas(frugal_group(put_together), "doc_id long, ids array<int>")
    )


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns and `decoded` (binary): the bytes of the ids joined. Null ids give null; an unknown id is an error."""
    spark = encoded.sparkSession
    table = spark.sparkContext.broadcast({rank: token for token, rank in read_ranks(spark, ranks_path).items()})

    def look_up(batches):
        import pyarrow as pa

        tokens = table.value
        by_rank = np.full(max(tokens, default=-1) + 1, None, object)
        by_rank[list(tokens)] = list(tokens.values())
        for batch in batches:
            # One row at a time: the bytes of a batch of long texts would be millions of objects.
            lists = batch.column(batch.schema.get_field_index(ids_col))
            decoded = [b"".join(by_rank[ids.values.to_numpy()].tolist()) if ids.is_valid else None for ids in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())],
                                             [*batch.schema.names, "decoded"])

    if "decoded" in encoded.columns:
        raise ValueError("the input already has a column `decoded`")
    schema = encoded.select("*", F.lit(b"").cast("binary").alias("decoded")).schema
    return encoded.mapInArrow(frugal(look_up), schema)


def digests(decoded: DataFrame) -> DataFrame:
    """Token count and digests of ids and decoded bytes."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return digests(decode(encode(docs, ranks_file()), ranks_file()))
