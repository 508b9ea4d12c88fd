"""What several operators share: column hygiene, compressed texts dealt into blocks, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows that a task turns into Python objects at once.
BATCH_ROWS = 1000
# Text per block of documents: bounds what one Python worker holds, whatever the size of the corpus.
BLOCK_BYTES = 4_000_000


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and an executor's memory is shared by several."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def frugal(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For `mapInArrow`: the function, in pieces of `BATCH_ROWS` rows, returning memory at its end."""

    def run(batches):
        yield from function(batch.slice(k, BATCH_ROWS) for batch in batches for k in range(0, batch.num_rows, BATCH_ROWS))
        give_back()

    return run


def frugal_group(function: Callable) -> Callable:
    """For `applyInPandas` on groups, plain or together: the function, returning memory after each group."""
    count = function.__code__.co_argcount
    if count == 1:
        def run(group):
            out = function(group)
            give_back()
            return out
    elif count == 2:
        def run(key, group):
            out = function(key, group)
            give_back()
            return out
    else:
        def run(key, group, other):
            out = function(key, group, other)
            give_back()
            return out
    return run


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """Only the columns an operator reads, so that no other column can clash with its own; null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[c.alias(name) for name, c in more.items()],
    )


def block_count(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks needed for all texts: grows with their bytes, so a block stays the same size."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(6, -(-total // block_bytes))


def block_of(blocks: int) -> Column:
    """The block that a row of `id_and_text` is dealt to."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")


def compressed_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, text) -> (block, doc_id, packed): texts compressed and dealt evenly by content; ids as text.

    The only shuffle of texts. Null and repeated ids are spread too, since the text is part of the key.
    """

    def pack(batches):
        import pyarrow as pa

        press = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            texts = batch.column(1)
            packed = pa.array([press.compress(t.as_buffer()) for t in texts.cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), packed], ["block", "doc_id", "packed"])

    # Pandas would make a column of longs with a null one of doubles, and long ids inexact.
    return rows.select(F.col("doc_id").cast("string"), "text", block_of(blocks).alias("block")).mapInArrow(
        frugal(pack), "block int, doc_id string, packed binary"
    )


def ids_of(texts) -> list[int | None]:
    """The ids of a block's rows as integers."""
    return [None if i is None else int(i) for i in texts]


def unpacked(packed: list[bytes]) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(p) for p in packed]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` in UTF-8 bytes."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers = np.ones((2, 1), np.uint64)


def _power_tables(n: int) -> np.ndarray:
    """The first n powers of the multiplier and of its inverse modulo 2^64."""
    global _powers
    if _powers.shape[1] < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = np.stack([
                np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)))
                for base in (_ODD, _INVERSE)
            ])
    return _powers[:, :n]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return values ^ (values >> np.uint64(33))


class PrefixHash:
    """Polynomial hashes of all prefixes, from which that of any slice follows in constant time."""

    def __init__(self, symbols: np.ndarray):
        self.powers = _power_tables(len(symbols) + 1)
        with np.errstate(over="ignore"):
            terms = (symbols.astype(np.uint64) + np.uint64(1)) * self.powers[0, : len(symbols)]
            self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unmixed hashes of the slices; equal for equal content wherever it stands."""
        with np.errstate(over="ignore"):
            return (self.prefix[ends] - self.prefix[starts]) * self.powers[1, starts]


_PLACE_BITS = np.uint64(31)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` mixed hashes, the position of its smallest one (by the upper 33 bits; leftmost of ties).

    The choice depends on the window's content alone, so equal windows choose the same place in themselves.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (values >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    least = np.minimum(low[:n], low[width - span : width - span + n])
    return (least & np.uint64((1 << 31) - 1)).astype(np.int64)
