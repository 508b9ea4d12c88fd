"""Repeated phrases, found by automata (operator 7).

A window is `WINDOW` consecutive words. A word goes if a window around it also starts in a document with a smaller id. First, windows that could
recur: every window chooses a seed in itself by content alone (the smallest hash of its five-word runs), so equal windows choose equal
seeds, and seeds found in one document only are dropped by counting. Second, recurring passages are confirmed: the windows of each form of a piece
(the windows of one seed) meet in shards of seeds, where the smallest document id of each is found; a piece whose windows have one such id goes on as a
whole, other pieces by their windows, and only to blocks with a later document that has them. Third, every block of documents compiles the passages
confirmed in it into an Aho-Corasick automaton over word symbols, and streams its whole documents through it. The automata are thus sharded by the
documents: each is bounded by its block, and together they see every document once.

Counting of seeds is by `SEED_BITS` of their hash and a Bloom filter of recurring ones of at most `BLOOM_BITS`, which only save work: what passes is counted exactly. Windows
are told apart by two 64-bit hashes (seed and content). What tasks send to shards and back is packed: sorted gaps, and each form once per `HELD` windows
with the documents and blocks that have it. Windows of seeds in very many documents are dealt by their own hashes. Runs of a document's windows with one smallest id are one passage of at most `RUN` windows.

Null and empty texts have no words. Rows of one id are one document: they never remove from each other. A null id is not
compared: such a row neither loses words nor makes others lose them. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.registry import query
from wardline.llm.common import PrefixHash, block_count, compressed_blocks, frugal, frugal_group, id_and_text, ids_of, mix, unpacked, window_minima
from wardline.llm.quality import in_chunks
from wardline.llm.rules import Words
from wardline.workdir import written

WINDOW = 13
SEED = 5
SEED_BITS = 40
BLOOM_BITS = 1 << 28
# Windows or pieces that a task holds before it sends them, blocks whose seeds a shard counts, windows of a passage.
HELD, SHARD_BLOCKS, RUN = 1 << 20, 8, 64
# Pieces of recurring seeds (of nine windows at most) that meet in a shard, whatever share of the texts they are.
SHARD_PIECES = 1 << 19
# A seed is hot if it stands in more documents than `HOT_LEAST`, and than one `HOT_SHARE`-th of what a shard has on average.
HOT_LEAST, HOT_SHARE = 1000, 100
_PROBES = 4


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _planes(values: np.ndarray) -> bytes:
    """64-bit integers by planes of their bytes, compressed: small ones take little."""
    planes = np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _integers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _joined(packed, gaps: bool = False) -> np.ndarray:
    """The integers of several messages; of `gaps` the sums."""
    return np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_integers(x)) if gaps else _integers(x) for x in packed)])


class Pieces:
    """Runs of windows with one seed, in some texts: text, first word (counted over all texts), windows and seed."""

    def __init__(self, texts: list[bytes]):
        self.words = words = Words(texts)
        h, n = words.hash, len(words.hash) - WINDOW + 1
        self.first_word = np.cumsum(words.count) - words.count
        if n <= 0:
            empty = np.zeros(0, np.int64)
            self.text, self.start, self.windows, self.seed = (empty,) * 4
            return
        with np.errstate(over="ignore"):
            values = np.zeros(len(h) - SEED + 1, np.uint64)
            for k in range(SEED):
                values = values * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(values)]
        values = mix(values)
        chosen = window_minima(values, WINDOW - SEED + 1)
        at = np.flatnonzero(words.text[:n] == words.text[WINDOW - 1 :])
        new = np.ones(len(at), bool)
        new[1:] = (chosen[at[1:]] != chosen[at[:-1]]) | (np.diff(at) > 1)
        first = np.flatnonzero(new)
        self.start = at[first]
        self.windows = np.diff(np.append(first, len(at)))
        self.text = words.text[self.start]
        self.table = PrefixHash(h)
        # Smallest hashes lie near zero; mixed again, they fill all ranges (shards) alike.
        self.seed = mix(values[chosen[self.start]]).view(np.int64)

    def window_hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, content hash) of all windows of the chosen pieces, in order."""
        at = _ranges(self.start[which], self.windows[which])
        return at, mix(self.table.slices(at, at + WINDOW)).view(np.int64) if len(at) else at


def _short(seeds: np.ndarray) -> np.ndarray:
    return (seeds.view(np.uint64) >> np.uint64(64 - SEED_BITS)).view(np.int64)


def _shards_of(short: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of seeds."""
    return (short * shards) >> SEED_BITS


def _recurring_seeds(rows: DataFrame, shards: int) -> DataFrame:
    """(seed, docs): the upper bits of seeds that stand in two documents or more, and in about how many; few others are among them."""

    def find(batches):
        import pyarrow as pa

        def lists(seed, doc):
            order = np.argsort(seed, kind="stable")
            seed, doc = seed[order], doc[order]
            new = np.concatenate(([True], seed[1:] != seed[:-1]))
            first = np.flatnonzero(new)
            several = np.add.reduceat(np.concatenate(([False], doc[1:] != doc[:-1])) & ~new, first, dtype=np.int64)
            seed = seed[first]
            edges = np.searchsorted(_shards_of(seed, shards), np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                part, more = (x[edges[k] : edges[k + 1]] for x in (seed, several))
                often = more > 0
                yield k, *(_planes(np.diff(part[some], prepend=0)) for some in (~often, often)), _planes(more[often])

        def send(held):
            found = list(zip(*lists(*map(np.concatenate, zip(*held)))))
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), *(pa.array(x, pa.binary()) for x in found[1:])],
                                              ["shard", "once", "often", "more"])

        held, size = [], 0
        for batch in batches:
            ids, at = batch.column(0).to_numpy(), 0
            for run in in_chunks(batch.column(1).cast(pa.binary()).to_pylist()):
                pieces = Pieces(run)
                if len(pieces.seed):
                    held.append((_short(pieces.seed), ids[at + pieces.text]))
                    size += len(pieces.seed)
                at += len(run)
                if size >= HELD:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def merge(group):
        import pandas as pd

        once, often = (_joined(group[c], gaps=True) for c in ("once", "often"))
        seed, place = np.unique(np.concatenate((once, often)), return_inverse=True)
        docs = np.ones(len(place), np.int64)
        docs[len(once) :] += _joined(group["more"])
        total = np.zeros(len(seed), np.int64)
        np.add.at(total, place, docs)
        return pd.DataFrame({"seed": seed[total > 1], "docs": total[total > 1]})

    lists = rows.where("doc_id is not null").select("doc_id", "text").mapInArrow(
        frugal(find), "shard int, once binary, often binary, more binary")
    return lists.groupBy("shard").applyInPandas(frugal_group(merge), "seed long, docs long")


def _probes(seeds: np.ndarray, size: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [mix(seeds.view(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(size - 1) for k in range(_PROBES)]


def _bloom(seeds: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """The filter as 64-bit cells; at most `bits` / 64 of them reach the driver."""
    size = min(bits, max(1 << 16, 1 << (seeds.count() * 12).bit_length()))

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            at = np.unique(np.concatenate(_probes(batch.column(0).to_numpy(), size)))
            cell = (at >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else cell
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(cell) else at
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(mask.view(np.int64))], ["cell", "mask"])

    cells = seeds.select("seed").mapInArrow(mark, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[cells["cell"].to_numpy()] = cells["mask"].to_numpy()
    return table.view(np.uint64)


def _may_recur(table: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    found = np.ones(len(seeds), bool)
    for at in _probes(seeds, len(table) * 64):
        found &= (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _keys(seed: np.ndarray, content: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(seed.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + content.view(np.uint64)).view(np.int64)


def _piece_keys(seed: np.ndarray, windows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys of whole pieces: the first and the last of their windows hold all of their words. A single window has its own key."""
    if not len(seed):
        return np.zeros(0, np.int64)
    ends = np.cumsum(windows)
    with np.errstate(over="ignore"):
        both = hashes[ends - windows].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(hashes[ends - 1].view(np.uint64))
        return _keys(seed, np.where(windows == 1, hashes[ends - 1].view(np.uint64), mix(both + windows.astype(np.uint64))))


MESSAGE = "shard int, seeds binary, windows binary, lengths binary, times binary, docs binary, blocks binary"
PASSAGES = "block int, keys binary, lows binary"


def _messages(seed: np.ndarray, n: np.ndarray, doc: np.ndarray, block: np.ndarray, windows: np.ndarray, shards: int, hot: np.ndarray):
    """Rows of `MESSAGE`: the forms of some pieces, each with its windows and with the documents and blocks that have it.

    Pieces of `hot` seeds are taken apart, and their windows dealt each for itself.
    """
    apart = np.isin(_short(seed), hot)
    times = np.where(apart, n, 1)
    seed, n, doc, block, apart = (np.repeat(x, times) for x in (seed, n, doc, block, apart))
    n = np.where(apart, 1, n)
    keys = _piece_keys(seed, n, windows)
    dealt = _shards_of(_short(np.where(apart, keys, seed)), shards)
    _, sample, form = np.unique(keys, return_index=True, return_inverse=True)
    order = np.lexsort((sample, dealt[sample]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sample, form = sample[order], place[form]
    order = np.argsort(form, kind="stable")
    form, doc, block = form[order], doc[order], block[order]
    other = np.concatenate(([True], (form[1:] != form[:-1]) | (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])))
    form, doc, block = form[other], doc[other], block[other]
    times = np.bincount(form)
    edges, begins = np.concatenate(([0], np.cumsum(times))), np.cumsum(n) - n
    seed, n, begins = seed[sample], n[sample], begins[sample]
    parts = np.searchsorted(dealt[sample], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(parts)).tolist():
        some = slice(parts[k], parts[k + 1])
        those = slice(edges[parts[k]], edges[parts[k + 1]])
        yield (k, seed[some].tobytes(), windows[_ranges(begins[some], n[some])].tobytes(), _planes(n[some]), _planes(times[some]),
               _planes(np.diff(doc[those], prepend=0)), _planes(block[those]))


def _confirmed(group):
    """Of the messages of a shard, rows of `PASSAGES`: for each block the pieces or windows that a later document in it has, and where they stand first."""
    import pandas as pd

    seed, windows = (np.frombuffer(b"".join(group[c]), np.int64) for c in ("seeds", "windows"))
    n, times, block = (_joined(group[c]) for c in ("lengths", "times", "blocks"))
    doc = _joined(group["docs"], gaps=True)
    least = np.minimum.reduceat(doc, np.cumsum(times) - times)
    begins, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    order = np.lexsort((windows, seed[of]))
    s, w = seed[of[order]], windows[order]
    first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (w[1:] != w[:-1]))))
    low = np.empty(len(w), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(least[of[order]], first), np.diff(np.append(first, len(w))))
    lowest, highest = np.minimum.reduceat(low, begins), np.maximum.reduceat(low, begins)

    form = np.repeat(np.arange(len(n)), times)
    later = np.flatnonzero(doc > lowest[form])
    order = later[np.lexsort((doc[later], block[later], form[later]))]
    # Of a form and block, the greatest id decides.
    last = np.ones(len(order), bool)
    last[:-1] = (form[order[1:]] != form[order[:-1]]) | (block[order[1:]] != block[order[:-1]])
    form, doc, block = form[order[last]], doc[order[last]], block[order[last]]
    even = lowest[form] == highest[form]
    keys = _piece_keys(seed, n, windows)
    some = form[~even]
    at = _ranges(begins[some], n[some])
    found, until = np.repeat(block[~even], n[some]), np.repeat(doc[~even], n[some])
    inside = low[at] < until
    at, found = at[inside], found[inside]
    key = np.concatenate((keys[form[even]], _keys(seed[of[at]], windows[at])))
    low = np.concatenate((lowest[form[even]], low[at]))
    block = np.concatenate((block[even], found))

    order = np.lexsort((key, low, block))
    key, low, block = key[order], low[order], block[order]
    other = np.ones(len(key), bool)
    other[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
    key, low, block = key[other], low[other], block[other]
    names, first = np.unique(block, return_index=True)
    spans = [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)])]
    return pd.DataFrame({"block": names.astype(np.int32), "keys": [key[x].tobytes() for x in spans],
                         "lows": [_planes(np.diff(low[x], prepend=0)) for x in spans]})


def confirmed_passages(rows: DataFrame, blocks: int) -> DataFrame:
    """`PASSAGES`: keys of what recurs in each block's documents, a piece or a window, and the smallest document it starts in.

    `rows` are (doc_id, text, block).
    """
    seeds = written(_recurring_seeds(rows, max(12, blocks // SHARD_BLOCKS)), "phrase-seeds")
    table = rows.sparkSession.sparkContext.broadcast(_bloom(seeds))
    total = seeds.agg(F.sum("docs")).first()[0] or 0
    shards = max(12, -(-total // SHARD_PIECES))
    # At most `HOT_SHARE` of them for each shard.
    limit = max(HOT_LEAST, total // (HOT_SHARE * shards))
    hot = seeds.where(F.col("docs") > limit).select("seed").toArrow()["seed"].to_numpy()

    def find(batches):
        import pyarrow as pa

        def send(held):
            found = zip(*_messages(*map(np.concatenate, zip(*held)), shards, hot))
            names = [part.split()[0] for part in MESSAGE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k else pa.int32()) for k, x in enumerate(found)], names)

        held, size = [], 0
        for batch in batches:
            ids, at = batch.column(0).to_numpy(), 0
            block = batch.column(2).to_numpy()
            for run in in_chunks(batch.column(1).cast(pa.binary()).to_pylist()):
                pieces = Pieces(run)
                which = np.flatnonzero(_may_recur(table.value, _short(pieces.seed)))
                if len(which):
                    _, hashes = pieces.window_hashes(which)
                    text = at + pieces.text[which]
                    held.append((pieces.seed[which], pieces.windows[which], ids[text], block[text].astype(np.int64), hashes))
                    size += len(hashes)
                at += len(run)
                if size >= HELD:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    messages = rows.where("doc_id is not null").select("doc_id", "text", "block").mapInArrow(frugal(find), MESSAGE)
    return messages.groupBy("shard").applyInPandas(frugal_group(_confirmed), PASSAGES)


def _symbols(words: Words, starts: np.ndarray, lengths: np.ndarray) -> tuple[str, int]:
    """The words of some texts as one string, each of equally many characters, and how many.

    Words within passages (starts, lengths) get codes of their own, all others share one. Characters stand for digits to the
    base 256, each digit with a range of its own: nodes of the automaton so have few children, and no match starts inside a word.
    """
    inside = np.zeros(len(words.hash) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths, -1)
    used = np.cumsum(inside[:-1]) > 0
    known = np.unique(words.hash[used])
    at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
    code = np.where(known[at] == words.hash, at + 1, 0)
    width = max(1, -(-int(len(known)).bit_length() // 8))
    digits = np.stack([(code >> 8 * k & 255) + 256 * (k + 1) for k in range(width)], axis=1)
    return digits.astype("<u4").tobytes().decode("utf-32-le"), width


def removed_words(texts: list[bytes], ids: list[int | None], known: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """For each text of a block, which words go: its passages are compiled into one automaton, which then reads all texts.

    `known` are keys of pieces or windows, `low` the smallest document of each.
    """
    import ahocorasick

    pieces = Pieces(texts)
    words = pieces.words
    gone = [np.zeros(n, bool) for n in words.count.tolist()]
    if not len(known) or not len(pieces.seed):
        return gone
    order = np.argsort(known)
    known, low = known[order], low[order]

    def confirmed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys, low[at]

    # Windows of this block that a smaller document has: those of whole pieces, and single ones of the others.
    starts, hashes = pieces.window_hashes(np.arange(len(pieces.seed)))
    of = np.repeat(np.arange(len(pieces.seed)), pieces.windows)
    whole, first = confirmed(_piece_keys(pieces.seed, pieces.windows, hashes))
    found, first = whole[of], first[of]
    rest = np.flatnonzero(~found)
    found[rest], first[rest] = confirmed(_keys(pieces.seed[of[rest]], hashes[rest]))
    number = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)
    later = found & (first < number[words.text[starts]])
    starts, first = starts[later], first[later]
    if not len(starts):
        return gone
    # Passages: neighbouring windows with one smallest document.
    new = np.concatenate(([True], (np.diff(starts) > 1) | (first[1:] != first[:-1])))
    at = np.arange(len(starts))
    new |= (at - at[new][np.cumsum(new) - 1]) % RUN == 0
    at = np.flatnonzero(new)
    lengths = np.diff(np.append(at, len(starts))) - 1 + WINDOW
    starts, first = starts[at], first[at]
    _, sample = np.unique(mix(pieces.table.slices(starts, starts + lengths)), return_index=True)
    starts, lengths, first = starts[sample], lengths[sample], first[sample]
    line, width = _symbols(words, starts, lengths)
    automaton = ahocorasick.Automaton()
    for start, n, first_id in zip(starts.tolist(), lengths.tolist(), first.tolist()):
        automaton.add_word(line[start * width : (start + n) * width], (n, first_id))
    automaton.make_automaton()
    for mask, first, doc_id in zip(gone, pieces.first_word.tolist(), ids):
        if doc_id is None or len(mask) < WINDOW:
            continue
        change = np.zeros(len(mask) + 1, np.int32)
        for end, (n, low_id) in automaton.iter(line[first * width : (first + len(mask)) * width]):
            if low_id < doc_id:
                stop = (end + 1) // width
                change[stop - n] += 1
                change[stop] -= 1
        mask |= np.cumsum(change[:-1]) > 0
    return gone


def remove_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): of every row, the words that stay, joined by single spaces (binary)."""
    rows = id_and_text(docs, id_col, text_col)
    blocks = block_count(rows)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    passages = confirmed_passages(rows.withColumn("block", block), blocks)

    def stream(key, texts, passages):
        import pandas as pd

        data = unpacked(texts["packed"])
        ids = ids_of(texts["doc_id"])
        masks = removed_words(data, ids, np.frombuffer(b"".join(passages["keys"]), np.int64), _joined(passages["lows"], gaps=True))
        kept = [b" ".join(w for w, out in zip(text.split(), mask.tolist()) if not out) for text, mask in zip(data, masks)]
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64"), "n_words": [len(m) for m in masks], "n_removed": [int(m.sum()) for m in masks], "kept": kept})

    dealt = compressed_blocks(rows, blocks)
    return dealt.groupBy("block").cogroup(passages.groupBy("block")).applyInPandas(
        frugal_group(stream), "doc_id long, n_words long, n_removed long, kept binary")


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = remove_phrases(spark.read.parquet(f"{folder}/documents.parquet"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
