"""Token files (operator 13): ids of whole texts, packed by a static range asymmetric numeral system and read back through an index.

Tasks encode texts and write the ids to a work table; one count of all ids gives the frequency table that all files share. The rows are then
dealt by ranges of the document id, and each range becomes one file of independent blocks of whole documents. In a block, token k belongs to lane
k mod `lanes`; the lanes are coders of their own that write into one stream of 32-bit words, so a step of all lanes is one vector operation.
Every `CHECK_STEPS` steps a checkpoint holds the states of all lanes and the place in the stream: decoding can start at any of them. A block carries a CRC-32
of all its bytes, and its lanes must end in the state they began with. The index (file, offset, length, tokens of each block) is a table of its own, and blocks
are read back by as many tasks as their bytes call for. A document's place in the whole follows from the tokens of files and blocks before its own.

A text is cut before each space that stands between two characters that are no white space, and between letters and common marks: the pre-tokenizer cuts
there too, whatever stands around, so the parts' ids joined are the text's ids. Each distinct part of a task is encoded once by the library, many of them
side by side as one text: the bytes of its tokens tell where a part ends.

Null text is empty: its document holds the end id alone. Rows without an id come last; rows of equal id follow a hash of their ids, and rows equal in all keep the order
of the work table. A block holds at least one document, so a very long text is a block of its own. An empty table gives a file without blocks and no rows.
The driver holds one number for each id of the vocabulary. Files are written and read by pyarrow's file systems, so the folder must be one that these reach from
every executor; a task that fails or runs twice leaves a file that no index entry names.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.catalog.registry import query
from wardline.functions.text import WHITESPACE
from wardline.llm.common import frugal, id_and_text
from wardline.workdir import new_path, written

END_ID = 0
LANES, CHECK_STEPS = 1024, 256
BLOCK_TOKENS, FILE_TOKENS = 1 << 20, 1 << 23
READ_BYTES = 4 << 20
# A lane's state lies in [LOW, LOW << 32); one step moves at most one word.
LOW = np.uint64(1 << 31)
_MAGIC, _TABLE_MAGIC = b"wtb1", b"wtf1"
_HEADER = "<4s7I"
# Parts of texts that a task remembers, the longest of them in characters, parts that stand side by side, and bytes of texts cut together.
KNOWN_PARTS, KNOWN_LENGTH, SIDE_BY_SIDE, GROUP_BYTES = 600_000, 64, 256, 8 << 20
# Stands where a text is cut. A text in which it, or a space beside white space, occurs is not cut at all.
_MARK = "\0"
_WHOLE = f"\0| [{WHITESPACE}]|[{WHITESPACE}] "
# Besides before spaces, the pre-tokenizer always cuts between these letters and marks, and behind a single line feed.
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_INNER = ((f"({_LETTER})([.,;:!?\n])", "\\1\0\\2"), (f"([^{WHITESPACE}])\n({_LETTER})", "\\1\n\0\\2"))
# Parts that can stand side by side as they are, and those that can with a line feed behind each.
_BESIDE, _LINE = f"(?s)^ [^{WHITESPACE}](.*[^{WHITESPACE}])?\\z", f"^{_LETTER}+\\z"
ENCODED = "doc_id long, n_tokens long, ids binary"
INDEX = ("file string, offset long, length long, n_tokens long, n_docs long, "
         "first_null boolean, first_id long, first_hash long, first_place long")
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class TextEncoder:
    """Ids of texts as the bytes of little-endian 32-bit integers, each distinct part encoded once."""

    def __init__(self, tokenizer: str, end_id: int = END_ID):
        import pyarrow as pa
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores
        self.library = Tokenizer.from_str(tokenizer)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.end = struct.pack("<I", end_id)
        # A character of the vocabulary stands for a byte.
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        # Parts encoded alone, and those encoded side by side with their ids.
        self.known: dict[str, bytes] = {"": b""}
        self.words, self.word_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _library_ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _alone(self, parts) -> list[bytes]:
        out = []
        for part in parts.to_pylist():
            if (ids := self.known.get(part)) is None:
                ids = self._library_ids(part)
                if len(part) <= KNOWN_LENGTH:
                    self.known[part] = ids
            out.append(ids)
        return out

    def _side_by_side(self, parts, behind: str = ""):
        """The ids of parts between which the pre-tokenizer cuts, with the one-byte mark `behind` after each if given."""
        import pyarrow as pa
        from pyarrow import compute as pc

        none = pa.scalar("", pa.large_string())
        joined = pc.binary_join_element_wise(parts, pa.scalar(behind, pa.large_string()), none) if behind else parts
        ends = np.cumsum(pc.binary_length(joined).to_numpy())
        line = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(joined)], pa.int64()), joined), none)[0].as_buffer()
        begin, runs = 0, []
        for k in range(0, len(ends), SIDE_BY_SIDE):
            stop = ends[min(k + SIDE_BY_SIDE, len(ends)) - 1]
            runs.append(line[begin:stop].to_pybytes().decode())
            begin = stop
        found, begin = [], 0
        for k, encoded in enumerate(self.library.encode_batch_fast(runs, add_special_tokens=False)):
            here = ends[k * SIDE_BY_SIDE : (k + 1) * SIDE_BY_SIDE] - begin
            ids = np.array(encoded.ids, "<u4")
            at = np.cumsum(self.bytes[ids])
            last = np.searchsorted(at, here)
            if at[-1] == here[-1] and np.array_equal(at[last], here) and (not behind or (self.bytes[ids[last]] == 1).all()):
                if behind:
                    ids, last = np.delete(ids, last), last - np.arange(1, len(last) + 1)
                edges = np.concatenate(([0], 4 * (last + 1)))
                found.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(here), [None, pa.py_buffer(edges), pa.py_buffer(ids)]))
            else:  # the library doesn't cut where it was thought to
                found.append(pa.array(self._alone(parts[k * SIDE_BY_SIDE : (k + 1) * SIDE_BY_SIDE]), pa.large_binary()))
            begin += here[-1]
        return pa.concat_arrays(found) if found else pa.array([], pa.large_binary())

    def _part_ids(self, parts):
        """(ids, places): the ids of some parts in an order of their own, and where each part's are."""
        import pyarrow as pa
        from pyarrow import compute as pc

        places = pc.fill_null(pc.index_in(parts, value_set=self.words), -1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(places < 0)
        new = parts.take(pa.array(unknown))
        beside = pc.match_substring_regex(new, _BESIDE).to_numpy(zero_copy_only=False)
        line = pc.match_substring_regex(new, _LINE).to_numpy(zero_copy_only=False)
        alone = ~(beside | line)
        kinds = [new.filter(pa.array(kind)) for kind in (beside, line, alone)]
        ids = [self._side_by_side(kinds[0]), self._side_by_side(kinds[1], "\n"), pa.array(self._alone(kinds[2]), pa.large_binary())]
        places[unknown[np.concatenate([np.flatnonzero(kind) for kind in (beside, line, alone)])]] = len(self.words) + np.arange(len(new))
        every = pa.concat_arrays([self.word_ids, *ids])
        words, word_ids = (pa.concat_arrays(x) for x in (kinds[:2], ids[:2]))
        short = pc.less_equal(pc.utf8_length(words), KNOWN_LENGTH)
        self.words = pa.concat_arrays([self.words, words.filter(short)])
        self.word_ids = pa.concat_arrays([self.word_ids, word_ids.filter(short)])
        return every, places

    def documents(self, texts) -> list[bytes]:
        """The ids of each text and the end id.

        Texts are cut, and their distinct parts found, on Arrow arrays; only these reach the library.
        """
        import pyarrow as pa
        from pyarrow import compute as pc

        if len(self.known) > KNOWN_PARTS:
            self.known = {"": b""}
        if len(self.words) > KNOWN_PARTS:
            self.words, self.word_ids = self.words[:0], self.word_ids[:0]
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        # Beside white space the pre-tokenizer's cuts depend on what follows; the mark of the cuts may stand in a text, too.
        whole = pc.match_substring_regex(column, _WHOLE)
        cut = pc.replace_substring(pc.if_else(whole, "", column), " ", _MARK + " ")
        for pattern, parts in _INNER:
            cut = pc.replace_substring_regex(cut, pattern, parts)
        lists = pc.split_pattern(cut, _MARK)
        coded = pc.list_flatten(lists).dictionary_encode()
        ids, places = self._part_ids(coded.dictionary)
        found = ids.take(pa.array(places[coded.indices.to_numpy()]))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets.cast(pa.int64()), found), pa.scalar(b"", pa.large_binary()))
        return [(self._library_ids(text.as_py()) if alone else ids) + self.end
                for text, alone, ids in zip(column, whole.to_pylist(), joined.to_pylist())]


def groups_of(batches) -> Iterator:
    """The rows of Arrow batches with an id and a text, together as batches of about `GROUP_BYTES` of text."""
    import pyarrow as pa
    from pyarrow import compute as pc

    held, size = [], 0
    for batch in batches:
        start = 0
        for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
            size += n
            if size >= GROUP_BYTES:
                yield pa.concat_batches([*held, batch.slice(start, k + 1 - start)])
                held, size, start = [], 0, k + 1
        held.append(batch.slice(start))
    if sum(batch.num_rows for batch in held):
        yield pa.concat_batches(held)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, written; `tokenizer` is the library's file as text, `ids` are compressed."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        import pyarrow as pa

        encoder, press = TextEncoder(shared.value, end_id), zstandard.ZstdCompressor(level=1)
        for batch in groups_of(batches):
            sizes, packed = [], []
            for ids in encoder.documents(batch.column(1)):
                sizes.append(len(ids) // 4)
                packed.append(press.compress(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                                             ["doc_id", "n_tokens", "ids"])

    return written(id_and_text(docs, id_col, text_col).mapInArrow(frugal(run), ENCODED), "token-ids")


def _unpacked(column) -> Iterator[np.ndarray]:
    press = zstandard.ZstdDecompressor()
    for packed in column:
        yield np.frombuffer(press.decompress(packed.as_buffer()), "<u4")


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in all documents."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)

        def add(run):
            nonlocal total
            n = np.bincount(np.concatenate(run))
            if len(n) > len(total):
                total = np.pad(total, (0, len(n) - len(total)))
            total[: len(n)] += n

        run, size = [], 0
        for batch in batches:
            for ids in _unpacked(batch.column(0)):
                run.append(ids)
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    add(run)
                    run, size = [], 0
        if run:
            add(run)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return encoded.select("ids").mapInArrow(frugal(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


class Frequencies:
    """The static model: each id's share of 2^bits, at least 1 for ids that occur, and where its range begins."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray, bits: int):
        self.ids, self.shares, self.bits = ids, shares, bits
        size = int(ids.max(initial=-1)) + 1
        self.share, self.begin = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.share[ids] = shares
        self.begin[ids] = np.cumsum(shares) - shares

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray) -> Frequencies:
        """Shares in proportion to the counts."""
        order = np.argsort(ids)
        ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        bits = min(28, max(12, len(ids).bit_length() + 4))
        if not len(ids):
            return cls(ids, ids, bits)
        shares = np.maximum(1, np.floor(counts / counts.sum() * (1 << bits))).astype(np.int64)
        surplus = int(shares.sum()) - (1 << bits)
        if surplus < 0:
            shares[np.argmax(shares)] -= surplus
        while surplus > 0:  # ids that were raised to 1 cost the frequent ones: each gives up to half of what it has
            most = int(np.argmax(shares))
            given = min(surplus, int(shares[most]) // 2)
            shares[most] -= given
            surplus -= given
        return cls(ids, shares, bits)

    def symbols(self) -> np.ndarray:
        """The id of every place of the ranges, for decoding."""
        return np.repeat(self.ids, self.shares).astype(np.uint32)

    def to_bytes(self) -> bytes:
        body = zstandard.ZstdCompressor().compress(np.array([self.ids, self.shares], "<u4").tobytes())
        return _TABLE_MAGIC + struct.pack("<III", self.bits, len(self.ids), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> Frequencies:
        bits, n, crc = struct.unpack_from("<III", data, 4)
        if data[:4] != _TABLE_MAGIC or zlib.crc32(data[16:]) != crc:
            raise ValueError("the frequency table is damaged")
        ids, shares = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16:]), "<u4").astype(np.int64).reshape(2, n)
        return cls(ids, shares, bits)


def pack_lanes(ids: np.ndarray, table: Frequencies, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, place of each checkpoint in them, states of all lanes at each checkpoint) of the ids."""
    share, begin, bits = table.share[ids], table.begin[ids], np.uint64(table.bits)
    state, word = np.full(lanes, LOW), np.uint64(32)
    limit = np.uint64(63 - table.bits)
    chunks, places, states, count = [], [], [], 0
    for step in range(-(-len(ids) // lanes) - 1, -1, -1):
        f, c = share[step * lanes : (step + 1) * lanes], begin[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= f << limit
        out = x[full]
        if len(out):
            chunks.append(out.astype(np.uint32))
            count += len(out)
            x[full] = out >> word
        times = x // f
        state[: len(f)] = (times << bits) + (x - times * f) + c
        if step % CHECK_STEPS == 0:
            places.append(count)
            states.append(state.copy())
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    return words, count - np.array(places[::-1], np.int64), np.array(states[::-1], np.uint64).reshape(-1, lanes)


def unpack_lanes(words: np.ndarray, place: int, state: np.ndarray, n: int, table: Frequencies, symbols: np.ndarray) -> np.ndarray:
    """`n` ids from a checkpoint on. `state` is changed to that after the last of them."""
    lanes, bits = len(state), np.uint64(table.bits)
    mask, word = np.uint64((1 << table.bits) - 1), np.uint64(32)
    ids = np.empty(n, np.uint32)
    for start in range(0, n, lanes):
        x = state[: min(lanes, n - start)]
        slot = x & mask
        found = symbols[slot]
        ids[start : start + len(x)] = found
        x[:] = table.share[found] * (x >> bits) + slot - table.begin[found]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << word) | words[place : place + len(low)]
        place += len(low)
    return ids


def pack_block(docs: list[tuple[int | None, np.ndarray]], table: Frequencies, lanes: int = LANES) -> bytes:
    """A block of whole documents: header, directory of documents, checkpoints, words, CRC-32 of all of it."""
    ids = np.concatenate([ids for _, ids in docs])
    lanes = max(1, min(lanes, len(ids) // 16))
    words, places, states = pack_lanes(ids, table, lanes)
    press = zstandard.ZstdCompressor(level=3)
    directory = press.compress(
        np.array([doc_id or 0 for doc_id, _ in docs], "<i8").tobytes() + np.array([len(i) for _, i in docs], "<u4").tobytes()
        + np.array([doc_id is None for doc_id, _ in docs], np.uint8).tobytes())
    checkpoints = press.compress(places.astype("<u4").tobytes() + states.astype("<u8").tobytes())
    body = struct.pack(_HEADER, _MAGIC, len(ids), len(docs), lanes, len(words), len(places), len(directory), len(checkpoints))
    body += directory + checkpoints + words.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block read back; any run of its tokens can be decoded from the checkpoint before it."""

    def __init__(self, data: bytes, table: Frequencies, symbols: np.ndarray):
        magic, self.n_tokens, n_docs, self.lanes, n_words, n_places, directory, checkpoints = struct.unpack_from(_HEADER, data)
        if magic != _MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block of token ids differs from its checksum")
        self.table, self.symbols = table, symbols
        press, at = zstandard.ZstdDecompressor(), struct.calcsize(_HEADER)
        listed = press.decompress(data[at : at + directory])
        flags = np.frombuffer(listed, np.uint8, offset=12 * n_docs)
        self.doc_ids = [None if null else i for i, null in zip(np.frombuffer(listed, "<i8", n_docs).tolist(), flags)]
        self.sizes = np.frombuffer(listed, "<u4", n_docs, 8 * n_docs).astype(np.int64)
        at += directory
        listed = press.decompress(data[at : at + checkpoints])
        self.places = np.frombuffer(listed, "<u4", n_places).astype(np.int64)
        self.states = np.frombuffer(listed, "<u8", offset=4 * n_places).reshape(n_places, self.lanes)
        self.words = np.frombuffer(data, "<u4", n_words, at + checkpoints)

    def segment(self, k: int) -> np.ndarray:
        """The ids from checkpoint k up to the next one."""
        length = CHECK_STEPS * self.lanes
        state = self.states[k].astype(np.uint64)
        ids = unpack_lanes(self.words, int(self.places[k]), state, min(length, self.n_tokens - k * length), self.table, self.symbols)
        if not np.array_equal(state, self.states[k + 1] if k + 1 < len(self.states) else np.full(self.lanes, LOW)):
            raise ValueError("a lane of token ids doesn't end in its state")
        return ids

    def documents(self) -> list[np.ndarray]:
        """The ids of each document."""
        ids = np.concatenate([self.segment(k) for k in range(len(self.places))])
        return np.split(ids, np.cumsum(self.sizes)[:-1])


def write_files(encoded: DataFrame, folder: str, file_tokens: int = FILE_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write all rows of `encode` into files below `folder`, by ascending id, and return the index, written."""
    spark = encoded.sparkSession
    counts = id_counts(encoded).toPandas()  # one row for each id of the vocabulary at most
    table = Frequencies.of(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)).to_bytes()
    total = int(counts["n"].sum())
    shared = spark.sparkContext.broadcast(table)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        table = Frequencies.from_bytes(shared.value)
        path = f"{root}/ids-{uuid.uuid4().hex}.tokens"
        names = [part.split()[0] for part in INDEX.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        with system.open_output_stream(path, compression=None, buffer_size=1 << 20) as out:
            place, docs, size, first = 0, [], 0, None

            def flush():
                nonlocal place, docs, size, first
                block = pack_block(docs, table)
                out.write(block)
                row = (path, place, len(block), size, len(docs), *first)
                place, docs, size, first = place + len(block), [], 0, None
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

            for batch in batches:
                keys = zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))
                for (doc_id, digest, at), ids in zip(keys, _unpacked(batch.column(1))):
                    if docs and size + len(ids) > block_tokens:
                        yield flush()
                    first = first or (doc_id is None, doc_id, digest, at)
                    docs.append((doc_id, ids))
                    size += len(ids)
            if docs:
                yield flush()

    # The place in the work table parts rows that are equal in id and text, so that a range can end between them.
    rows = encoded.select("doc_id", "ids", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("place"))
    order = [F.asc_nulls_last("doc_id"), F.asc("hash"), F.asc("place")]
    files = max(2, -(-total // file_tokens))
    index = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(frugal(write), INDEX)
    index = written(index, "token-index")
    _store(folder, "frequencies.table", table)
    return index


def _store(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}") as out:
        out.write(data)


def with_starts(index: DataFrame) -> DataFrame:
    """The index with `start`, the tokens before each block: those of files before its own, then of blocks before it in the file."""
    first = F.min(F.struct("first_null", "first_id", "first_hash", "first_place")).alias("first")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("tokens"), first)
    # One row for a file.
    before = F.sum("tokens").over(Window.orderBy("first")) - F.col("tokens")
    bases = files.select("file", before.alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("offset")) - F.col("n_tokens")
    return index.withColumn("inside", inside).join(bases, "file").select(
        "file", "offset", "length", (F.col("base") + F.col("inside")).alias("start"))


def read_files(index: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the blocks in `index`, and `ids` on demand, decoded from the files."""

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        with system.open_input_file(f"{root}/frequencies.table") as source:
            table = Frequencies.from_bytes(source.read())
        symbols = table.symbols()
        source, opened = None, ""
        for batch in batches:
            for file, offset, length, start in zip(*(column.to_pylist() for column in batch.columns)):
                if file != opened:
                    if source is not None:
                        source.close()
                    source, opened = system.open_input_file(file), file
                block = Block(source.read_at(length, offset), table, symbols)
                docs = block.documents()
                columns = [pa.array(block.doc_ids, pa.int64()), pa.array(start + np.cumsum(block.sizes) - block.sizes),
                           pa.array(block.sizes), pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in docs], pa.int64())]
                names = [part.split()[0] for part in READ.split(", ")]
                if with_ids:
                    offsets = pa.array(np.append(0, np.cumsum(block.sizes)).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(docs).astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        if source is not None:
            source.close()

    size = index.agg(F.sum("length")).first()[0] or 0
    return (
        with_starts(index).repartitionByRange(max(2, -(-size // READ_BYTES)), "file", "offset").sortWithinPartitions("file", "offset")
        .mapInArrow(frugal(read), READ + (", ids array<long>" if with_ids else ""))
    )


def tokenizer_file() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as lines:
        return lines.read()


@query("op13_token_files")
def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    archive = new_path(spark, "token-files")
    index = write_files(encode(docs, tokenizer_file()), archive)
    return read_files(index, archive)
