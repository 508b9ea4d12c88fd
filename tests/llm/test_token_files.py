"""Token files against the library itself, and coders, blocks and files on awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import awkward
from tokenizers import Tokenizer

from wardline.llm import token_files as tf


@pytest.fixture(scope="module")
def library():
    whole = Tokenizer.from_str(tf.tokenizer_file())
    whole.encode_special_tokens = True
    return whole


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def brute(library, rows):
    """(doc_id, start, n_tokens, crc) in ascending order, null ids last."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = ids_of(library, text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_pieces_give_the_ids_of_whole_texts(library):
    random.seed(5)
    letters = ["a", "the", "Z", " ", " ", " ", "\n", "\t", " ", "　", "\x1c", "\x85", "​", "'s", "'", ".", ",", "!?", "1", "½", "é", "中",
               "՘", "\U000107bb", "<|endoftext|>", "ß", "😀", "don't", "\r\n", "\0", "word,", "\nNext", "Übel:"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(4000)] + ["x" * 500 + " " + "y" * 90, "ab " * 3000]
    encoder = tf.TextEncoder(tf.tokenizer_file())
    got = [x for k in range(0, len(texts), 97) for x in encoder.documents(texts[k : k + 97])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(library, t) for t in texts]
    assert all(len(p) <= tf.KNOWN_LENGTH for p in encoder.known)
    few = tf.TextEncoder(tf.tokenizer_file())
    few.known.update({str(k): b"" for k in range(tf.KNOWN_PARTS)})  # a full memory is emptied
    assert few.documents(texts[:50]) == encoder.documents(texts[:50]) and len(few.known) < 1000


def test_distinct_parts_are_encoded_side_by_side(library, monkeypatch):
    texts = [" ".join(f"w{k}ord### ({k}) é{k}a, %{k}!" for k in range(j, j + 300)) + "\nNext\nÜbel\nline" for j in range(5)]
    encoder, alone = tf.TextEncoder(tf.tokenizer_file()), []
    one = encoder._library_ids
    monkeypatch.setattr(encoder, "_library_ids", lambda part: alone.append(part) or one(part))
    got = encoder.documents(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(library, t) for t in texts]
    assert len(alone) < 20
    encoder = tf.TextEncoder(tf.tokenizer_file())
    encoder.bytes[:] = 2  # if tokens don't end where the parts do, each part goes alone
    assert encoder.documents(texts) == got


def test_the_library_s_white_space_is_python_s():
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    found = pre_tokenizers.Split(Regex(r"\s+"), "removed", invert=True).pre_tokenize_str(every)
    assert "".join(s for s, _ in found).isspace()


@pytest.mark.parametrize("n,lanes", [(1, 1), (5, 3), (1000, 7), (300_000, 1024), (70_000, 256)])
def test_lanes_give_back_their_ids_from_every_checkpoint(n, lanes):
    drawn = np.minimum(np.random.default_rng(n).geometric(0.01, n) * 37, 60_000).astype(np.uint32)
    ids, counts = np.unique(drawn, return_counts=True)
    table = tf.Frequencies.from_bytes(tf.Frequencies.of(ids, counts).to_bytes())
    assert table.shares.sum() == 1 << table.bits and table.shares.min() > 0
    words, places, states = tf.pack_lanes(drawn, table, lanes)
    symbols = table.symbols()
    for k, place in enumerate(places):
        begin = k * tf.CHECK_STEPS * lanes
        state = states[k].copy()
        assert np.array_equal(tf.unpack_lanes(words, place, state, n - begin, table, symbols), drawn[begin:])
        assert (state == tf.LOW).all()


def test_shares_of_very_uneven_counts():
    counts = np.array([10**12, 1, 1, *([1] * 5000), 7])
    table = tf.Frequencies.of(np.arange(len(counts)), counts)
    assert table.shares.sum() == 1 << table.bits and table.shares.min() == 1
    even = tf.Frequencies.of(np.arange(3), np.array([1, 1, 1]))
    assert even.shares.sum() == 1 << even.bits


def test_a_coded_block_is_smaller_and_damage_is_found():
    drawn = np.minimum(np.random.default_rng(1).geometric(0.2, 200_000), 60).astype(np.uint32)
    ids, counts = np.unique(drawn, return_counts=True)
    table = tf.Frequencies.of(ids, counts)
    docs = [(3, drawn[:5]), (None, drawn[5:6]), (-4, drawn[6:])]
    data = tf.pack_block(docs, table)
    entropy = -(counts / counts.sum() * np.log2(counts / counts.sum())).sum() / 8 * len(drawn)
    assert len(data) < entropy * 1.05 + 20_000
    block = tf.Block(data, table, table.symbols())
    assert block.doc_ids == [3, None, -4]
    assert all(np.array_equal(a, b) for a, (_, b) in zip(block.documents(), docs))
    for at in (0, 9, 200, len(data) // 2, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 64
        with pytest.raises(ValueError):
            tf.Block(bytes(broken), table, table.symbols())
    packed = table.to_bytes()
    with pytest.raises(ValueError):
        tf.Frequencies.from_bytes(packed[:-1] + bytes([packed[-1] ^ 1]))


@pytest.mark.parametrize("file_tokens,block_tokens", [(tf.FILE_TOKENS, tf.BLOCK_TOKENS), (500, 60)])
def test_files_against_brute_force(spark, library, file_tokens, block_tokens, tmp_path):
    rows = [(i, t, 1, "x") for i, t, _ in awkward()] + [(-3, "before zero", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(5)
    folder = f"{tmp_path}/files"
    index = tf.write_files(tf.encode(docs, tf.tokenizer_file()), folder, file_tokens, block_tokens)
    got = tf.read_files(index, folder, with_ids=True).collect()
    # Rows of one id may stand in any order; each row's start is the sum of those before it, whatever they are.
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted(
        (d, n, c) for d, _, n, c in brute(library, [r[:2] for r in rows]) if d is not None)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1])
    assert [(r.doc_id is None, r.doc_id or 0) for r in ordered] == sorted((r.doc_id is None, r.doc_id or 0) for r in ordered)
    texts = {i: t for i, t, *_ in rows if i is not None}
    assert all(list(r.ids) == ids_of(library, texts[r.doc_id]) for r in got if r.doc_id is not None)
    blocks = index.count()
    assert blocks > 10 if block_tokens == 60 else blocks <= 2


def test_equal_rows_are_dealt_to_several_files(spark, tmp_path):
    docs = spark.range(0, 900, 1, 6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("all the same text").alias("text"))
    index = tf.write_files(tf.encode(docs, tf.tokenizer_file()), f"{tmp_path}/same", file_tokens=1000)
    per_file = [r.n for r in index.groupBy("file").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(per_file) == 900 and len(per_file) > 3
    starts = sorted(r.start for r in tf.read_files(index, f"{tmp_path}/same").collect())
    assert starts == list(range(0, 4500, 5))


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = tf.write_files(tf.encode(docs, tf.tokenizer_file()), f"{tmp_path}/none")
    assert tf.read_files(index, f"{tmp_path}/none").collect() == []


def test_the_query(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in tf.op13_token_files(spark, folder).collect())
    assert got == sorted(brute(library, rows))
