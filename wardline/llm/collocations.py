"""Phrase collocation mining after Toivonen (operator 11).

A sample of the documents proposes phrases; one pass over all documents counts them and their negative border exactly; phrases of the border that turn out to be
frequent are failures of the sample, and further passes count what grows from them, until nothing does.

A phrase can be frequent only if the phrases without its last and without its first word are. So a pass counts a run of words if both of these are
*proposed*: that covers the proposed phrases and their border, the shortest phrases around them, and nothing else. All single words belong to the border,
since the sample can't know them all. A pass after failures counts the runs that the larger proposal admits and the smaller one did not; each makes phrases longer by a
word, so there are at most three. The sample is mined by the same passes, with a smaller minimum.

Proposals reach the tasks as a Bloom filter of at most `MOST_BITS` bits, put together by Spark. It forgets none; what it lets in by mistake, or because there are too many phrases
for its size, is counted like the rest, so results don't depend on it. Tasks number the words of a chunk, number runs from these, and hand out
one row for each distinct run of a chunk. All sums are Spark's, by language and phrase, with partial sums; only frequent phrases are written.

Null text is empty; a null language is `und`. Ids play no part but in the draw of the sample: null and repeated ones are fine, and repeated rows count as often as they stand
in the table. An empty table, or one without frequent phrases, gives no rows. A text is cut into chunks between its pieces; a single piece is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.catalog.registry import query
from wardline.llm.common import frugal, mix
from wardline.workdir import written

LONGEST, MINIMUM = 4, 30
TOP, COVERED_PERCENT = 2000, 80
# Share of the documents in the sample (percent), and how often a phrase must stand there to be proposed.
SAMPLE_PERCENT, SAMPLE_MINIMUM = 20, 5
MOST_BITS, BITS_EACH, PROBES = 1 << 28, 16, 4
CHUNK_BYTES = 8 << 20
_PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
# Lower case for A to Z; a line feed for what ends pieces, a space for what ends words.
_NORMAL = bytes(10 if c in _PIECE_ENDS else 32 if c in (9, 32) else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0xD6E8FEB86659FD93)
COUNTED = "lang string, words int, phrase string, n long"


class Proposals:
    """A Bloom filter of phrases by their hashes, and how many were put into it."""

    def __init__(self, bitmap: np.ndarray, size: int = 0):
        self.bitmap, self.size = bitmap, size

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> np.ndarray:
        """The bits of each phrase (rows)."""
        low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
        return (low + high * np.arange(PROBES, dtype=np.uint64)[:, None]) % np.uint64(bits)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in self.places(hashes, 64 * len(self.bitmap)):
            found &= (self.bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


NONE = Proposals(np.zeros(1 << 10, np.uint64))


def word_hashes(words: list[bytes] | list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def language_hash(lang: str) -> np.uint64:
    return word_hashes([lang.encode()])[0]


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases followed by words; a language stands before the first word."""
    with np.errstate(over="ignore"):
        return mix(hashes * _STEP + words)


class Runs:
    """The words of some texts of one language, and counts of their runs."""

    def __init__(self, lang: str, texts: list[bytes]):
        import pyarrow as pa
        from pyarrow import compute as pc

        data = b"\n".join(texts).translate(_NORMAL)
        symbols = np.frombuffer(data, np.uint8)
        blank = np.concatenate(([True], (symbols == 10) | (symbols == 32)))
        starts = np.flatnonzero(blank[:-1] & ~blank[1:])
        self.n = len(starts)
        self.piece = np.cumsum(symbols == 10, dtype=np.int32)[starts]
        whole = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(data)])), pa.py_buffer(data))
        words = pc.list_flatten(pc.ascii_split_whitespace(whole))
        words = words.slice(int(self.n > 0 and blank[1]) if len(data) else 0, self.n)  # white space in front leaves an empty word
        coded = words.dictionary_encode()
        self.word = coded.indices.to_numpy().astype(np.int64)
        self.kinds = len(coded.dictionary)
        self.hash = word_hashes(coded.dictionary.to_pylist())
        self.base = language_hash(lang)
        # All words joined by single spaces: every phrase is a slice of this.
        edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        sizes = np.diff(edges)
        letters = np.frombuffer(words.buffers()[2], np.uint8)[edges[0] : edges[-1]] if self.n else np.zeros(0, np.uint8)
        self.text = np.full(len(letters) + self.n, 32, np.uint8)
        self.text[np.arange(len(letters)) + np.repeat(np.arange(self.n), sizes)] = letters
        self.begins = np.cumsum(sizes + 1) - (sizes + 1)
        self.ends = self.begins + sizes

    def counted(self, before: Proposals | None, now: Proposals, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first places, counts) of the distinct runs that `now` admits and `before` did not (None: nothing was counted)."""
        if before is None and self.kinds:
            sample = np.zeros(self.kinds, np.int64)
            sample[self.word[::-1]] = np.arange(self.n)[::-1]
            yield 1, sample, np.bincount(self.word, minlength=self.kinds)
        hashes = longer(np.full(self.kinds, self.base), self.hash)
        # Of every place: the hash of the run that starts there, and whether each filter, none shorter having failed, holds it.
        held = [(p.holds(hashes) if p is not None else np.zeros(self.kinds, bool))[self.word] for p in (before, now)]
        hashes = hashes[self.word]
        for words in range(2, longest + 1):
            last = max(0, self.n - words + 1)
            inside = self.piece[:last] == self.piece[words - 1 :]
            seen, admitted = (h[:last] & h[1 : last + 1] & inside for h in held)
            at = np.flatnonzero(admitted & ~seen)
            if len(at):
                place = self.word[at]
                for k in range(1, words):  # numbers of the runs of two words, of three, and so on
                    _, first, place, counts = np.unique(
                        place * self.kinds + self.word[at + k], return_index=True, return_inverse=True, return_counts=True)
                yield words, at[first], counts
            if words == longest or not admitted.any():
                return
            at = np.flatnonzero(admitted | seen)
            hashes[at] = longer(hashes[at], self.hash[self.word[at + words - 1]])
            for h, p, these in zip(held, (before, now), (seen, admitted)):
                h[:] = False
                if p is not None:
                    at = np.flatnonzero(these)
                    h[at] = p.holds(hashes[at])

    def phrases(self, words: int, at: np.ndarray):
        """The runs of so many words at these places as an Arrow array."""
        import pyarrow as pa

        starts, sizes = self.begins[at], self.ends[at + words - 1] - self.begins[at]
        offsets = np.append(0, np.cumsum(sizes))
        data = self.text[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _fragments(text: bytes) -> Iterator[bytes]:
    """A long text cut behind ends of pieces into parts of about `CHUNK_BYTES`."""
    while len(text) > CHUNK_BYTES:
        normal = text[: 2 * CHUNK_BYTES].translate(_NORMAL)
        cut = normal.rfind(b"\n", 0, CHUNK_BYTES) + 1 or normal.find(b"\n") + 1
        if not cut:
            cut = text.translate(_NORMAL).find(b"\n") + 1 or len(text)
        yield text[:cut]
        text = text[cut:]
    if text:
        yield text


def _chunks(batches) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, about `CHUNK_BYTES` at a time."""
    import pyarrow as pa

    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            for part in _fragments(text.as_buffer().to_pybytes()):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= CHUNK_BYTES:
                    yield held
                    held, size = {}, 0
    yield held


def count_pass(docs: DataFrame, before: Proposals | None, now: Proposals, minimum: int, longest: int, name: str) -> DataFrame:
    """(lang, words, phrase, n), written: the frequent ones of the runs that this pass counts.

    A first pass (`before` is None) also counts all words of each language: the phrase of no words.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((None if before is None else before.bitmap, now.bitmap))

    def count(batches):
        import pyarrow as pa
        from pyarrow import compute as pc

        old, new = (None if b is None else Proposals(b) for b in shared.value)

        def rows(lang, phrases, counts):
            keys = pc.binary_join_element_wise(pa.scalar(lang), phrases, pa.scalar("\n"))
            return pa.RecordBatch.from_arrays([keys, pa.array(counts.astype(np.int64))], ["key", "n"])

        for chunk in _chunks(batches):
            for lang, texts in chunk.items():
                runs = Runs(lang, texts)
                for words, at, counts in runs.counted(old, new, longest):
                    yield rows(lang, runs.phrases(words, at), counts)
                if old is None:
                    yield rows(lang, pa.array([""]), np.array([runs.n]))

    # One short key for language and phrase: no phrase has a line feed. The row of all words ends with one.
    summed = docs.mapInArrow(frugal(count), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    frequent = summed.where((F.col("n") >= minimum) | F.col("key").endswith("\n"))
    phrase = F.substring_index("key", "\n", -1)
    words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    return written(
        frequent.withColumn("phrase", phrase).select(
            F.expr("left(key, length(key) - length(phrase) - 1)").alias("lang"), words.cast("int").alias("words"), "phrase", "n"), name)


def proposed(phrases: DataFrame, already: Proposals = NONE) -> Proposals:
    """A filter that holds all that `already` holds, and the phrases (lang, phrase; written). It grows with their number up to `MOST_BITS`.

    The number of bits is a power of two, so a filter grows by repetition: every phrase in it is in the longer one, too.
    """
    size = already.size + phrases.count()
    slots = len(already.bitmap)
    while 64 * slots < min(MOST_BITS, size * BITS_EACH):
        slots *= 2

    def places(batches):
        import pyarrow as pa

        bitmap = np.zeros(slots, np.uint64)
        for batch in batches:
            for place in Proposals.places(_phrase_hashes(batch), 64 * slots):
                np.bitwise_or.at(bitmap, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        used = np.flatnonzero(bitmap)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bitmap[used].view(np.int64))], ["slot", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(frugal(places), "slot long, bits long").groupBy("slot").agg(
        F.expr("bit_or(bits)").alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
    bitmap = np.tile(already.bitmap, slots // len(already.bitmap))
    bitmap[found["slot"].to_numpy()] |= found["bits"].to_numpy().view(np.uint64)
    return Proposals(bitmap, size)


def _phrase_hashes(batch) -> np.ndarray:
    """Hashes of the phrases in a batch of (lang, phrase)."""
    if not batch.num_rows:
        return np.zeros(0, np.uint64)
    known = batch.column(0).dictionary_encode()
    value = np.array([language_hash(lang) for lang in known.dictionary.to_pylist()])[known.indices.to_numpy()]
    phrases = [phrase.split(b" ") for phrase in batch.column(1).cast("binary").to_pylist()]
    sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
    begins = np.cumsum(sizes) - sizes
    words = word_hashes(list(chain.from_iterable(phrases)))
    for k in range(int(sizes.max())):
        more = np.flatnonzero(sizes > k)
        value[more] = longer(value[more], words[begins[more] + k])
    return value


def _not_proposed(frequent: DataFrame, proposals: Proposals) -> DataFrame:
    """The phrases (lang, phrase) that the filter doesn't hold."""
    shared = frequent.sparkSession.sparkContext.broadcast(proposals.bitmap)

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(~Proposals(shared.value).holds(_phrase_hashes(batch))))

    return frequent.select("lang", "phrase").mapInArrow(frugal(look), "lang string, phrase string")


def mine(docs: DataFrame, minimum: int, longest: int = LONGEST, proposals: Proposals = NONE, name: str = "phrases") -> tuple[DataFrame, Proposals]:
    """All phrases of (lang, text) rows that occur at least `minimum` times, as (lang, words, phrase, n), and the proposals that were enough to find them.

    Exact whatever is proposed: passes go on until every frequent phrase that could grow is among the proposals.
    """
    before, now, frequent = None, proposals, None
    while True:
        counted = count_pass(docs, before, now, minimum, longest, name)
        frequent = counted if frequent is None else frequent.unionByName(counted)
        failed = written(_not_proposed(counted.where(F.col("words").between(1, longest - 1)), now), f"{name}-failed")
        if failed.isEmpty():
            return frequent, now
        before, now = now, proposed(failed, now)


def sample_of(docs: DataFrame, percent: int = SAMPLE_PERCENT) -> DataFrame:
    """The rows drawn for the sample, by a hash of all that a row says."""
    return docs.where(F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(100)) < percent)


def frequent_phrases(
    docs: DataFrame,
    minimum: int = MINIMUM,
    longest: int = LONGEST,
    sample_percent: int = SAMPLE_PERCENT,
    sample_minimum: int = SAMPLE_MINIMUM,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(lang, words, phrase, n): all phrases of up to `longest` words that occur at least `minimum` times in a language, and its number of words (phrase of no words)."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    found, proposals = mine(sample_of(rows, sample_percent).select("lang", "text"), sample_minimum, longest - 1, name="phrases-sample")
    proposals = proposed(found.where(F.col("words") == longest - 1), proposals)
    return mine(rows.select("lang", "text"), minimum, longest, proposals)[0]


def collocations(frequent: DataFrame, top: int = TOP, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language, from the table of `frequent_phrases`."""
    known = frequent.where("words > 0").select("lang", "phrase", "n")
    candidates = frequent.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    def part(begin: Column | int, size: Column | int) -> Column:
        return F.array_join(F.slice("w", begin, size), " ")

    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("right"))
    lefts = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    # Integers of 38 digits: products may pass 64 bits.
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).select(
        "lang", "phrase", "a", F.struct(score.cast("long").alias("score"), "cut", "l", "r").alias("at"))
    scored = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("at").alias("at"))
    # The runs inside longer candidates, with the most frequent of these.
    inner = candidates.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size")).select(
        "lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("begin")).select(
        "lang", part(F.col("begin"), F.col("size")).alias("phrase"), "a")
    covers = inner.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    covered = F.coalesce(F.col("cover") * F.lit(100).cast("decimal(3,0)") >= F.col("a") * F.lit(covered_percent).cast("decimal(3,0)"), F.lit(False))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = (
        scored.join(covers, ["lang", "phrase"], "left").where(~covered)
        .select("lang", "phrase", "a", "at.l", "at.r", "at.score")
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    )
    totals = frequent.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_SQL = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(k))),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
cuts AS (
  SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS ws, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1),
scores AS (
  SELECT c.lang, c.phrase, c.a, x.n AS l, y.n AS r, c.cut, CAST(2000000 AS HUGEINT) * c.a // (x.n + y.n) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.ws, 1, c.cut), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.ws, c.cut + 1, len(c.ws)), ' ')),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, n, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, n, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i
        FROM (SELECT lang, n, string_split(phrase, ' ') AS ws FROM f WHERE k > 2), (VALUES (2), (3)) AS v(k) WHERE k < len(ws))),
covers AS (SELECT lang, phrase, max(n) AS cover FROM inside GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN covers USING (lang, phrase) WHERE cover IS NULL OR 100 * cover < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(totals.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", _SQL)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(frequent_phrases(spark.read.parquet(f"{folder}/documents.parquet")))
