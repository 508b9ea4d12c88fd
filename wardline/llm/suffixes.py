"""Exact repeats of long byte strings, by a hash-compared suffix sort (operator 5).

A byte is removed when a string of `length` bytes around it also starts anywhere else, the same text included. Only suffixes that
could repeat are sorted. Every window of `length` bytes chooses an anchor in itself by content alone (the smallest hash of its
50-byte pieces), so equal windows choose equal anchors; the windows of one anchor span a short context. Anchors that occur
once are dropped by counting. Where all contexts of an anchor are equal, all its windows repeat. The contexts that differ are gathered,
one of each kind, and the suffixes at their window starts are sorted (of a context that occurs more than once all windows repeat; where one occurs once, its place is known): prefix polynomial hashes and binary search give the
common extension of two suffixes in logarithmic time, a mergesort uses it as its comparison, and neighbours that agree in `length`
bytes are compared byte by byte before they count.

Equality of whole contexts rests on two 64-bit hashes (anchor and context). An anchor with more than `GROUP_CONTEXTS` different contexts is not
gathered: its windows are counted by their hashes in a shuffle with partial sums, so no task holds an unbounded group.

Null text is empty. Rows are told apart by id and text; a row given twice repeats itself. Texts shorter than `length`
repeat nothing. Null ids are ids like others. An empty table gives no rows. Long texts are handled in pieces of
260,000 windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.registry import query
from wardline.llm.common import PrefixHash, frugal, frugal_group, id_and_text, mix, window_minima
from wardline.workdir import written

LENGTH = 200
PIECE = 50
GROUP_CONTEXTS = 2000
_WINDOWS_AT_ONCE = 1 << 18
_SUFFIXES_AT_ONCE = 1 << 18


def anchors(data: np.ndarray, length: int = LENGTH, piece: int = PIECE):
    """Yields arrays (start, windows, offset, anchor, context): runs of windows with one anchor, `offset` bytes into the run."""
    for begin in range(0, len(data) - length + 1, _WINDOWS_AT_ONCE):
        part = data[begin : begin + _WINDOWS_AT_ONCE + length - 1]
        table = PrefixHash(part)
        at = np.arange(len(part) - piece + 1)
        values = mix(table.slices(at, at + piece))
        chosen = window_minima(values, length - piece + 1)
        start = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        windows = np.diff(np.append(start, len(chosen)))
        spot = chosen[start]
        context = mix(table.slices(start, start + windows - 1 + length))
        yield start + begin, windows, spot - start, values[spot].view(np.int64), context.view(np.int64)


def common_extension(table: PrefixHash, p: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
    """Of suffixes at p and q, how many bytes agree, up to `length`: binary search over prefix hashes."""
    low = np.zeros(len(p), np.int64)
    high = np.full(len(p), length, np.int64)
    same = table.slices(p, p + length) == table.slices(q, q + length)
    low[same] = length
    open_ = np.flatnonzero(~same)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        a, b = p[open_], q[open_]
        equal = table.slices(a, a + middle) == table.slices(b, b + middle)
        low[open_[equal]] = middle[equal]
        high[open_[~equal]] = middle[~equal]
        open_ = open_[high[open_] - low[open_] > 1]
    return low


def sort_suffixes(data: np.ndarray, table: PrefixHash, at: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """Mergesort of the suffixes `at` within equal, adjacent values of `segment`; returns their order.

    All runs of a level are merged together: a suffix finds its place in the sibling run by binary search.
    """
    n = len(at)
    begin_of = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin_of, n))
    first, last = np.repeat(begin_of, size), np.repeat(begin_of + size, size)
    order, place = np.arange(n), np.arange(n)

    def before(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        p, q = at[order[x]], at[order[y]]
        same = common_extension(table, p, q, length)
        whole = same == length
        step = np.where(whole, 0, same)
        return np.where(whole, or_equal, data[p + step] < data[q + step])

    width = 1
    while width < (size.max() if n else 0):
        run = first + (place - first) // width * width
        odd = (run - first) // width % 2 == 1
        low = np.where(odd, run - width, np.minimum(run + width, last))
        high = np.minimum(np.where(odd, run, run + 2 * width), last)
        high = np.maximum(high, low)
        begin = low.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            # A suffix of the odd run goes behind equal ones of the even run, so the sort is stable.
            less = before(middle, open_, odd[open_])
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        target = np.where(odd, run - width, run) + (place - run) + (low - begin)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def repeated_windows(contexts: list[bytes], group: np.ndarray, offset: np.ndarray, windows: np.ndarray,
                     many: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows are found in another context of its group (or in itself, if it occurs more than once).

    Equal windows stand at the same distance from their anchor, so suffixes are sorted by group and distance first.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    table = PrefixHash(data)
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    base = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(contexts)), windows)
    within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[owner] + within
    distance = within - offset[owner]
    order = np.lexsort((distance, group[owner]))
    owner, at, distance = owner[order], at[order], distance[order]
    segment = np.cumsum(np.concatenate(([0], (np.diff(group[owner]) != 0) | (np.diff(distance) != 0))))
    ranked = sort_suffixes(data, table, at, segment, length)
    p, q = at[ranked[:-1]], at[ranked[1:]]
    close = np.flatnonzero((segment[1:] == segment[:-1]) & (table.slices(p, p + length) == table.slices(q, q + length)))
    for k in range(0, len(close), 100_000):  # collision verification
        piece = close[k : k + 100_000]
        lines = np.lib.stride_tricks.sliding_window_view(data, length)
        if not np.array_equal(lines[p[piece]], lines[q[piece]]):
            raise ArithmeticError("two windows share a hash; sort again with another multiplier")
    hit = np.zeros(len(at), bool)
    hit[ranked[close]] = hit[ranked[close + 1]] = True
    back = np.empty(len(at), bool)
    back[order] = hit
    back |= np.repeat(many > 1, windows)
    return np.split(back, np.cumsum(windows)[:-1])


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """(doc_id, text_hash, spans): for each text with repeats, the byte ranges (from, to) they cover; ranges may overlap."""
    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))

    def find(batches):
        import pyarrow as pa

        names = ["doc_id", "text_hash", "start", "windows", "offset", "anchor", "context"]
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            held, size = [], 0
            for i, text in enumerate(texts):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for found in anchors(data, length):
                    held.append((np.full(len(found[0]), i), *found))
                    size += len(found[0])
                if held and (size > 200_000 or i == len(texts) - 1):
                    which, *arrays = (np.concatenate(x) for x in zip(*held))
                    held, size = [], 0
                    which = pa.array(which)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(which), batch.column(2).take(which),
                         *(pa.array(a.astype(np.int32)) for a in arrays[:3]), *map(pa.array, arrays[3:])], names)
            if held:
                which, *arrays = (np.concatenate(x) for x in zip(*held))
                which = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), batch.column(2).take(which),
                     *(pa.array(a.astype(np.int32)) for a in arrays[:3]), *map(pa.array, arrays[3:])], names)

    anchored = written(rows.mapInArrow(
        frugal(find), "doc_id long, text_hash long, start int, windows int, offset int, anchor long, context long"), "suffix-anchors")
    # Contexts are counted once; the one join of places brings what is known of their context. Both sides are written, so that
    # the join has a shuffle of its own, whose large partitions Spark can split.
    contexts = written(anchored.groupBy("anchor", "context").agg(F.count("*").alias("many")), "suffix-contexts")
    repeated = contexts.groupBy("anchor").agg(F.sum("many").alias("n"), F.count("*").alias("kinds")).where("n > 1")
    known = written(contexts.join(repeated, "anchor").select(
        "anchor", "context", "many", (F.col("kinds") > 1).alias("mixed")), "suffix-repeated")
    candidates = written(anchored.join(known, ["anchor", "context"]), "suffix-candidates")

    # Contexts that occur more than once repeat whole, whether or not their anchor has others.
    copied = candidates.where("many > 1").select(
        "doc_id", "text_hash", F.col("start").alias("begin"), (F.col("start") + F.col("windows") - 1 + length).alias("end"))

    kinds = written(candidates.where("mixed").groupBy("anchor", "context", "many").agg(
        F.min(F.struct("doc_id", "text_hash", "start", "windows", "offset")).alias("at")
    ).select("anchor", "context", "many", "at.*"), "suffix-kinds")
    crowded = written(kinds.groupBy("anchor").count().where(F.col("count") > group_contexts).select("anchor"), "suffix-crowded")
    wanted = kinds.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("anchor", "context", "many", "start", "windows", "offset")).alias("contexts"))
    held = compressed(rows).join(
        wanted.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "contexts"),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("packed", "contexts", "doc_id", "text_hash").mapInArrow(
        frugal(_slicer(length)), "anchor long, context long, many long, start int, windows int, offset int, "
        "doc_id long, text_hash long, bytes binary")
    # A text given twice is met twice by its contexts.
    held = written(held, "suffix-bytes")
    crowd = not crowded.isEmpty()
    calm = held.join(crowded, "anchor", "left_anti") if crowd else held
    buckets = kinds.count() // 20_000 + 1

    def sort_bucket(group):
        import pandas as pd

        group = group.drop_duplicates(["anchor", "context"]).sort_values("anchor", kind="stable")
        anchor, windows = group["anchor"].to_numpy(), group["windows"].to_numpy(np.int64)
        # Whole anchors, some 260,000 suffixes at once.
        edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
        total = np.concatenate(([0], np.cumsum(windows)))
        out, begin = [], 0
        while begin < len(edge) - 1:
            end = begin + 1
            while end < len(edge) - 1 and total[edge[end + 1]] - total[edge[begin]] <= _SUFFIXES_AT_ONCE:
                end += 1
            part = group.iloc[edge[begin] : edge[end]]
            begin = end
            masks = repeated_windows(
                part["bytes"].tolist(), part["anchor"].to_numpy(), part["offset"].to_numpy(np.int64),
                part["windows"].to_numpy(np.int64), part["many"].to_numpy(), length)
            alone = np.flatnonzero(part["many"].to_numpy() == 1).tolist()
            runs = [_runs(masks[k]) for k in alone]
            found = part.iloc[alone][["name", "text_hash", "start"]]
            out.append(found.assign(low=[r[0].astype(np.int32) for r in runs], high=[r[1].astype(np.int32) for r in runs]))
        return pd.concat(out)

    verdict_schema = "name string, text_hash long, start int, low array<int>, high array<int>"
    # Ids as text: Pandas would make longs beside nulls inexact.
    calm = calm.withColumn("name", F.col("doc_id").cast("string")).drop("doc_id")
    verdicts = calm.groupBy(F.pmod("anchor", F.lit(buckets)).alias("bucket")).applyInPandas(
        frugal_group(sort_bucket), verdict_schema).withColumn("doc_id", F.col("name").cast("long")).drop("name")
    if crowd:
        verdicts = verdicts.unionByName(_counted_windows(held.join(crowded, "anchor", "left_semi"), length))
    alone = verdicts.select("doc_id", "text_hash", "start", F.explode(F.arrays_zip("low", "high")).alias("r")).select(
        "doc_id", "text_hash", (F.col("start") + F.col("r.low")).alias("begin"),
        (F.col("start") + F.col("r.high") - 1 + length).alias("end"))
    # Rows equal in id and text name the same ranges: a set.
    return alone.unionByName(copied).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("begin", "end")).alias("spans"))


def _slicer(length: int):
    def cut(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            press = zstandard.ZstdDecompressor()
            names = ["anchor", "context", "many", "start", "windows", "offset"]
            columns, held, size, owner = {n: [] for n in names}, [], 0, []
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

            def flush():
                arrays = [pa.concat_arrays(columns[n]).cast(k) for n, k in zip(names, kinds)]
                own = [batch.column(k).take(pa.array(owner, pa.int64())) for k in (2, 3)]
                return pa.RecordBatch.from_arrays([*arrays, *own, pa.array(held, pa.binary())], [*names, "doc_id", "text_hash", "bytes"])

            for k, (packed, wanted) in enumerate(zip(batch.column(0), batch.column(1))):
                text = press.decompress(packed.as_buffer())
                values = wanted.values
                starts, windows = values.field("start").to_pylist(), values.field("windows").to_pylist()
                held += [text[s : s + w - 1 + length] for s, w in zip(starts, windows)]
                for n in names:
                    columns[n].append(values.field(n))
                size += len(starts)
                owner += [k] * len(starts)
                if size > 20_000:
                    yield flush()
                    columns, held, size, owner = {n: [] for n in names}, [], 0, []
            if held:
                yield flush()

    return cut


def _counted_windows(held: DataFrame, length: int) -> DataFrame:
    """Verdicts of contexts of crowded anchors that occur once: a window repeats unless its hash is counted once among those of its anchor."""

    def explode(batches):
        import pyarrow as pa

        for batch in batches:
            for anchor, context, many, windows, offset, text in zip(*(column.to_pylist() for column in batch.columns)):
                at = np.arange(windows)
                hashes = mix(PrefixHash(np.frombuffer(text, np.uint8)).slices(at, at + length)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(windows, anchor)), pa.array(np.full(windows, context)), pa.array(np.full(windows, many)),
                     pa.array(at.astype(np.int32)), pa.array((at - offset).astype(np.int32)), pa.array(hashes)],
                    ["anchor", "context", "many", "place", "distance", "hash"])

    held = held.dropDuplicates(["anchor", "context"])
    windows = held.select("anchor", "context", "many", "windows", "offset", "bytes").mapInArrow(
        frugal(explode), "anchor long, context long, many long, place int, distance int, hash long")
    # A window counted once is the only row of its group, so the smallest context and place are its own.
    single = windows.groupBy("anchor", "distance", "hash").agg(
        F.sum("many").alias("n"), F.min("context").alias("context"), F.min("place").alias("place")
    ).where("n = 1").groupBy("anchor", "context").agg(F.collect_list("place").alias("places"))

    def spans(batches):
        import pyarrow as pa

        for batch in batches:
            low, high = [], []
            for windows, places in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                mask = np.ones(windows, bool)
                mask[places or []] = False
                a, b = _runs(mask)
                low.append(a.tolist())
                high.append(b.tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(low, pa.list_(pa.int32())), pa.array(high, pa.list_(pa.int32()))],
                ["doc_id", "text_hash", "start", "low", "high"])

    return held.where("many = 1").join(single, ["anchor", "context"], "left").select(
        "doc_id", "text_hash", "start", "windows", "places").mapInArrow(
        frugal(spans), "doc_id long, text_hash long, start int, low array<int>, high array<int>")


def compressed(rows: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash) -> (doc_id, text_hash, packed), for the shuffles that bring texts to their spans."""

    def pack(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [press.compress(t.as_buffer()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["doc_id", "text_hash", "packed"])

    return rows.select("doc_id", "text", "text_hash").mapInArrow(frugal(pack), "doc_id long, text_hash long, packed binary")


def _without_spans(text: bytes, spans) -> tuple[np.ndarray, int]:
    """Which bytes stay, and how many maximal runs go; `spans` is an Arrow scalar, null without repeats."""
    if not spans.is_valid:
        return np.ones(len(text), bool), 0
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, spans.values.field("begin").to_numpy(), 1)
    np.add.at(change, spans.values.field("end").to_numpy(), -1)
    gone = np.cumsum(change[:-1]) > 0
    return ~gone, len(_runs(gone)[0])


def _with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    spans = spans.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "spans")
    return rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").drop("d", "h")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) of every row."""
    spans = repeated_spans(docs, length, id_col, text_col)
    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))

    def cut(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, sizes, removed, runs = [], [], [], []
            for packed, spans in zip(batch.column(1), batch.column(2)):
                text = press.decompress(packed.as_buffer())
                stays, n = _without_spans(text, spans)
                kept.append(np.frombuffer(text, np.uint8)[stays].tobytes() if n else text)
                sizes.append(len(text))
                removed.append(len(text) - int(stays.sum()))
                runs.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs))],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return _with_spans(compressed(rows), spans).select("doc_id", "packed", "spans").mapInArrow(
        frugal(cut), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`; of the text, the characters of which no byte repeats. Null texts stay null."""
    spans = repeated_spans(docs, length, id_col, text_col)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(own, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"),
                       F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"))
    found = _with_spans(rows.select("row", "doc_id", "text_hash"), spans)
    place = docs.columns.index(text_col)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(place).cast(pa.binary()), batch.column(batch.num_columns - 1)):
                text = text.as_py()
                if text is not None and spans.is_valid:
                    stays, _ = _without_spans(text, spans)
                    data = np.frombuffer(text, np.uint8)
                    lead = (data & 0xC0) != 0x80
                    whole = np.logical_and.reduceat(stays, np.flatnonzero(lead))
                    text = data[np.repeat(whole, np.diff(np.append(np.flatnonzero(lead), len(data))))].tobytes()
                texts.append(text)
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return found.select("row.*", F.col("spans").alias("__spans")).mapInArrow(frugal(cut), docs.schema)


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
