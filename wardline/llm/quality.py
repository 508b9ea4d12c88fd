"""Quality by attention-based multiple-instance learning (operator 3).

A document is a bag of passages of 64 words. Every passage of every text is encoded (hashed byte trigrams and measures of
shape, through one learned layer); gated attention, learned from document labels alone, weighs the passages; the weighted
sum is scored by a logistic unit. The model is a few thousand numbers, fitted on a bounded sample: at most `max_docs` labelled
documents (those with the smallest hash of their id, half of either label where there are enough) of at most
`max_passages` passages each, drawn by a hash of their features; how many there are in truth stays a feature. Scoring is one pass over whole texts without a shuffle.

Null and empty texts are one passage without content and get a score like any other. Repeated rows get equal scores (rounded to five places). A
label row that is null is ignored; of several for one document the smallest counts. Without labels of both kinds
every score is the share of label 1 among them (0.5 if there are none). An empty table gives no rows. Input columns
named like the results are replaced by them. A row without an id is scored, never learned from, and not held out.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.catalog.registry import query
from wardline.llm.common import PrefixHash, frugal, mix, word_spans

PASSAGE_WORDS = 64
HASHED = 256
SHAPES = 11
_CHUNK_BYTES = 1 << 19

_kinds = np.zeros((6, 256), np.float32)  # upper case, digits, marks, symbols, line ends, bytes outside ASCII
_kinds[0, 65:91] = _kinds[1, 48:58] = _kinds[4, 10] = _kinds[5, 128:] = 1
_kinds[2, [ord(c) for c in "!?,;:.\"'()"]] = 1
_kinds[3, [ord(c) for c in "#*$%&|<>=+^~_\\/{}[]@"]] = 1


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts (rows), and how many each text has (one at least)."""
    # Two line ends after each text, so that no trigram reaches from one into the next.
    data = np.frombuffer(b"".join(text + b"\n\n" for text in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    begins = np.cumsum(sizes) - sizes
    starts, ends = word_spans(data)
    doc_of_word = np.searchsorted(begins, starts, "right") - 1
    words = np.bincount(doc_of_word, minlength=len(texts))
    counts = np.maximum(1, -(-words // PASSAGE_WORDS))
    first = np.cumsum(counts) - counts
    n = int(counts.sum())
    in_doc = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    of_word = first[doc_of_word] + in_doc // PASSAGE_WORDS
    # A passage reaches from its first word to the next passage; the first one from the start of its text.
    opens = np.empty(n, np.int64)
    opens[of_word[in_doc % PASSAGE_WORDS == 0]] = starts[in_doc % PASSAGE_WORDS == 0]
    opens[first] = begins
    of_byte = np.repeat(np.arange(n), np.diff(np.append(opens, len(data))))
    size = np.maximum(1, np.bincount(of_byte, minlength=n)).astype(np.float32)
    n_words = np.bincount(of_word, minlength=n)
    per_word = np.maximum(1, n_words)
    out = np.zeros((n, HASHED + SHAPES), np.float32)
    if len(data) > 2:
        b = data.astype(np.uint32)
        code = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> 24
        own = np.ones(len(data), bool)
        own[begins + sizes - 1] = own[begins + sizes - 2] = False
        cells = (of_byte[:-2] * HASHED + code)[own[:-2]]
        out[:, :HASHED] = np.log1p(np.bincount(cells, minlength=n * HASHED).reshape(n, HASHED))
    for k, kind in enumerate(_kinds):
        out[:, HASHED + k] = np.bincount(of_byte, kind[data], n) / size
    hashes = PrefixHash(data).slices(starts, ends)
    with np.errstate(over="ignore"):
        own = mix(hashes + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, sample = np.unique(own, return_index=True)
    again = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    out[:, HASHED + 6] = np.bincount(of_word, ends - starts, n) / per_word / 10
    out[:, HASHED + 7] = n_words / PASSAGE_WORDS
    out[:, HASHED + 8] = np.bincount(of_word[sample], minlength=n) / per_word
    out[:, HASHED + 9] = np.bincount(of_word[1:][again], minlength=n) / per_word
    out[:, HASHED + 10] = np.log1p(np.repeat(counts, counts)) / 10
    return out, counts


def in_chunks(texts: list[bytes]):
    """The texts in runs of bounded size; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > _CHUNK_BYTES:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(model: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Encoded passages, attention and document probabilities of bags of `counts` rows each."""
    begins = np.cumsum(counts) - counts
    h = np.tanh((x - model["mean"]) / model["std"] @ model["encode"] + model["encode_bias"])
    t, s = np.tanh(h @ model["v"]), _sigmoid(h @ model["u"])
    e = (t * s) @ model["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, begins), counts))
    a = e / np.repeat(np.add.reduceat(e, begins), counts)
    z = np.add.reduceat(h * a[:, None], begins)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ model["c"] + model["bias"])}


def _gradients(model, x, counts, y, weight):
    f = forward(model, x, counts)
    h, t, s, a = f["h"], f["t"], f["s"], f["a"]
    d = (f["p"] - y) * weight / weight.sum()
    dz = np.repeat(d[:, None] * model["c"], counts, axis=0)
    da = (h * dz).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, np.cumsum(counts) - counts), counts))
    dg = de[:, None] * model["w"]
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ model["v"].T + ds @ model["u"].T) * (1 - h * h)
    return {
        "encode": ((x - model["mean"]) / model["std"]).T @ dh, "encode_bias": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds,
        "w": (t * s).T @ de, "c": f["z"].T @ d, "bias": d.sum(keepdims=True),
    }


def fit_bags(bags: list[np.ndarray], labels: np.ndarray, width: int = 32, gates: int = 16, epochs: int = 12,
             batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit by Adam; both labels weigh the same."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    n = every.shape[1]
    model = {
        "encode": rng.normal(0, n**-0.5, (n, width)), "encode_bias": np.zeros(width), "v": rng.normal(0, 0.2, (width, gates)),
        "u": rng.normal(0, 0.2, (width, gates)), "w": rng.normal(0, 0.2, gates), "c": rng.normal(0, 0.2, width), "bias": np.zeros(1),
    }
    model = {k: v.astype(np.float32) for k, v in model.items()}
    trained = list(model)
    model |= {"mean": every.mean(0), "std": every.std(0) + np.float32(0.05)}
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    first = {k: np.zeros_like(model[k]) for k in trained}
    second = {k: np.zeros_like(model[k]) for k in trained}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = np.concatenate([bags[i] for i in pick])
            counts = np.array([len(bags[i]) for i in pick])
            grads = _gradients(model, x, counts, labels[pick].astype(np.float32), weights[pick])
            step += 1
            for k in trained:
                g = grads[k] + decay * model[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                up = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                model[k] = (model[k] - rate * up).astype(np.float32)
    return model


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of an id's decimal text modulo `divisor`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_passages: int = 96, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> dict[str, np.ndarray]:
    """Fit on a bounded sample of the labelled documents of `docs` (at most `max_docs` texts reach the driver, as features)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(
        F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    sample = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2)
        sample = part if sample is None else sample.unionByName(part)

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            ids, out = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                x, _ = passages([text])
                if len(x) > max_passages:
                    drawn = sorted(range(len(x)), key=lambda k: (zlib.crc32(x[k].tobytes()), k))[:max_passages]
                    x = x[sorted(drawn)]
                ids.append(doc_id)
                out.append(x.tobytes())
            labels_of = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([labels_of[i] for i in ids], pa.int32()), pa.array(out, pa.binary())],
                ["doc_id", "label", "bag"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(
        F.broadcast(sample), "doc_id")  # max_docs rows at most
    rows = chosen.mapInArrow(frugal(encode), "doc_id long, label int, bag binary").orderBy(
        F.xxhash64("doc_id"), "doc_id", F.crc32("bag")).limit(max_docs).collect()
    y = np.array([r.label for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return {"constant": np.array([y.mean() if len(y) else 0.5])}
    return fit_bags([np.frombuffer(r.bag, np.float32).reshape(-1, HASHED + SHAPES) for r in rows], y)


def score(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (default all), `score` (0 to 1) and `predicted` (1 from a score of 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if keep is None or c in keep]
    rest = docs.select(*[F.col(f"`{c}`") for c in names if c.lower() not in ("score", "predicted")])
    n = len(rest.columns)
    if text_col in rest.columns:
        given, place = rest, rest.columns.index(text_col)
    else:
        given, place = docs.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(text_col).alias("__text")), n

    def probabilities(texts):
        for run in in_chunks(texts):
            if "constant" in shared.value:
                yield np.full(len(run), shared.value["constant"][0])
            else:
                yield forward(shared.value, *passages(run))["p"].astype(np.float64)

    def add(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or b"" for t in batch.column(place).cast(pa.binary()).to_pylist()]
            p = np.round(np.concatenate([np.zeros(0), *probabilities(texts)]), 5)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                [*batch.schema.names[:n], "score", "predicted"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return given.mapInArrow(frugal(add), T.StructType([*rest.schema.fields, *added]))


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """A model from the labels of documents that are not held out."""
    return fit(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))


@query("op3_quality_mil")
def op3_quality_mil(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")
