"""Stage 3 as tables: requests for an outside reviewer, and the parsing of the raw replies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The texts and neutral confidence of the default verdicts.
REQUEST_PREFIX = "USER TEXT:\n"
UNPARSED_REASON = "Failed to parse structured response."
DISABLED_REASON = "Stage 3 is disabled."
ERROR_PREFIX = "Stage 3 error: "
NEUTRAL_CONFIDENCE = 0.5

ERROR_REASON = ERROR_PREFIX + "no verdict"
_UNUSABLE = (False, NEUTRAL_CONFIDENCE, ERROR_PREFIX + "unusable reply")


def each_alone(function: Callable[[pd.Series], pd.Series], batch: pd.Series) -> pd.Series:
    """`function` of a batch; if it fails, of every element alone, with None where it fails again."""
    try:
        return function(batch)
    except Exception:
        if len(batch) == 1:
            return pd.Series([None], index=batch.index)
        return pd.concat([each_alone(function, batch.iloc[i : i + 1]) for i in range(len(batch))])


def one_per_id(verdicts: DataFrame, id_col: str) -> DataFrame:
    """One verdict for each id: the most severe (an injection first, then the greatest confidence, then the last reasoning)."""
    worst = F.max(F.struct("is_injection", "confidence", "reasoning")).alias("v")
    return verdicts.groupBy(id_col).agg(worst).select(id_col, "v.*")


def verdict_requests(ambiguous_rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, request) to hand to a reviewer."""
    return ambiguous_rows.select(id_col, F.concat(F.lit(REQUEST_PREFIX), F.col(text_col)).alias("request"))


def read_reply(reply: str | None) -> tuple[bool, float, str]:
    """(is_injection, confidence, reasoning) of one raw reply, by Python's own rules for JSON, truth, numbers and texts."""
    if reply is None:
        return _UNUSABLE
    text = reply.strip()
    lines = text.split("\n")
    if text.startswith("```") and len(lines) > 2:
        text = "\n".join(lines[1:-1])
    try:
        fields = json.loads(text)
        if not isinstance(fields, dict):
            return _UNUSABLE
        return (
            bool(fields.get("is_injection", False)),
            round(float(fields.get("confidence", NEUTRAL_CONFIDENCE)), 6),
            str(fields.get("reasoning", "")).encode("utf-8", "replace").decode(),
        )
    except ValueError:  # no JSON, or a confidence that is a text without a number
        return "true" in text.lower(), NEUTRAL_CONFIDENCE, UNPARSED_REASON
    except (TypeError, OverflowError, RecursionError):  # a confidence without a numeric reading
        return _UNUSABLE


def parse_verdicts(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Add `is_injection`, `confidence`, `reasoning` read from the reply.

    A JSON object is read as Python reads it: the last of repeated keys holds, `NaN` and `Infinity` are numbers, any non-empty string is
    true, and reasonings that are no texts appear as Python prints them. Anything that is not JSON, or a confidence text that is no number, falls back to looking for
    "true". JSON that is no object, or a confidence without a numeric reading, counts as a reviewer error, as does a null reply.

    Runs on Arrow batches: only replies of ambiguous rows come here, and no SQL reader has all of these rules.
    """

    def read(batch: pa.Array) -> pa.Array:
        flags, confidences, reasons = zip(*(read_reply(reply) for reply in batch.to_pylist())) if len(batch) else ((), (), ())
        # On Arrow arrays a confidence of NaN stays a number; pandas would make it null.
        return pa.StructArray.from_arrays(
            [pa.array(flags, pa.bool_()), pa.array(confidences, pa.float64()), pa.array(reasons, pa.string())], ["is_injection", "confidence", "reasoning"])

    read = F.arrow_udf(read, "is_injection boolean, confidence double, reasoning string")
    # Columns of the input with these names give way to those that are read.
    names = [c for c in replies.columns if c not in ("is_injection", "confidence", "reasoning")]
    return replies.select(*names, read(F.col(reply_col)).alias("_verdict")).select(*names, "_verdict.*")


def resolve_verdicts(
    ambiguous_rows: DataFrame, verdicts: DataFrame | None, id_col: str, error: str = "no verdict"
) -> DataFrame:
    """Every ambiguous row with its verdict, of several the most severe; neutral where the reviewer is off (None) or gave none."""
    if verdicts is None:
        return ambiguous_rows.withColumns({
            "is_injection": F.lit(False),
            "confidence": F.lit(NEUTRAL_CONFIDENCE),
            "reasoning": F.lit(DISABLED_REASON),
        })
    answered = one_per_id(verdicts, id_col)
    return ambiguous_rows.join(answered, id_col, "left").withColumns({
        "is_injection": F.coalesce("is_injection", F.lit(False)),
        "confidence": F.coalesce("confidence", F.lit(NEUTRAL_CONFIDENCE)),
        "reasoning": F.coalesce("reasoning", F.lit(ERROR_PREFIX + error)),
    })


def review_batches(
    requests: DataFrame, id_col: str, review: Callable[[pd.Series], pd.Series], request_col: str = "request"
) -> DataFrame:
    """(id, reply) from an own reviewer that maps a batch of requests to raw replies.

    Where the reviewer fails on a batch, its requests are tried one by one; those that fail alone get null replies,
    which `parse_verdicts` reads as reviewer errors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "reply": each_alone(review, batch[request_col])})

    id_type = requests.schema[id_col].dataType.simpleString()
    return requests.select(id_col, request_col).mapInPandas(run, f"{id_col} {id_type}, reply string")
