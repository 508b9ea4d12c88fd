"""Raw sources to one labelled corpus: column discovery, normalisation, union, guard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import settings
from wardline.functions.text import long_enough, row_key, strip_text


@dataclass(frozen=True)
class SourceSpec:
    """How one raw source maps to (text, label, source, attack_type).

    Exactly one of `label` (constant), `label_col` (native) and `attack_split` (positive when the split name
    contains it) says where labels come from. `attack_types` names benign and positive rows.
    """

    name: str
    text_col: str
    id_col: str = "row_id"
    turn_col: str | None = None
    split_col: str = "split"
    text_hints: tuple[str, ...] = ()
    label: int | None = None
    label_col: str | None = None
    label_hints: tuple[str, ...] = ()
    missing_label: int = 0
    positive_words: tuple[str, ...] = ()
    attack_split: str | None = None
    attack_types: tuple[str, str] = ("benign", "benign")
    conversation_col: str | None = None
    role_col: str | None = None
    role_value: str | None = None
    toxic_col: str | None = None
    include_in_training: bool = True
    licence: str = ""


# Source names, columns, label words and attack types, in training order.
_WORDS = ("1", "injection", "injected", "malicious", "attack")
TRAINING_SOURCES: tuple[SourceSpec, ...] = (
    SourceSpec("wildchat", "content", label=0, conversation_col="conversation", role_col="role", role_value="user",
               toxic_col="toxic", licence="ODC-BY"),
    SourceSpec("oasst1", "text", label=0, role_col="role", role_value="prompter", licence="Apache-2.0"),
    SourceSpec("neuralchemy", "text", text_hints=("text", "prompt", "input"), label_col="label",
               label_hints=("label", "class", "target"), missing_label=0, positive_words=_WORDS,
               attack_types=("benign", "direct_override"), licence="Apache-2.0"),
    SourceSpec("advbench", "prompt", text_hints=("prompt", "text"), label=1, attack_types=("jailbreak", "jailbreak"),
               licence="MIT"),
    SourceSpec("tensor_trust", "attack", text_hints=("attack", "prompt", "text"), attack_split="attack",
               attack_types=("benign", "direct_override"), licence="Apache-2.0"),
)
EVAL_SOURCE = SourceSpec("rogue_benchmark", "prompt", text_hints=("prompt", "text"), label_col="label",
                         label_hints=("label",), missing_label=1, positive_words=("1", "injection", "attack", "malicious"),
                         attack_types=("unknown", "unknown"), include_in_training=False, licence="CC-BY-NC-4.0")


def resolve_column(columns: Sequence[str], wanted: str, hints: Sequence[str], first: bool) -> str | None:
    """The wanted column, else the first whose lower-case name contains a hint, else the first or none."""
    if wanted in columns:
        return wanted
    hinted = [c for c in columns if any(h in c.lower() for h in hints)]
    return hinted[0] if hinted else (columns[0] if first else None)


def resolve_columns(df: DataFrame, spec: SourceSpec) -> tuple[str, str | None]:
    """(text column, label column or None), from the schema alone."""
    text = resolve_column(df.columns, spec.text_col, spec.text_hints, first=True)
    label = resolve_column(df.columns, spec.label_col, spec.label_hints, first=False) if spec.label_col else None
    return text, label


def normalize_label(df: DataFrame, column: str, positive_words: Sequence[str]) -> Column:
    """Text: 1 for the positive words in any case (not stripped), else 0. Numbers are cut off to integers.

    A null label has no reading and stays null; `reject_unlabelled` separates such rows.
    """
    label = F.col(column)
    kind = df.schema[column].dataType.typeName()
    if kind == "string":
        return F.when(label.isNotNull(), F.lower(label).isin(*positive_words).cast("int"))
    return label.cast("int")


def user_turns(df: DataFrame, conversation_col: str, content_col: str = "content") -> DataFrame:
    """One row per turn of a nested conversation: adds `turn`, `role` and the turn's text."""
    keep = [c for c in df.columns if c != conversation_col]
    return df.select(*keep, F.posexplode(conversation_col).alias("turn", "_t")).select(
        *keep, "turn", F.col("_t.role").alias("role"), F.col(f"_t.{content_col}").alias(content_col)
    )


def filter_toxic(df: DataFrame, toxic_col: str = "toxic") -> DataFrame:
    """Leave out flagged rows; an unknown flag keeps the row."""
    return df.where(~F.coalesce(F.col(toxic_col).cast("boolean"), F.lit(False)))


def filter_toxic_by_labels(df: DataFrame, labels: DataFrame, id_col: str, toxic_col: str = "toxic") -> DataFrame:
    """The same with the flags in a table of their own."""
    flagged = labels.where(F.col(toxic_col).cast("boolean")).select(id_col)
    return df.join(flagged, id_col, "left_anti")


def normalise(df: DataFrame, spec: SourceSpec, rank: int = 0) -> DataFrame:
    """(row_key, source_rank, text, label, source, attack_type) of one raw source: a projection and filters."""
    turn_col = spec.turn_col
    if spec.conversation_col and spec.conversation_col in df.columns:
        df, turn_col = user_turns(df, spec.conversation_col, spec.text_col), "turn"
    if spec.toxic_col and spec.toxic_col in df.columns:
        df = filter_toxic(df, spec.toxic_col)
    if spec.role_col:
        df = df.where(F.col(spec.role_col) == spec.role_value)
    text_col, label_col = resolve_columns(df, spec)
    if spec.label is not None:
        label = F.lit(spec.label)
    elif spec.attack_split:
        label = F.contains(F.lower(spec.split_col), F.lit(spec.attack_split)).cast("int")
    elif label_col is None:
        label = F.lit(spec.missing_label)
    else:
        label = normalize_label(df, label_col, spec.positive_words)
    benign, positive = spec.attack_types
    return (
        df.select(
            row_key(F.lit(rank), F.col(spec.id_col), F.col(turn_col) if turn_col else None).alias("row_key"),
            F.lit(rank).alias("source_rank"),
            strip_text(F.col(text_col).cast("string")).alias("text"),
            label.cast("int").alias("label"),
            F.lit(spec.name).alias("source"),
        )
        .where(long_enough("text"))
        .withColumn("attack_type", F.when(F.col("label") == 1, positive).otherwise(benign))
    )


def reject_unlabelled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a label, rows whose label was null)."""
    return df.where(F.col("label").isNotNull()), df.where(F.col("label").isNull())


def union_sources(frames: dict[str, DataFrame], specs: Sequence[SourceSpec] = TRAINING_SOURCES) -> DataFrame:
    """UNION ALL of the sources meant for training, in the order of `specs`; absent ones add nothing."""
    parts = [
        normalise(frames[s.name], s, rank)
        for rank, s in enumerate(specs)
        if s.include_in_training and s.name in frames
    ]
    if not parts:
        raise ValueError("no training rows: none of the sources is present")
    return reduce(DataFrame.unionByName, parts)


def eval_only_guard(df: DataFrame, mark: str = settings.EVAL_ONLY_MARK) -> DataFrame:
    """Fail the job if a row comes from an evaluation-only source.

    The check sits in a filter because a filter runs whichever columns are read afterwards.
    """
    message = F.concat(F.lit("evaluation-only source in training data: "), F.col("source"))
    clean = ~F.contains(F.lower("source"), F.lit(mark))
    return df.where(F.assert_true(clean, message).isNull())


def to_schema(df: DataFrame) -> DataFrame:
    """The four corpus columns with their types."""
    return df.select(
        F.col("text").cast("string").alias("text"),
        F.col("label").cast("int").alias("label"),
        F.col("source").cast("string").alias("source"),
        F.col("attack_type").cast("string").alias("attack_type"),
    )
