"""The whole corpus preparation: sources, guard, near-dedup, balance, shuffle, split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from wardline import settings
from wardline.operators.corpus import eval_only_guard, reject_unlabelled
from wardline.operators.dedup import near_dedup
from wardline.operators.minhash import minhash_dedup
from wardline.operators.sampling import balance_classes, shuffle_rows, stratified_split
from wardline.sources.writers import write_corpus
from wardline.workdir import job, written


@dataclass(frozen=True)
class PrepareOptions:
    dedup: str = "exact"  # "exact", "minhash" or "off"
    jaccard_percent: int = settings.JACCARD_PERCENT
    benign_share: float = settings.BENIGN_SHARE
    train_share: float = settings.TRAIN_SHARE
    seed: int = settings.SEED


def deduplicated(rows: DataFrame, options: PrepareOptions) -> DataFrame:
    """The rows without near duplicates, unless switched off. Meant for training rows only."""
    if options.dedup == "off":
        return rows
    if options.dedup == "minhash":
        return minhash_dedup(rows)
    return near_dedup(rows, percent=options.jaccard_percent)


def prepare_corpus(training: DataFrame, options: PrepareOptions = PrepareOptions()) -> DataFrame:
    """Normalised training rows to rows marked `train` or `eval`, in shuffled order. Rows without a label are left out.

    Each step that several later ones read is written once to the shared folder.
    """
    rows, _ = reject_unlabelled(written(eval_only_guard(training), "corpus-rows", "zstd"))
    unique = rows if options.dedup == "off" else written(deduplicated(rows, options), "corpus-unique", "zstd")
    balanced = written(balance_classes(unique, options.benign_share, options.seed), "corpus-balanced", "zstd")
    return shuffle_rows(stratified_split(balanced, options.train_share, options.seed), options.seed)


def rejected(training: DataFrame) -> DataFrame:
    """The training rows that `prepare_corpus` leaves out because they have no label."""
    return reject_unlabelled(training)[1]


def prepare_and_write(
    training: DataFrame, benchmark: DataFrame | None, folder: str, options: PrepareOptions = PrepareOptions()
) -> dict[str, str]:
    """Prepare and store a corpus, with the benchmark as it is, and remove all work tables. Returns the paths by file."""
    with job(training.sparkSession):
        return write_corpus(prepare_corpus(training, options), benchmark, folder)
