"""Seeded exact sampling, class balancing and stratified splitting.

Every draw takes the rows with the smallest `sampling_key`. The key of the last row taken is found from a
histogram of key prefixes (65,536 counts per stratum) and a look into one of its cells, so nothing is sorted
or ranked as a whole and the draw itself is a filter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import settings
from wardline.functions.text import sampling_key
from wardline.workdir import broadcast_if_small, written

_NOTHING, _EVERYTHING = "", "~"  # below and above every hex key


def _draws(df: DataFrame, stratum: Column, purpose: str, seed: int, row_key: str) -> DataFrame:
    """(stratum, draw) of every row, written: the input itself is read once here and once by the draw."""
    return written(
        df.select(stratum.alias("stratum"), sampling_key(row_key, seed, purpose).alias("draw")), "sampling-draws"
    )


def _with_strata(left: DataFrame, right: DataFrame, how: str = "inner", *also: str) -> DataFrame:
    """Join on `stratum` (and `also`), where a null stratum is one like any other."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in ("stratum", *also)})
    same = F.col("stratum").eqNullSafe(F.col("_stratum"))
    for name in also:
        same &= F.col(name) == F.col(f"_{name}")
    return left.join(other, same, how).drop(*[f"_{c}" for c in ("stratum", *also)])


def draw_limits(draws: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per stratum the largest sampling key still drawn.

    `draws` is written; `quotas` is (stratum, quota) with null for "all". A stratum without quota draws nothing.
    """
    cell = F.conv(F.substring("draw", 1, 4), 16, 10).cast("int").alias("cell")
    cells = draws.groupBy("stratum", cell).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("stratum").orderBy("cell"))
    reached = F.struct("cell", (F.col("quota") - F.col("upto") + F.col("n")).alias("take"))
    cuts = written(
        _with_strata(cells.withColumn("upto", upto), quotas)
        .groupBy("stratum")
        .agg(F.min(F.when(F.col("upto") >= F.col("quota"), reached)).alias("cut"))
        .select("stratum", "cut.cell", "cut.take"),
        "sampling-cuts",
    )
    in_cell = (
        _with_strata(draws.withColumn("cell", cell), broadcast_if_small(cuts), "inner", "cell")
        .withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy("draw")))
        .where(F.col("place") == F.col("take"))
        .select("stratum", F.col("draw").alias("last_draw"))
    )
    # A cut that takes no row of its own cell still draws the cells before it; no cut draws everything.
    before_cell = F.lower(F.lpad(F.hex("cell"), 4, "0"))
    last = F.coalesce("last_draw", before_cell, F.lit(_EVERYTHING)).alias("last_draw")
    return written(_with_strata(cuts, in_cell, "left").select("stratum", last), "sampling-limits")


def sample_per_stratum(
    df: DataFrame,
    stratum: Column,
    quotas: Callable[[DataFrame], DataFrame],
    purpose: str,
    seed: int = settings.SEED,
    row_key: str = "row_key",
) -> DataFrame:
    """Add `_drawn`: whether the row is among the rows drawn from its stratum.

    `quotas` turns the sizes (stratum, n) into (stratum, quota).
    """
    draws = _draws(df, stratum, purpose, seed, row_key)
    sizes = draws.groupBy("stratum").agg(F.count("*").alias("n"))
    limits = broadcast_if_small(draw_limits(draws, quotas(sizes)))
    return (
        _with_strata(df.withColumn("stratum", stratum), limits, "left")
        .withColumn("_drawn", sampling_key(row_key, seed, purpose) <= F.coalesce("last_draw", F.lit(_NOTHING)))
        .drop("stratum", "last_draw")
    )


def sample_k(df: DataFrame, k: int, seed: int = settings.SEED, row_key: str = "row_key") -> DataFrame:
    """Exactly min(k, all) rows, without replacement; the same rows for the same seed."""
    quotas = df.sparkSession.range(1).select(F.lit(0).alias("stratum"), F.lit(k).cast("bigint").alias("quota"))
    limit = draw_limits(_draws(df, F.lit(0), "sample", seed, row_key), quotas).first()
    return df.where(sampling_key(row_key, seed, "sample") <= F.lit(limit.last_draw if limit else _NOTHING))


def cap_training_rows(df: DataFrame, max_rows: int | None, seed: int = settings.SEED, row_key: str = "row_key") -> DataFrame:
    """At most `max_rows` rows; no limit when it is None or 0."""
    return sample_k(df, max_rows, seed, row_key) if max_rows else df


def balance_classes(
    df: DataFrame, benign_share: float = settings.BENIGN_SHARE, seed: int = settings.SEED, row_key: str = "row_key"
) -> DataFrame:
    """All positives, and no more benign rows than the share allows; never adds rows.

    Without positives the input is returned whole; otherwise labels other than 0 and 1 are left out.
    """
    target = (F.col("positives") * F.lit(benign_share) / (F.lit(1.0) - F.lit(benign_share))).cast("bigint")

    def quotas(sizes: DataFrame) -> DataFrame:
        everywhere = Window.partitionBy(F.lit(1))  # one row per label
        positives = F.sum(F.when(F.col("stratum") == 1, F.col("n")).otherwise(0)).over(everywhere)
        quota = (
            F.when((F.col("positives") == 0) | (F.col("stratum") == 1), F.col("n"))
            .when(F.col("stratum") == 0, F.least("n", target))
            .otherwise(F.lit(0).cast("bigint"))
        )
        return sizes.withColumn("positives", positives).select("stratum", quota.alias("quota"))

    return sample_per_stratum(df, F.col("label"), quotas, "balance", seed, row_key).where("_drawn").drop("_drawn")


def split_quotas(counts: DataFrame, train_share: float = settings.TRAIN_SHARE) -> DataFrame:
    """(stratum, n) to (stratum, quota): evaluation rows per class.

    `ceil((1 - share) * total)` rows go to evaluation; the training rows are shared out by largest remainder,
    ties to the smaller label.
    """
    everywhere = Window.partitionBy(F.lit(1))  # one row per label
    total = F.sum("n").over(everywhere)
    train = F.col("total") - F.ceil((F.lit(1.0) - F.lit(train_share)) * F.col("total"))
    left_over = F.col("train") - F.sum("whole").over(everywhere)
    by_remainder = Window.partitionBy(F.lit(1)).orderBy(F.desc("remainder"), "stratum")
    extra = F.when(F.row_number().over(by_remainder) <= F.col("left_over"), 1).otherwise(0)
    return (
        counts.withColumn("total", total)
        .withColumn("train", train)
        .withColumn("share", F.col("n") / F.col("total") * F.col("train"))
        .withColumn("whole", F.floor("share"))
        .withColumn("remainder", F.col("share") - F.col("whole"))
        .withColumn("left_over", left_over)
        .select("stratum", (F.col("n") - F.col("whole") - extra).alias("quota"))
    )


def stratified_split(
    df: DataFrame, train_share: float = settings.TRAIN_SHARE, seed: int = settings.SEED, row_key: str = "row_key"
) -> DataFrame:
    """Add `part`, `train` or `eval`, with every label in both in proportion."""
    marked = sample_per_stratum(
        df, F.col("label"), lambda sizes: split_quotas(sizes, train_share), "split", seed, row_key
    )
    return marked.withColumn("part", F.when(F.col("_drawn"), "eval").otherwise("train")).drop("_drawn")


def shuffle_rows(df: DataFrame, seed: int = settings.SEED, row_key: str = "row_key") -> DataFrame:
    """A seeded total order, by a range-partitioned sort on the sampling key."""
    key = sampling_key(row_key, seed, "shuffle")
    return df.orderBy(key, F.col(row_key))


def union_classes(*parts: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
