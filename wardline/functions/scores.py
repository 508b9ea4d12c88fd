"""Score expressions: NaN-safe comparison, output cleaning, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import settings


def at_least(score: Column, threshold: Column) -> Column:
    """`score >= threshold` as IEEE defines it: never true for NaN (Spark sorts NaN highest)."""
    return ~F.isnan(score) & ~F.isnan(threshold) & (score >= threshold)


def below(score: Column, bound: Column) -> Column:
    return ~F.isnan(score) & (score < bound)


def effective_threshold(override: Column, default: float = settings.BLOCK_THRESHOLD) -> Column:
    """The row's own threshold where it has one, else the configured one."""
    return F.coalesce(override.cast("double"), F.lit(float(default)))


def sanitize_score(score: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(score) & (F.abs(score) != float("inf")), score)


def score_or_zero(score: Column) -> Column:
    """A row the scorer failed on counts as 0.0."""
    return F.coalesce(score.cast("double"), F.lit(0.0))


def half_even(value: Column, digits: int) -> Column:
    """Round a double to `digits` decimals as Python's `round` does.

    Python rounds the exact binary value, so 0.00015 (stored slightly below) gives 0.0001, where decimal
    rounding of the printed digits gives 0.0002. The product with 10^digits is split into its rounded value
    and its exact error (Dekker's product), which tells on which side of a tie the value lies.
    """
    scale = float(10**digits)
    split = F.lit(134217729.0)  # 2^27 + 1
    scale_high = scale * 134217729.0 - (scale * 134217729.0 - scale)
    scale_low = scale - scale_high
    product = value * F.lit(scale)
    high = value * split - (value * split - value)
    low = value - high
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    whole = F.floor(product)
    above = (product - whole - F.lit(0.5)) + error
    up = F.when(above > 0, 1).when(above < 0, 0).otherwise(F.abs(whole % 2))
    rounded = (whole + up).cast("double") / F.lit(scale)
    # From 2^53 on neighbouring doubles lie more than a unit of the last decimal apart, so rounding changes nothing.
    inexact = ~F.isnan(value) & (F.abs(product) < F.lit(float(1 << 53)))
    return F.when(inexact, rounded).otherwise(value)


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, as Python's `format(value, ".4f")` gives."""
    return F.format_string(f"%.{digits}f", half_even(value, digits))


def ratio(top: Column, bottom: Column) -> Column:
    """`top / bottom`, and 0.0 where the bottom is zero."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))
