"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = 134217729.0  # 2**27 + 1: splits a double into two halves whose products are exact


def round_exact(x: Column, digits: int) -> Column:
    """Round a double to ``digits`` places by its exact binary value, ties to even.

    SQL ``round`` works on the shortest decimal text of the value and rounds ties away
    from zero, so 0.345 (stored just below) would become 0.35.  Scaled products that land
    exactly on .5 are decided here by the rounding error of the product itself.
    """
    scale = float(10**digits)
    p = x * F.lit(scale)
    low = F.floor(p).cast("double")
    high_part = x * F.lit(SPLITTER) - (x * F.lit(SPLITTER) - x)
    error = (high_part * F.lit(scale) - p) + (x - high_part) * F.lit(scale)
    apparent_tie = (p - low == 0.5) & (error != 0)
    return F.when(apparent_tie, low + (error > 0).cast("double")).otherwise(F.rint(p)) / F.lit(scale)


def round_exact_once(x: Column, digits: int) -> Column:
    """:func:`round_exact` of a costly expression, evaluated once even inside a lambda."""
    return F.get(F.transform(F.array(x), lambda v: round_exact(v, digits)), F.lit(0))


def neg_log10_potency(value: Column) -> Column:
    """-log10 of a nanomolar value; NULL for NULL or non-positive input."""
    return F.when(value > 0, -F.log10(value * F.lit(1e-9)))


def hit_ratio_estimate(hits: Column, total: Column | int = 12) -> Column:
    total = F.lit(total) if isinstance(total, int) else total
    ratio = hits.cast("double") / F.greatest(total, F.lit(1)).cast("double")
    return round_exact(F.lit(4.0) + ratio * 5.0, 3)


def potency_from_probability(p: Column) -> Column:
    return round_exact(F.lit(4.0) + p * 5.0, 2)


def finite_or(x: Column, replacement: float | None) -> Column:
    """NaN and infinities become ``replacement`` (NULL when it is None)."""
    finite = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    kept = F.when(finite, x)
    return kept if replacement is None else F.coalesce(kept, F.lit(replacement))


NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def coerce_numeric(text: Column) -> Column:
    """Text to double; unparseable text, NaN and infinities become NULL.

    The pattern keeps out what a cast would also accept, such as ``12d`` or ``0x1p3``.
    """
    trimmed = F.regexp_replace(text, r"^\s+|\s+\z", "")
    return finite_or(F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double")), None)


def row_sum(columns: list[Column]) -> Column:
    """Sum over the cells of a row, NULL cells counting as 0."""
    return sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))


def row_nonnull_count(columns: list[Column]) -> Column:
    return sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))


def order_buckets(x: Column, per_octave: int = 1024, slices: int = 1 << 20) -> tuple[Column, Column]:
    """Two monotone bucket numbers of a double: an equal-ratio bucket and a slice of it.

    Pure functions of the value, so they need no statistics pass and always agree between
    two uses.  An octave holds 2**52 doubles, so a slice of a bucket holds about 2**22
    distinct values at most, however narrow the range of the data is.
    """
    offset = per_octave * 1100  # keeps the exponent part positive down to subnormals
    size = F.abs(x)
    number = F.floor(F.log2(size) * per_octave)
    low, high = F.pow(F.lit(2.0), number / per_octave), F.pow(F.lit(2.0), (number + 1) / per_octave)
    place = F.floor((size - low) * F.try_divide(F.lit(float(slices)), high - low))
    inside = F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.lit(slices - 1))
    sign = F.when(x > 0, 1).when(x < 0, -1)
    bucket = F.coalesce(sign * (number + offset), F.lit(0)).cast("long")
    return bucket, F.coalesce(sign * inside, F.lit(0)).cast("long")
