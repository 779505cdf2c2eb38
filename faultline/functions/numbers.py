"""Numeric cleaning, safe ratios, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def try_year(c: Column) -> Column:
    """Text to whole number, NULL when it is no number (``2010.6`` rounds, ``2e3`` counts)."""
    return c.try_cast("decimal(38,0)").try_cast("bigint")


def digits_year(c: Column) -> Column:
    """Number formed by the digits of a text, NULL without digits."""
    return try_year(F.regexp_replace(c, "[^0-9]", ""))


def to_numeric(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def safe_ratio(part: Column, whole: Column, digits: int, scale: float = 100.0) -> Column:
    """``part * scale / whole`` rounded half up as double; NULL for an empty whole."""
    return F.round(F.try_divide(part.cast("double") * F.lit(scale), whole.cast("double")), digits)


def severity(total: Column, severe: Column) -> Column:
    return F.try_divide(severe.cast("double"), total.cast("double"))


def sign_bucket(change: Column) -> Column:
    """Direction of a change; NULL stays NULL."""
    return F.when(change > 0, "Improved").when(change < 0, "Declined").when(change == 0, "No Change")


def right_closed_bins(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]`` that holds the value, NULL outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((c > low) & (c <= high), label).otherwise(out)
    return out
