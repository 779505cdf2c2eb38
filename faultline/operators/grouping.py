"""Grouping sets, de-duplicated measures, pivots, shares, histograms, medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.ordered import HOT_ROWS, key_sum, ordered_features, running_sum
from faultline.operators.ranking import sort_by
from faultline.operators.staging import stage


def subtotal_label(name: str, label: str, shown: Column | None = None) -> Column:
    """Label on rows where ``name`` is summed over, its own value elsewhere."""
    return F.when(F.grouping(name) == 1, label).otherwise(F.col(name) if shown is None else shown)


def merged_label(name: str, label: str) -> Column:
    """Label on any NULL: subtotals and really missing values look the same."""
    return F.coalesce(F.col(name), F.lit(label))


def dedupe_measure(df: DataFrame, entity: Sequence[str], measure: str) -> DataFrame:
    """One row per entity with the largest value of a measure that its rows repeat."""
    return df.groupBy(*entity).agg(F.max(measure).alias(measure))


def pivot_count(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Row counts per (row, column value), 0 where absent; rows with a missing key are left out."""
    kept = df.filter(F.col(row).isNotNull() & F.col(column).isin(list(values)))
    return kept.groupBy(row).pivot(column, list(values)).count().na.fill(0, subset=list(values))


def pivot_share(df: DataFrame, row: str, column: str, values: Sequence[str], digits: int = 6) -> DataFrame:
    """``pivot_count`` with each row as percentages of its total."""
    counts = pivot_count(df, row, column, values)
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return counts.select(
        row, *[F.round(F.col(f"`{v}`") * 100.0 / total, digits).alias(v) for v in values]
    )


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Count of each value and its share of all present values."""
    counts = stage(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("N")))
    total = counts.agg(F.sum("N").alias("total")).scalar()
    return counts.withColumn("SHARE", F.round(F.col("N") / total, 6))


def extent(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("MAX"), F.min(column).alias("MIN"), F.sum(column).alias("TOTAL"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, the last one closed; empty bins show 0.

    One pass finds the two ends, a second one counts; no row is compared with a range.
    """
    present = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    low, high = present.agg(F.min("x"), F.max("x")).first()
    if low is None:
        low, high = 0.0, 1.0
    elif low == high:
        low, high = low - 0.5, high + 0.5
    start, width = F.lit(low), F.lit((high - low) / bins)
    x, near = F.col("x"), F.col("near")
    # The division can round a value across an edge, so the edges themselves decide.
    below = (x < start + near * width).cast("int")
    above = ((near < bins - 1) & (x >= start + (near + 1) * width)).cast("int")
    counts = (
        present.withColumn("near", F.least(F.floor((x - start) / width), F.lit(bins - 1)))
        .groupBy((near - below + above).cast("bigint").alias("BIN"))
        .agg(F.count(F.lit(1)).alias("N"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").alias("BIN"))
    return every.join(counts, "BIN", "left").select(
        "BIN",
        F.round(start + F.col("BIN") * width, 6).alias("BIN_LOW"),
        F.round(start + (F.col("BIN") + 1) * width, 6).alias("BIN_HIGH"),
        F.coalesce("N", F.lit(0)).alias("N"),
    )


def exact_median(
    df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "MEDIAN", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact median (mean of the middle two) per key, from counts of distinct values.

    Unlike a percentile aggregate, no task holds all values of a key.
    """
    present = df.filter(F.col(value).isNotNull())
    counts = stage(present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    summed = ordered_features(
        counts,
        keys,
        sort_by(value),
        [running_sum("_upto", "_n"), key_sum("_all", "_n")],
        unique=True,
        staged=True,
        hot_rows=hot_rows,
    )

    def value_at(rank: Column) -> Column:
        hit = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
        return F.max(F.when(hit, F.col(value).cast("double")))

    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    return summed.groupBy(*keys).agg(((value_at(lower) + value_at(upper)) / 2).alias(name))
