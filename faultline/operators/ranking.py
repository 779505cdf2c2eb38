"""Ranks, first rows and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.operators.ordered import HOT_ROWS, key_sum, ordered_features, running_sum
from faultline.operators.staging import keep_keys, lookup, stage


def sort_by(*names: str) -> list[Column]:
    """Sort expressions from names; a leading ``-`` sorts down. NULLs come last either way."""
    return [F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc_nulls_last() for n in names]


def sorted_rows(df: DataFrame, *order: Column) -> DataFrame:
    """Global sort of row-level results in which even a large group of equal rows is spread.

    Sort ranges cannot cut between equal keys, so the input partition is the last key. It is
    the same when a task is repeated, which a random key would not be.
    """
    return df.withColumn("_spread", F.spark_partition_id()).orderBy(*order, "_spread").drop("_spread")


def _reverse(*names: str) -> list[Column]:
    return [F.col(n[1:]).asc_nulls_first() if n.startswith("-") else F.col(n).desc_nulls_first() for n in names]


def value_ranks(
    df: DataFrame, partition: Sequence[str], value: str, hot_rows: int = HOT_ROWS, weight: str | None = None
) -> DataFrame:
    """One row per distinct (partition, value): its descending RANK and its PERCENT_RANK.

    All rows with the same value share a rank, so ranking the counts of distinct values is
    enough and no task ever sorts the rows themselves. ``weight`` names a column of row counts
    if ``df`` is counted already.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = stage(df.groupBy(*partition, value).agg(rows.alias("_n")))
    summed = ordered_features(
        counts,
        partition,
        sort_by(f"-{value}"),
        [running_sum("_upto", "_n"), key_sum("_all", "_n")],
        unique=True,
        staged=True,
        hot_rows=hot_rows,
    )
    above = F.col("_upto") - F.col("_n")
    return summed.select(
        *partition,
        value,
        (above + 1).alias("RANK"),
        F.coalesce(F.try_divide(above.cast("double"), F.col("_all") - 1), F.lit(0.0)).alias("PERCENT_RANK"),
    )


def with_rank(df: DataFrame, partition: Sequence[str], value: str, name: str, **limits) -> DataFrame:
    """``RANK() OVER (PARTITION BY partition ORDER BY value DESC)`` as a new column."""
    ranks = value_ranks(df, partition, value, **limits).select(*partition, value, F.col("RANK").alias(name))
    return lookup(df, ranks, [*partition, value])


def with_percent_rank(df: DataFrame, value: str, name: str, **limits) -> DataFrame:
    """Global ``PERCENT_RANK() OVER (ORDER BY value DESC)`` without a single-task sort."""
    ranks = value_ranks(df, [], value, **limits).select(value, F.col("PERCENT_RANK").alias(name))
    return lookup(df, ranks, [value])


def with_group_size(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``COUNT(*) OVER (PARTITION BY keys)``: counted with map-side combine, then attached."""
    return lookup(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of every key. Spark keeps one row per key and map task before the shuffle."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def topk(df: DataFrame, k: int, *order: str) -> DataFrame:
    return df.orderBy(*sort_by(*order)).limit(k)


def nlargest(df: DataFrame, k: int, value: str, *ties: str) -> DataFrame:
    """The k rows with the largest value; equal values by ``ties``."""
    return topk(df, k, f"-{value}", *ties)


def tail(df: DataFrame, k: int, *order: str) -> DataFrame:
    """Last k rows of an order, shown in that order."""
    return df.orderBy(*_reverse(*order)).limit(k).orderBy(*sort_by(*order))


def _measured_keys(df: DataFrame, key: str, measure: Column | None) -> DataFrame:
    measure = F.count(F.lit(1)) if measure is None else measure
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(measure.alias("_m"))


def top_keys(df: DataFrame, key: str, k: int, measure: Column | None = None) -> DataFrame:
    """The k keys with the largest measure (row count unless given); missing keys do not compete."""
    return nlargest(_measured_keys(df, key, measure), k, "_m", key).select(key)


def place_top_keys(df: DataFrame, key: str, k: int, measure: Column | None = None) -> DataFrame:
    """The top keys with their PLACE from 1; the k rows that are numbered come from one top-k."""
    top = nlargest(_measured_keys(df, key, measure), k, "_m", key)
    return top.select(key, F.row_number().over(Window.orderBy(*sort_by("-_m", key))).alias("PLACE"))


def keep_top_keys(df: DataFrame, key: str, k: int, measure: Column | None = None) -> DataFrame:
    return keep_keys(df, top_keys(df, key, k, measure))
