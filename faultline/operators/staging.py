"""Staged frames and size-checked joins.

A staged frame is a parquet table in the shared folder. That cuts lineage, freezes any
partition-dependent column, survives the loss of executors, and tells the planner its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.shared import written

# A side is broadcast only when it was measured and is within both limits. Both give the same rows; only the plan differs.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def stage(df: DataFrame) -> DataFrame:
    return written(df, "staged")


def stage_all(*frames: DataFrame) -> list[DataFrame]:
    """Independent frames staged by jobs that run side by side, in the caller's job group and scheduler pool."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(inheritable_thread_target(frames[0].sparkSession)(stage), frames))


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The staged frame, and whether it is small enough to send to every executor."""
    staged = stage(df)
    widths = [F.coalesce(F.octet_length(n), F.lit(0)) if kind == "string" else F.lit(8) for n, kind in staged.dtypes]
    rows, size = staged.agg(F.count(F.lit(1)), F.sum(reduce(lambda a, b: a + b, widths).cast("bigint"))).first()
    return staged, rows <= max_rows and (size or 0) <= BROADCAST_BYTES


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def lookup(
    df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Attach the columns of a table that is unique on ``on`` (NULL keys match NULL keys).

    The table is measured first: broadcast when small, an ordinary shuffled join (with
    adaptive skew handling) beyond that.
    """
    staged, small = bounded(table, max_rows)
    side = staged.select(
        *[F.col(k).alias(f"_on_{k}") for k in on], *[c for c in staged.columns if c not in on]
    )
    joined = df.join(
        F.broadcast(side) if small else side, null_safe(df, side, [(k, f"_on_{k}") for k in on]), how
    )
    return joined.drop(*[f"_on_{k}" for k in on])


def keep_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is among a handful of keys (a top-k list): broadcast semi-join."""
    return df.join(F.broadcast(keys), keys.columns, "left_semi")


def keep_existing(grouped: DataFrame, keys: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Groups whose key is among ``keys``, for a grouping that has the key columns among its own.

    Few keys are broadcast, and Catalyst moves a broadcast semi-join below the grouping, where
    it prunes rows before the first shuffle. With many keys it stays above: there a hot key
    is down to a few rows, so it never reaches one task row by row.
    """
    staged, small = bounded(keys.dropna().distinct(), max_rows)
    return grouped.join(F.broadcast(staged) if small else staged, staged.columns, "left_semi")
