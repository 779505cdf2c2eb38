"""Ordered features (previous row, moving average, running sum, row position) that survive hot keys.

A window partitioned by key sends all rows of one key to one task. ``ordered_features``
stages its input once and counts the largest group of what it staged. Groups of a sane size use the plain
window. Otherwise the rows are range-partitioned by (key, order), which cuts a hot key into runs of
consecutive rows; features are computed inside each run, and what the earlier runs of the same key
contribute (row count, sums, last few values) is carried in through a small frame that
has at most two rows per range partition.

Both ways give the same types and the same values, to the last bit: sums are over integers or decimals only, and
averages add their few values from the oldest on, as a window does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from faultline.operators.staging import null_safe, stage

# Largest group that one window task is asked to sort; also the size of a run.
HOT_ROWS = 20_000_000
# The same where there are no keys, so that nothing else would spread the rows.
UNKEYED_ROWS = 100_000


@dataclass(frozen=True)
class Feature:
    kind: str
    name: str
    source: str = ""
    rows: int = 0


def position(name: str) -> Feature:
    """Row number within the key."""
    return Feature("position", name)


def previous(name: str, source: str, rows: int = 1) -> Feature:
    """Value ``rows`` rows earlier."""
    return Feature("previous", name, source, rows)


def moving_average(name: str, source: str, rows: int) -> Feature:
    """Average over this row and the ``rows - 1`` rows before it, missing values left out."""
    return Feature("moving", name, source, rows - 1)


def running_sum(name: str, source: str) -> Feature:
    """Sum from the first row of the key up to this row."""
    return Feature("running", name, source)


def key_sum(name: str, source: str) -> Feature:
    """Sum over all rows of the key."""
    return Feature("key_sum", name, source)


def ordered_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    features: Sequence[Feature],
    *,
    unique: bool = False,
    staged: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the features to ``df``.

    ``unique`` states that (keys, order) never repeats, ``staged`` that ``df`` is a staged frame already; otherwise equal rows get a frozen
    tie-break before the rows are cut into runs. Sums of floating-point columns depend on the order of
    addition and are refused; cast them to a decimal type.
    """
    types = dict(df.dtypes)
    inexact = [f.source for f in features if f.kind in ("running", "key_sum") and types[f.source] in ("float", "double")]
    if inexact:
        raise TypeError(f"sums of {', '.join(inexact)}: cast floating-point columns to decimal first")
    kept = df.columns
    rows = df if unique else df.withColumn("_copy", F.monotonically_increasing_id())
    rows = rows if staged and unique else stage(rows)
    order = list(order) if unique else [*order, F.col("_copy")]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    plain = _in_plain_windows(rows, keys, order, features)
    if (largest or 0) > (hot_rows if keys else min(hot_rows, UNKEYED_ROWS)):
        plain = _in_runs(rows, keys, order, features, plain.schema, math.ceil(total / hot_rows))
    return plain.select(*kept, *[f.name for f in features])


def _in_plain_windows(df, keys, order, features):
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {}
    for f in features:
        if f.kind == "position":
            columns[f.name] = F.row_number().over(ordered).cast("bigint")
        elif f.kind == "previous":
            columns[f.name] = F.lag(f.source, f.rows).over(ordered)
        elif f.kind == "moving":
            columns[f.name] = F.avg(f.source).over(ordered.rowsBetween(-f.rows, Window.currentRow))
        elif f.kind == "running":
            columns[f.name] = F.sum(f.source).over(upto)
        else:
            columns[f.name] = F.sum(f.source).over(whole)
    return df.withColumns(columns)


def _null_aware_add(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _average(values: Sequence[Column], present: Column, kind: T.DataType) -> Column:
    """Sum by count as ``avg`` takes them: decimals as decimals, anything else as doubles."""
    exact = isinstance(kind, T.DecimalType)
    wide = T.DecimalType(min(kind.precision + 10, 38), kind.scale) if exact else T.DoubleType()
    filled = reduce(lambda a, b: (a + b).cast(wide), [F.coalesce(v.cast(wide), F.lit(0).cast(wide)) for v in values])
    return F.try_divide(filled, present.cast("decimal(20,0)") if exact else present)


def _in_runs(df, keys, order, features, schema, least_runs):
    runs = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least_runs + 1)
    cut = stage(
        df.repartitionByRange(runs, *[F.col(k) for k in keys], *order).withColumn("_run", F.spark_partition_id())
    )

    whole = Window.partitionBy(*keys, "_run")
    ordered = whole.orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = max([f.rows for f in features], default=0)
    tail_columns = sorted({f.source for f in features if f.rows})
    sum_columns = sorted({f.source for f in features if f.kind in ("running", "key_sum")})
    local = cut.withColumns(
        {
            "_pos": F.row_number().over(ordered),
            "_size": F.count(F.lit(1)).over(whole),
            **{f"_upto_{c}": F.sum(c).over(upto) for c in sum_columns},
            **{f"_back_{c}_{j}": F.lag(c, j).over(ordered) for c in tail_columns for j in range(1, depth + 1)},
        }
    )

    last = F.when(F.col("_size") - F.col("_pos") < depth, F.struct("_pos", *tail_columns))
    per_run = local.groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sort_array(F.collect_list(last)).alias("_last"),
        *[F.sum(c).alias(f"_sum_{c}") for c in sum_columns],
    )
    of_key = Window.partitionBy(*keys)
    by_run = of_key.orderBy("_run")
    before = by_run.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_run.withColumns(
            {
                "_runs": F.count(F.lit(1)).over(of_key),
                "_before": F.sum("_n").over(before),
                "_tail": F.flatten(F.collect_list("_last").over(by_run.rowsBetween(-max(depth, 1), -1))),
                **{f"_sum_before_{c}": F.sum(f"_sum_{c}").over(before) for c in sum_columns},
                **{f"_sum_key_{c}": F.sum(f"_sum_{c}").over(of_key) for c in sum_columns},
            }
        )
        .filter(F.col("_runs") > 1)
        .select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.col("_run").alias("_key_run"),
            "_runs",
            "_before",
            "_tail",
            *[f"_sum_before_{c}" for c in sum_columns],
            *[f"_sum_key_{c}" for c in sum_columns],
        )
    )
    # Each cut between two range partitions splits one key at most, so at most 2 * runs rows.
    pairs = [*[(k, f"_key_{k}") for k in keys], ("_run", "_key_run")]
    joined = local.join(F.broadcast(carried), null_safe(local, carried, pairs), "left")

    def back(c: str, j: int) -> Column:
        from_tail = F.get("_tail", F.size("_tail") - (F.lit(j + 1) - F.col("_pos"))).getField(c)
        return F.when(F.col("_pos") > j, F.col(f"_back_{c}_{j}")).otherwise(from_tail)

    columns = {}
    for f in features:
        if f.kind == "position":
            columns[f.name] = F.col("_pos") + F.coalesce("_before", F.lit(0))
        elif f.kind == "previous":
            columns[f.name] = back(f.source, f.rows)
        elif f.kind == "moving":
            # Oldest first, as a window adds them.
            values = [*[back(f.source, j) for j in range(f.rows, 0, -1)], F.col(f.source)]
            present = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
            columns[f.name] = _average(values, present, schema[f.source].dataType)
        elif f.kind == "running":
            columns[f.name] = _null_aware_add(F.col(f"_upto_{f.source}"), F.col(f"_sum_before_{f.source}"))
        else:
            columns[f.name] = F.when(F.col("_runs").isNotNull(), F.col(f"_sum_key_{f.source}")).otherwise(
                F.sum(f.source).over(whole)
            )
    return joined.withColumns({name: c.cast(schema[name].dataType) for name, c in columns.items()})
