"""Ordered computations inside a key without putting a large key into one task.

A window partitioned by media, or a fold over one media, sends all rows of that media to
one task.  When one media may hold a third of the table this never finishes.  The helpers
here first count rows per key (a map-side combined aggregate over the key columns only).

* No key above ``max_rows``: the ordinary window or grouped fold is used as is.
* Some key above it: the table is range-partitioned by (keys, order) into evenly sized
  slices.  The slice number is stored with the rows, work happens inside (key, slice),
  and what a slice needs from the slices before it travels in a summary of one row per
  slice.  Slices of one key are contiguous, so at most one key continues into any slice
  and the table of carried values has at most as many rows as there are slices.

The order columns should identify a row; then even a single instant is split.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.plans.staging import cut_lineage

MAX_GROUP_ROWS = 1_000_000
SLICE = "_slice"


def has_large_group(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_GROUP_ROWS) -> bool:
    """True when some key holds more than ``max_rows`` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not counts.filter(F.col("_n") > max_rows).isEmpty()


def slice_by_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_GROUP_ROWS, large: bool | None = None
) -> tuple[DataFrame, bool]:
    """Add ``_slice`` (constant 0 when every key is small); also tell whether slicing was needed.

    ``large`` is the answer of ``has_large_group`` when the caller already knows it, for
    example from the table that ``df`` was computed from.
    """
    if large is None:
        large = has_large_group(df, keys, max_rows)
    if not large:
        return df.withColumn(SLICE, F.lit(0)), False
    slices = max(2, math.ceil(df.count() / max_rows))
    ranged = df.repartitionByRange(slices, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    return cut_lineage(ranged), True


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys, so that null keys behave as one group."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def attach_carry(sliced: DataFrame, carry: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Left join the carried values, one row per slice at most; they may be long texts, so Spark picks the join."""
    on = [*keys, SLICE]
    renamed = carry.select(*[F.col(k).alias(f"_c_{k}") for k in on], value)
    cond = F.lit(True)
    for k in on:
        cond = cond & sliced[k].eqNullSafe(renamed[f"_c_{k}"])
    return sliced.join(renamed, cond, "left").drop(*[f"_c_{k}" for k in on])


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    prefix: str = "prev_",
    max_rows: int = MAX_GROUP_ROWS,
    large: bool | None = None,
) -> DataFrame:
    """Add the values of ``columns`` in the preceding row of the same key."""
    sliced, large = slice_by_order(df, keys, order, max_rows, large)
    if not large:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in columns])
    tails = sliced.groupBy(*keys, SLICE).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_tail")
    )
    across = Window.partitionBy(*keys).orderBy(SLICE)
    carry = tails.withColumn("_carry", F.lag("_tail").over(across)).filter("_carry is not null")
    joined = attach_carry(sliced, carry, keys, "_carry")
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    first = F.lag(F.lit(True)).over(w).isNull()
    added = [
        F.when(first, F.col("_carry")[c]).otherwise(F.lag(c).over(w)).alias(prefix + c) for c in columns
    ]
    return joined.select("*", *added).drop(SLICE, "_carry")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column | str,
    out: str,
    max_rows: int = MAX_GROUP_ROWS,
    large: bool | None = None,
) -> DataFrame:
    """Add the inclusive running sum of ``value`` inside each key."""
    value = F.col(value) if isinstance(value, str) else value
    sliced, large = slice_by_order(df.withColumn("_v", value), keys, order, max_rows, large)
    rows = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not large:
        rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return sliced.withColumn(out, F.sum("_v").over(rows)).drop("_v", SLICE)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        sliced.groupBy(*keys, SLICE)
        .agg(F.sum("_v").alias("_s"))
        .withColumn("_carry", F.sum("_s").over(before))
        .filter("_carry is not null")
    )
    joined = attach_carry(sliced, carry, keys, "_carry")
    total = F.sum("_v").over(rows) + F.coalesce(F.col("_carry"), F.lit(0))
    return joined.withColumn(out, total).drop("_v", "_carry", SLICE)


def modes_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str = "common_") -> DataFrame:
    """Most frequent value of each column per key, the smallest one on ties, nulls ignored.

    Counting (key, column, value) first keeps the buffers small for any number of values.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    counted = (
        df.select(*keys, F.explode(pairs).alias("p"))
        .filter("p.v is not null")
        .groupBy(*keys, F.col("p.c").alias("c"), F.col("p.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.struct(-F.col("n"), F.col("v"))
    return counted.groupBy(*keys).agg(
        *[
            F.min_by(F.when(F.col("c") == c, F.col("v")), F.when(F.col("c") == c, best)).alias(prefix + c)
            for c in columns
        ]
    )
