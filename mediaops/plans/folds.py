"""Ordered folds per key (pandas inside tasks) that also work when one key is very large.

A fold walks the rows of a key in order with a small state.  Rows are brought together by key
and sorted by Spark, and the fold streams over the sorted partition, so it holds one Arrow
batch and not a key, and many small keys cost no call each.  For a large key the rows are cut into slices (see ``slices``) and three
distributed steps replace the single walk:

1. *probe*: every slice reports, for each state it could be entered with, the state in
   which it is left and how many units it opened;
2. *chain*: per key, these reports (one row per slice) are followed from the start state;
3. *walk*: every slice is folded with its now known entry state.

Only folds whose possible entry states can be enumerated per slice have a probe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.plans.slices import MAX_GROUP_ROWS, SLICE, attach_carry, slice_by_order

Walk = Callable[[pd.DataFrame, np.ndarray, float, int], tuple[pd.DataFrame, float, int]]
Probe = Callable[[pd.DataFrame], tuple[list[float], list[float], list[int]]]
Choose = Callable[[float, np.ndarray], int]


def fold_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    walk: Walk,
    schema: T.StructType,
    start: float,
    probe: Probe,
    choose: Choose,
    max_rows: int = MAX_GROUP_ROWS,
    large: bool | None = None,
    bound: str | None = None,
) -> DataFrame:
    """Fold each key in order.

    ``walk(rows, first, state, opened)`` goes over sorted ``rows`` entered with ``state`` after
    ``opened`` units, starts anew at rows flagged in ``first``, and returns the output rows and
    the state and count it ends with.  ``probe(rows)`` returns parallel lists (entry mark,
    state on leaving, units opened).  ``choose(state, marks)`` picks the position of the
    entry that ``state`` takes, or -1 when it passes through the slice unchanged.

    With ``bound``, the probe also gets the greatest value of that column in the slices of the
    key before its own (NaN in the first one), which is how far entry states can reach.
    """
    keys, order = list(keys), list(order)
    sliced, large = slice_by_order(df, keys, order, max_rows, large)
    if not large:

        def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, opened, last = start, 0, None
            for pdf in batches:
                if pdf.empty:
                    continue
                first = _key_starts(pdf, keys, last)
                last = pdf[keys].iloc[-1:]
                out, state, opened = walk(pdf.reset_index(drop=True), first, state, opened)
                yield out

        together = df.repartition(*keys).sortWithinPartitions(*keys, *order)
        return together.mapInPandas(stream, schema)

    on = [*keys, SLICE]
    key_fields = [sliced.schema[k] for k in on]
    report = T.StructType(
        key_fields
        + [
            T.StructField("marks", T.ArrayType(T.DoubleType())),
            T.StructField("leave", T.ArrayType(T.DoubleType())),
            T.StructField("opened", T.ArrayType(T.LongType())),
        ]
    )

    probed = sliced
    if bound is not None:
        earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        tops = sliced.groupBy(*on).agg(F.max(bound).alias("_top"))
        carry = tops.select(*on, F.max("_top").over(earlier).alias("_bound")).filter("_bound is not null")
        probed = attach_carry(sliced, carry, keys, "_bound")

    def probe_slice(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="stable", ignore_index=True)
        marks, leave, opened = probe(rows) if bound is None else probe(rows, float(rows["_bound"].iloc[0]))
        return pd.DataFrame([[*key, marks, leave, opened]], columns=[f.name for f in report.fields])

    entry = T.StructType(
        key_fields + [T.StructField("_state", T.DoubleType()), T.StructField("_opened", T.LongType())]
    )

    def follow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, opened, rows = start, 0, []
        for row in pdf.sort_values(SLICE).itertuples(index=False):
            rows.append([*key, getattr(row, "slice_no"), state, opened])
            at = choose(state, np.asarray(row.marks, dtype=float))
            if at >= 0:
                state, opened = row.leave[at], opened + int(row.opened[at])
        return pd.DataFrame(rows, columns=[f.name for f in entry.fields])

    def follow_named(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return follow(key, pdf.assign(slice_no=pdf[SLICE]))

    reports = probed.groupBy(*on).applyInPandas(probe_slice, report)
    entries = reports.groupBy(*keys).applyInPandas(follow_named, entry)
    carried = entries.filter((F.col("_opened") > 0)).withColumn("_entry", F.struct("_state", "_opened"))
    entered = attach_carry(sliced, carried, keys, "_entry").select(
        "*",
        F.coalesce(F.col("_entry._state"), F.lit(float(start))).alias("_state"),
        F.coalesce(F.col("_entry._opened"), F.lit(0)).cast("long").alias("_opened"),
    ).drop("_entry")

    def walk_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="stable", ignore_index=True)
        state, opened = float(rows["_state"].iloc[0]), int(rows["_opened"].iloc[0])
        same = np.zeros(len(rows), bool)
        return walk(rows.drop(columns=[SLICE, "_state", "_opened"]), same, state, opened)[0]

    return entered.groupBy(*on).applyInPandas(walk_slice, schema)


def _key_starts(pdf: pd.DataFrame, keys: list[str], last: pd.DataFrame | None) -> np.ndarray:
    """Flags of the rows whose key differs from the row before (``last`` ends the batch before)."""
    seen = pdf[keys] if last is None else pd.concat([last, pdf[keys]])
    differs = np.zeros(len(seen), bool)
    for k in keys:
        column = seen[k].reset_index(drop=True)
        before = column.shift(1)
        differs |= ((column != before) & ~(column.isna() & before.isna())).to_numpy(bool)
    if last is None:
        differs[0] = True
        return differs
    return differs[1:]


def budget_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    enter: str,
    reach: str,
    budget: float,
    max_rows: int = MAX_GROUP_ROWS,
    large: bool | None = None,
) -> DataFrame:
    """Greedy packing: a row joins the open chunk while reach(row) - enter(first row) <= budget.

    The first row of a chunk always belongs to it.  Adds ``chunk`` (0-based per key),
    ``chunk_enter`` (the ``enter`` value of the chunk's first row), ``opens`` (true on that
    row) and ``left_enter`` (the ``chunk_enter`` of the chunk closed by an opening row).
    """
    schema = T.StructType(
        list(df.schema.fields)
        + [
            T.StructField("chunk", T.LongType()),
            T.StructField("chunk_enter", T.DoubleType()),
            T.StructField("opens", T.BooleanType()),
            T.StructField("left_enter", T.DoubleType()),
        ]
    )
    names = [f.name for f in df.schema.fields]

    def walk(rows: pd.DataFrame, first: np.ndarray, state: float, opened: int) -> tuple[pd.DataFrame, float, int]:
        enters, reaches = rows[enter].to_numpy(float), rows[reach].to_numpy(float)
        n = len(rows)
        chunk, at, opens = np.empty(n, np.int64), np.empty(n), np.zeros(n, bool)
        left = np.full(n, np.nan)
        for i in range(n):
            if first[i]:
                state, opened = np.nan, 0
            if state != state or reaches[i] - state > budget:
                left[i], opens[i] = state, True
                state, opened = enters[i], opened + 1
            chunk[i], at[i] = opened - 1, state
        left_values = pd.array(np.where(np.isnan(left), 0.0, left), dtype="Float64")
        left_values[np.isnan(left)] = pd.NA
        return rows[names].assign(chunk=chunk, chunk_enter=at, opens=opens, left_enter=left_values), state, opened

    def probe(rows: pd.DataFrame, latest: float) -> tuple[list[float], list[float], list[int]]:
        enters, reaches = rows[enter].to_numpy(float), rows[reach].to_numpy(float)
        n = len(rows)
        # Leaving state and chunk count of a chunk opened at row i, from the back.
        leave, count = np.empty(n), np.empty(n, np.int64)
        for i in range(n - 1, -1, -1):
            j, span = i + 1, 64
            while j < n:
                over = np.nonzero(reaches[j : j + span] - enters[i] > budget)[0]
                if over.size:
                    j += int(over[0])
                    break
                j, span = min(n, j + span), span * 2
            leave[i], count[i] = (leave[j], count[j] + 1) if j < n else (enters[i], 1)
        # Only a new maximum of reach can be the first row out of budget.  A chunk that enters
        # began at one of the earlier slices' ``enter`` values, of which ``latest`` is the
        # greatest: they need not be below this slice's own.
        marks, out, opened, top = [], [], [], -np.inf
        passed = True
        for i in range(n):
            if reaches[i] <= top:
                continue
            top = reaches[i]
            marks.append(float(top))
            out.append(float(leave[i]))
            opened.append(int(count[i]))
            if top - latest > budget:
                passed = False
                break
        if passed:  # a chunk may pass through the whole slice
            marks, out, opened = [*marks, -np.inf], [*out, np.nan], [*opened, 0]
        return marks, out, opened

    def choose(state: float, marks: np.ndarray) -> int:
        if np.isnan(state):
            return 0
        over = np.nonzero(marks - state > budget)[0]
        return int(over[0]) if over.size else -1

    return fold_by_key(df, keys, order, walk, schema, float("nan"), probe, choose, max_rows, large, enter)
