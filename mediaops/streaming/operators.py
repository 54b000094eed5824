"""One-pass operators on streams.

State is kept per media (or per directory) and bounded by what the operator needs: windows
close with the watermark, counters and last labels are single values.  Rows of one key inside a
micro-batch are ordered before they are folded, so ordered input gives the batch result.
Operators with lists, maps and timers in their state are in ``stateful`` and ``sequences``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def second_events(detections: DataFrame, lateness: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """Detections per media and second (event time ``ts``); rows later than ``lateness`` are dropped.

    ``stateful.second_events_and_late_rows`` gives those rows too, at the price of Python state.
    """
    item = F.struct("frame_no", "label")
    return (
        detections.withWatermark("ts", lateness)
        .groupBy("media", F.window("ts", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["label"]), ",").alias("objects"),
        )
        .select("media", F.col("w.start").alias("second"), "count", "objects")
    )


def quiet_sessions(files: DataFrame, lateness: str = "10 seconds", gap: str = "500 milliseconds") -> DataFrame:
    """Runs of stills per directory with pauses of at most ``gap``; a run is emitted once it is over."""
    return (
        files.withWatermark("ts", lateness)
        .groupBy("dir", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("files"), F.min("name").alias("first_name"), F.max("frame_no").alias("last_frame"))
        .select("dir", F.col("w.start").alias("started"), "files", "first_name", "last_frame")
    )


Step = Callable[[pd.DataFrame, dict], tuple[pd.DataFrame, dict]]


def keyed_fold(rows: DataFrame, key: str, order: list[str], step: Step, out: str, state: str, shares: int = 64) -> DataFrame:
    """Fold the ordered rows of each key over micro-batches: ``step(rows, known)`` gives rows and what is known after.

    Keys are dealt to ``shares`` groups.  A step has the rows of all keys of a share at once, ordered by key and ``order``,
    and what is known of the share's keys: a tuple of the fields ``state`` per key.  It returns the entries that changed.
    So calls of Python follow the number of shares, not of keys.  The null key is a share of its own.
    """
    value = T.StructType.fromDDL(state)
    held = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in [rows.schema[key], *value]])

    def run(_: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values([key, *order], kind="stable", ignore_index=True)
        names, *values = group.get if group.exists else ([], *[[] for _ in value])
        known = dict(zip(names, zip(*values)))
        result, after = step(pdf, known)
        known |= after
        group.update((list(known), *[list(v) for v in zip(*known.values())]))
        yield result

    share = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(shares))).cast("int")
    return rows.withColumn("_share", share).groupBy("_share").applyInPandasWithState(run, out, held, "append", GroupStateTimeout.NoTimeout)


def key_runs(keys: pd.Series) -> tuple[np.ndarray, np.ndarray, list]:
    """Begin, end and key of the runs of equal keys among sorted ones of a share; null is the only key of its share."""
    first = np.ones(len(keys), bool)
    first[1:] = keys.to_numpy()[1:] != keys.to_numpy()[:-1]
    if keys.isna().any():
        first[1:] = False
    begin = np.flatnonzero(first)
    return begin, np.append(begin[1:], len(keys)), [None if pd.isna(k) else k for k in keys.iloc[begin].tolist()]


def label_changes(frames: DataFrame) -> DataFrame:
    """First row and every change of the label per media, the last label being the state."""

    def step(pdf: pd.DataFrame, known: dict):
        begin, end, media = key_runs(pdf["media"])
        labels = pdf["label"].astype(object).where(pdf["label"].notna(), None)
        before = labels.shift(1)
        before.iloc[begin] = pd.Series([known[m][0] if m in known else None for m in media], dtype=object).to_numpy()
        changed = before.isna() | (before != labels)
        hits = pdf[changed]
        out = pd.DataFrame(
            {"media": hits["media"], "frame_no": hits["frame_no"], "label": hits["label"],
             "previous_label": before[changed].where(before[changed].notna(), None)}
        )
        return out, {m: (label,) for m, label in zip(media, labels.iloc[end - 1].tolist())}

    return keyed_fold(
        frames.select("media", "frame_no", "label"), "media", ["frame_no"], step,
        "media long, frame_no long, label string, previous_label string", "label string",
    )


def frame_batches(frames: DataFrame, size: int = 3) -> DataFrame:
    """Frames of each media in requests of ``size``; a request is emitted when it is full.

    A row without a frame number ends the media: what waits is its last request.
    """

    def step(pdf: pd.DataFrame, known: dict):
        begin, end, media = key_runs(pdf["media"])
        numbers, ends = pdf["frame_no"].tolist(), pdf["ends"].tolist()
        rows, after = [], {}
        for a, b, m in zip(begin.tolist(), end.tolist(), media):
            number, waiting = known.get(m, (0, []))
            waiting = [*waiting, *[f for f, over in zip(numbers[a:b], ends[a:b]) if not over]]
            full = -(-len(waiting) // size) if any(ends[a:b]) else len(waiting) // size
            rows += [(m, number + i, ",".join(map(str, waiting[i * size : (i + 1) * size]))) for i in range(full)]
            after[m] = (number + full, waiting[full * size :])
        return pd.DataFrame(rows, columns=["media", "request_no", "frames"]), after

    frame = F.col("frame_no").cast("long")
    return keyed_fold(
        frames.select("media", F.coalesce(frame, F.lit(0)).alias("frame_no"), frame.isNull().alias("ends")), "media", ["frame_no"], step,
        "media long, request_no long, frames string", "request_no long, waiting array<long>",
    )


def upsert_batches(rows: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands every micro-batch to ``merge`` (an idempotent table upsert)."""
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark, path: str, schema: str | T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files of a folder; the checkpoint of the query remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
