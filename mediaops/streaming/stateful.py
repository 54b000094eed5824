"""Stream operators with state of their own: one value per second, entity or segment, written once or as it changes.

They run with ``transformWithStateInPandas``; state lies in RocksDB (``use_state_store``), where appending to a list or
changing one key of a map writes that entry and not the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY_ROWS = 10_000  # in an entry of a list of rows


def use_state_store(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, which lists, maps and timers need, and commit what a batch changed only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class SecondEvents(StatefulProcessor):
    """State of a share of all media: the rows of open seconds, thousands to an entry; a timer at the next end.

    A share has many media, so the calls of Python and of the state store follow the number of shares, not of media.
    """

    OUT = "media long, second timestamp, count long, objects string, late boolean"
    FIELDS = ["media", "named", "second", "frame_no", "framed", "label"]

    def __init__(self, width_us: int):
        self.width = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState(
            "parts", "media array<long>, named array<boolean>, second array<long>, frame_no array<long>, framed array<boolean>, label array<string>"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, due = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            late = self._ended(pdf, mark)
            if late.any():
                found = pdf[late]
                yield self._rows(found, np.ones(len(found), np.int64), found["label"].fillna("").tolist(), True)
            pdf = pdf[~late]
            if len(pdf):
                self.parts.appendList(self._entries(pdf))
                end = self._end(int(pdf["second"].min()))
                due = end if due is None else min(due, end)
        if due is not None:
            times = list(self.handle.listTimers())
            if not times or due < min(times):
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, due, rest = timerValues.getCurrentWatermarkInMs(), [], []
        for entry in self.parts.get() if self.parts.exists() else []:
            pdf = pd.DataFrame(dict(zip(self.FIELDS, entry)))
            ended = self._ended(pdf, mark)
            due.append(pdf[ended])
            rest.append(pdf[~ended])
        if sum(map(len, rest)):
            left = pd.concat(rest, ignore_index=True)
            self.parts.put(self._entries(left))
            self.handle.registerTimer(self._end(int(left["second"].min())))
        else:
            self.parts.clear()
        if sum(map(len, due)):
            yield self._seconds(pd.concat(due, ignore_index=True))

    def _seconds(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """One row per media and second, labels in the order of frames; what is null comes first."""
        code, _ = pd.factorize(pdf["label"], sort=True)
        pdf = pdf.assign(code=code).sort_values(["media", "named", "second", "framed", "frame_no", "code"], kind="stable", ignore_index=True)
        new = np.zeros(len(pdf), bool)
        for c in ("media", "named", "second"):
            new[1:] |= pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1]
        new[0] = True
        begin = np.flatnonzero(new)
        ends, labels = np.append(begin[1:], len(pdf)), pdf["label"].tolist()
        objects = [",".join([x for x in labels[a:b] if isinstance(x, str)]) for a, b in zip(begin.tolist(), ends.tolist())]
        return self._rows(pdf.iloc[begin], ends - begin, objects, False)

    def _ended(self, pdf: pd.DataFrame, mark: int) -> np.ndarray:
        return self._end(pdf["second"].to_numpy(np.int64)) <= mark

    def _end(self, second):
        return (second + self.width) // 1000

    def _entries(self, pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.assign(label=pdf["label"].astype(object).where(pdf["label"].notna(), None))
        parts = (pdf.iloc[at : at + ENTRY_ROWS] for at in range(0, len(pdf), ENTRY_ROWS))
        return [tuple(part[c].tolist() for c in self.FIELDS) for part in parts]

    @staticmethod
    def _rows(pdf: pd.DataFrame, count: np.ndarray, objects: list, late: bool) -> pd.DataFrame:
        media = pd.arrays.IntegerArray(pdf["media"].to_numpy(np.int64, copy=True), ~pdf["named"].to_numpy(bool))
        second = pd.to_datetime(pdf["second"].to_numpy(np.int64), unit="us")
        return pd.DataFrame({"media": media, "second": second, "count": count, "objects": objects, "late": late})

    def close(self) -> None:
        pass


def second_events_and_late_rows(
    detections: DataFrame, lateness: str = "10 seconds", width_us: int = 1_000_000, shares: int = 64
) -> DataFrame:
    """Detections (media, ts, frame_no, label) per media and second, and those that came too late: ``late`` is true.

    A second is emitted, with its labels in the order of frames, when the watermark reaches its end.  A row whose second
    had ended then is not lost: it is a row of its own with count 1.  Rows without a time are left out, as they have no
    second.  The minutes of all media are dealt to ``shares`` groups: a crowded media is several tasks, and many small
    media are one.  A task holds the open rows of one share at a time, so more rows at once ask for more shares.
    """
    us = F.unix_micros("ts")
    second = (F.floor(us / width_us) * width_us).cast("long")
    media, frame = F.col("media").cast("long"), F.col("frame_no").cast("long")
    # Without its time column a row is not dropped by the watermark, which only drives the timers.
    rows = detections.withWatermark("ts", lateness).filter("ts is not null")
    rows = rows.select(
        # A second lies in one share, whatever its width: shares are dealt by the minute in which it begins.
        F.pmod(F.xxhash64(media, F.floor(second / 60_000_000)), F.lit(shares)).cast("int").alias("share"),
        F.coalesce(media, F.lit(0)).alias("media"), media.isNotNull().alias("named"), second.alias("second"),
        F.coalesce(frame, F.lit(0)).alias("frame_no"), frame.isNotNull().alias("framed"), "label",
    )
    return rows.groupBy("share").transformWithStateInPandas(
        statefulProcessor=SecondEvents(width_us), outputStructType=SecondEvents.OUT, outputMode="Append", timeMode="EventTime"
    )


class OnlineClusters(StatefulProcessor):
    """State of a media: its entities as a list, to which new ones are appended."""

    def __init__(self, threshold: float, policy: str):
        self.threshold, self.policy = threshold, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entities = handle.getListState("entities", "vector array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["t", "id"], kind="stable", ignore_index=True)
        vectors = np.stack([np.asarray(v, np.float64) for v in pdf["embedding"]])
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, norms, out=vectors, where=norms > 0)
        held = [np.asarray(e[0], np.float64) for e in self.entities.get()] if self.entities.exists() else []
        old = n = len(held)
        known = np.empty((max(16, 2 * n), vectors.shape[1]))
        if n:
            known[:n] = held
        numbers = np.empty(len(vectors), np.int64)
        for i, u in enumerate(vectors):
            sims = np.round(known[:n] @ u, 12)
            if n and sims.max() >= self.threshold:
                numbers[i] = int(sims.argmax() if self.policy == "best" else np.argmax(sims >= self.threshold))
                continue
            if n == len(known):
                known = np.vstack([known, np.empty_like(known)])
            known[n], numbers[i] = u, n
            n += 1
        if n > old:
            self.entities.appendList([(known[i].tolist(),) for i in range(old, n)])
        yield pd.DataFrame({"media": pdf["media"], "id": pdf["id"], "entity_no": numbers + 1})

    def close(self) -> None:
        pass


def online_clusters(detections: DataFrame, threshold: float, policy: str = "best") -> DataFrame:
    """Entities per media (media, id, t, embedding) as by ``operators.clustering.online_clusters``.

    Rows of a micro-batch are taken by (t, id), so input in that order gives the batch result.  A batch writes the
    vectors of the entities that it opens and nothing of those known before.
    """
    rows = detections.select("media", "id", "t", "embedding").filter("embedding is not null")
    return rows.groupBy("media").transformWithStateInPandas(
        statefulProcessor=OnlineClusters(threshold, policy), outputStructType="media long, id long, entity_no long",
        outputMode="Append", timeMode="None",
    )


class SlidingSegments(StatefulProcessor):
    """State of a media: how far it has come, and the counts of its open segments by number."""

    OUT = "media long, segment_index long, utterances long, chars long, late boolean"

    def __init__(self, length: float, hop: float, lateness: float, idle_ms: int | None):
        self.length, self.hop, self.lateness, self.idle = length, hop, lateness, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "seconds double")
        self.segments = handle.getMapState("segments", "segment_index long", "utterances long, chars long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock = self.clock.get()[0] if self.clock.exists() else -np.inf
        closed, ended, late = clock - self.lateness, False, []
        for pdf in rows:
            ended |= bool(pdf["start"].isna().any())
            pdf = pdf[pdf["start"].notna()]
            if pdf.empty:
                continue
            start = pdf["start"].to_numpy(float)
            clock = max(clock, float(start.max()))
            last = np.floor(start / self.hop).astype(np.int64)
            first = np.maximum(0, np.floor((start - self.length) / self.hop).astype(np.int64) + 1)
            times = last - first + 1
            index = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            counted = pd.DataFrame({"i": index, "chars": np.repeat(pdf["chars"].to_numpy(np.int64), times)}).groupby("i")["chars"].agg(["size", "sum"])
            for i, n, chars in counted.itertuples():
                if i * self.hop + self.length <= closed:
                    late.append((key[0], i, n, chars, True))
                    continue
                n0, c0 = self.segments.getValue((i,)) if self.segments.containsKey((i,)) else (0, 0)
                self.segments.updateValue((i,), (int(n0 + n), int(c0 + chars)))
        if np.isfinite(clock):
            self.clock.update((float(clock),))
        if self.idle is not None:
            for ms in list(self.handle.listTimers()):
                self.handle.deleteTimer(ms)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        found = late + self._close(key, np.inf if ended else clock - self.lateness)
        if found:
            yield pd.DataFrame(found, columns=["media", "segment_index", "utterances", "chars", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self._close(key, np.inf)
        if found:
            yield pd.DataFrame(found, columns=["media", "segment_index", "utterances", "chars", "late"])

    def _close(self, key, until: float) -> list:
        """Segments that end up to a media time; when all close, the media is over for the rows to come."""
        over = [(k[0], *v) for k, v in self.segments.iterator() if k[0] * self.hop + self.length <= until]
        for i, _, _ in over:
            self.segments.removeKey((i,))
        if until == np.inf:
            self.clock.update((np.inf,))
        return [(key[0], i, n, chars, False) for i, n, chars in sorted(over)]

    def close(self) -> None:
        pass


def sliding_segments(
    utterances: DataFrame, lateness: float = 60, length: float = 50, hop: float = 35, idle_ms: int | None = None
) -> DataFrame:
    """Utterances (media, start, text) per overlapping segment of each media, on the media's own clock.

    ``start`` is in seconds of media time.  A segment is emitted once its own media has come ``lateness`` seconds past
    its end, whatever other media do, so media may arrive in any order.  A row without a start ends its media and emits
    what is open; so does, with ``idle_ms``, a media of which nothing came for so long.  What comes for a segment that
    was emitted is a row with ``late``: counted, not lost.
    """
    rows = utterances.select(F.col("media").cast("long").alias("media"), F.col("start").cast("double").alias("start"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    return rows.groupBy("media").transformWithStateInPandas(
        statefulProcessor=SlidingSegments(length, hop, lateness, idle_ms), outputStructType=SlidingSegments.OUT,
        outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime",
    )
