"""Sequences of stills on a stream: the frame-number rule with keyed state and event-time timers."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mediaops.operators.sequences import GAP, OpenSequences

RUN_ROWS = 100_000  # stills that wait, in a run at most
BLOCK_ROWS = 1_000  # in a block of a run
OUT_ROWS = 10_000  # sequences given on at once
STEP_BACK = 1_000_000  # by which the clock of a later name may be earlier
SEQUENCES = "dir string, sequence_id string, files long, first_frame long, last_frame long, started timestamp, ended timestamp"


class SequenceProcessor(StatefulProcessor):
    """State of a directory: stills that earlier names may still precede, and the open sequences in their order.

    A still is decided once the watermark is a second past it, in name order with all others; a sequence is over, and
    emitted, once the watermark is past everything that could join it.  One timer is set, for the next of these.

    Stills wait in runs, each ordered by name and cut into blocks.  Runs are merged block by block, so a task holds one
    block of every run, a hundredth of what waits, and only blocks with decided stills are written again.
    """

    def __init__(self, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS):
        self.run_rows, self.block_rows = run_rows, block_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "number long")
        self.waiting = handle.getMapState("waiting", "run long, block long", "name array<string>, at array<long>, frame_no array<long>")
        self.opened = handle.getListState("opened", "frame long, at long, files long, name string, first_frame long, started long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came, least = [], None
        for pdf in rows:
            whole = pdf["frame_no"].notna() & pdf["at"].notna()
            some = pdf[whole & pdf["name"].notna()]
            came += list(zip(some["name"], some["at"].astype("int64").tolist(), some["frame_no"].astype("int64").tolist()))
            if len(some):
                least = min(int(some["at"].min()), least if least is not None else 2**63)
            if len(came) >= self.run_rows:
                self._store(came)
                came = []
            alone = pdf[~whole & pdf["name"].notna()]
            if len(alone):
                yield self._rows(key, [(n, 1, None, None, None, None) for n in alone["name"]])
        if came:
            self._store(came)
        if least is not None:
            due, times = self._due(least + STEP_BACK), list(self.handle.listTimers())
            if not times or due < min(times):
                self.handle.registerTimer(due)

    def _store(self, came: list[tuple]) -> None:
        """One more run."""
        came.sort()
        number = self.runs.get()[0] if self.runs.exists() else 0
        self.runs.update((number + 1,))
        for block in range(0, len(came), self.block_rows):
            self.waiting.updateValue((number, block), tuple(list(c) for c in zip(*came[block : block + self.block_rows])))

    def _decided(self, blocks: list[tuple], horizon: int, later: list[int]) -> Iterator[tuple]:
        """Stills of a run up to ``horizon``, which leave the state; ``later`` gets the least time of those that stay."""
        for at_block in blocks:
            found = list(zip(*[c if isinstance(c, list) else c.tolist() for c in self.waiting.getValue(at_block)]))
            due, rest = [r for r in found if r[1] <= horizon], [r for r in found if r[1] > horizon]
            if rest:
                later.append(min(r[1] for r in rest))
            if due and rest:
                self.waiting.updateValue(at_block, tuple(list(c) for c in zip(*rest)))
            elif due:
                self.waiting.removeKey(at_block)
            yield from due

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        horizon = timerValues.getCurrentWatermarkInMs() * 1000 - STEP_BACK  # all stills up to here have come
        blocks: dict[int, list[tuple]] = {}
        for run, block in sorted(tuple(k) for k in self.waiting.keys()):
            blocks.setdefault(run, []).append((run, block))
        over: list[list] = []
        known, born = OpenSequences(over), {}
        for frame, at, files, name, first, started in [tuple(r) for r in self.opened.get()] if self.opened.exists() else []:
            born[known.open(frame, at, files, name)[2]] = (first, started)
        done, open_, timers, later = [], [], [], []

        def sort_out(held: list[list]) -> None:
            for frame, at, rank, files, name in held:
                first, started = born.pop(rank)
                if at + GAP <= horizon:
                    done.append((name, files, first, frame, started, at))
                else:
                    open_.append((rank, (frame, at, files, name, first, started)))
                    timers.append(at + GAP + STEP_BACK)

        for name, at, frame in heapq.merge(*[self._decided(b, horizon, later) for b in blocks.values()]):
            sequence = known.take(frame, at, name)
            born.setdefault(sequence[2], (frame, at))
            if len(over) >= OUT_ROWS:
                sort_out(over)
                over.clear()
                if done:
                    yield self._rows(key, done)
                    done.clear()
        for held in [over, *known.by_frame.values()]:
            sort_out(held)
        if open_:
            self.opened.put([v for _, v in sorted(open_)])
        else:
            self.opened.clear()
        timers += [at + STEP_BACK for at in later]
        if timers:  # the timer that fires is still listed, so this does not look for others
            self.handle.registerTimer(self._due(min(timers)))
        if done:
            yield self._rows(key, done)

    @staticmethod
    def _due(at: int) -> int:
        """The first millisecond behind a time; a timer that comes too early only sets the next."""
        return at // 1000 + 1

    @staticmethod
    def _rows(key, found: list) -> pd.DataFrame:
        pdf = pd.DataFrame(found, columns=["sequence_id", "files", "first_frame", "last_frame", "started", "ended"])
        for c in ("first_frame", "last_frame"):
            pdf[c] = pdf[c].astype("Int64")
        for c in ("started", "ended"):
            pdf[c] = pd.to_datetime(pdf[c].astype("Int64"), unit="us", utc=True).dt.tz_localize(None)
        pdf.insert(0, "dir", key[0])
        return pdf

    def close(self) -> None:
        pass


def frame_sequences(files: DataFrame, lateness: str = "10 seconds", run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sequences of a stream of stills (dir, name, taken_at, frame_no): one row each, when it is over.

    The rule is that of ``operators.sequences.build_sequences``.  Stills may come in any order within ``lateness`` of
    the newest one; later ones are dropped, as by any watermark.  A name without a clock is a row by itself at once.  A
    row without a name only moves the clock.  State is bounded by the stills within ``lateness`` of each directory and
    lies in RocksDB (``stateful.use_state_store``); a task holds ``run_rows`` of them, or ``block_rows`` of each run.
    """
    rows = files.withWatermark("taken_at", lateness).select("dir", "name", F.unix_micros("taken_at").alias("at"), "frame_no", "taken_at")
    return rows.groupBy("dir").transformWithStateInPandas(
        statefulProcessor=SequenceProcessor(run_rows, block_rows), outputStructType=SEQUENCES, outputMode="Append", timeMode="EventTime"
    )
