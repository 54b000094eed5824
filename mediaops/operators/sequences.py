"""Stills: file-name clock, sequences of frames, best frame, processing filter."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.plans.slices import MAX_GROUP_ROWS, SLICE, has_large_group, running_sum, slice_by_order, with_previous
from mediaops.plans.staging import cut_lineage

JOIN_GAP = 0.5
GAP = int(JOIN_GAP * 1_000_000)
KEEP = GAP + 1_000_000
SLICE_STILLS = 100_000  # of a large directory that a task holds at once
NO_DIR = "\x00"  # stands for a null directory where slices are paired by equality


def file_clock(stem: Column) -> tuple[Column, Column]:
    """(timestamp, frame number) of a name like ``20250922144438199-1``; null when it is not one.

    At least 14 digits are needed before the dash; three more are milliseconds.
    """
    digits = F.regexp_extract(stem, r"^(\d{14,})-(\d+)$", 1)
    millis = F.when(F.length(digits) >= 17, F.substring(digits, 15, 3)).otherwise(F.lit("000"))
    parts = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{3})$"
    text = F.regexp_replace(F.concat(F.substring(digits, 1, 14), millis), parts, "$1-$2-$3 $4:$5:$6.$7")
    stamp = text.try_cast("timestamp")
    frame = F.regexp_extract(stem, r"^(\d{14,})-(\d+)$", 2)
    return stamp, F.when((frame != "") & stamp.isNotNull(), frame.try_cast("long"))


def parse_file_names(files: DataFrame, name: str = "name") -> DataFrame:
    """Add stem, taken_at and frame_no from the file name."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    stamp, frame = file_clock(stem)
    return files.withColumn("stem", stem).withColumn("taken_at", stamp).withColumn("frame_no", frame)


class OpenSequences:
    """Open sequences of one directory, looked up by their last frame number, in the order in which they were opened.

    A sequence is [last frame, its time, rank, stills so far, name of the first still].  Times in name order step back
    by less than a second (names of 15 and 16 digits have no milliseconds), so what is older than ``KEEP`` is over.
    """

    def __init__(self, over: list[list] | None = None) -> None:
        self.by_frame: dict[int, list[list]] = {}
        self.opened = self.taken = 0
        self.over = over  # where sequences go that are forgotten

    def _live(self, held: list[list], at: int) -> list[list]:
        if self.over is not None:
            self.over += [s for s in held if at - s[1] > KEEP]
        return [s for s in held if at - s[1] <= KEEP]

    def open(self, frame: int, at: int, count: int, name: str | None) -> list:
        sequence = [frame, at, self.opened, count, name]
        self.opened += 1
        self._put(sequence)
        return sequence

    def _put(self, sequence: list) -> None:
        bisect.insort(self.by_frame.setdefault(sequence[0], []), sequence, key=lambda s: s[2])

    def take(self, frame: int, at: int, name: str) -> list:
        """The sequence that a still joins, now with it."""
        self.taken += 1
        if self.taken % 10_000 == 0:
            self.by_frame = {f: kept for f, held in self.by_frame.items() if (kept := self._live(held, at))}
        held = self.by_frame.get(frame - 1, []) if frame > 1 else []
        place = next((i for i, s in enumerate(held) if abs(at - s[1]) <= GAP), None)
        if place is None:
            sequence = self.open(frame, at, 1, name)
        else:
            sequence = held.pop(place)
            sequence[0], sequence[1], sequence[3] = frame, at, sequence[3] + 1
            self._put(sequence)
        if place is None and len(held) > 16 or place is not None and place > 16:
            held[:] = self._live(held, at)
        return sequence

    def live(self, at: int) -> list[list]:
        return sorted((s for held in self.by_frame.values() for s in held if at - s[1] <= KEEP), key=lambda s: s[2])


STILL = "dir string, name string, at long, frame_no long, sequence_id string, pos long"
OPEN = "array<struct<frame:long,at:long,ref:long,added:long,name:string>>"


def build_sequences(files: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Give every still of a directory its sequence: rows (dir, name, taken_at, frame_no, sequence_id, pos).

    In name order, frame 1 opens a sequence; frame n > 1 joins the first open sequence whose
    last frame is n - 1, at most half a second before or after, else opens one itself.  Names
    without a clock stand alone.  ``sequence_id`` is the name of the sequence's first file.

    Directories of at most ``max_rows`` stills are folded as sorted streams.  A larger one is cut
    into slices of names, see ``_sliced_sequences``; neither a directory nor an endless chain of
    stills is bound to one task.
    """
    has_clock = F.col("taken_at").isNotNull() & F.col("frame_no").isNotNull()
    alone = files.filter(~has_clock).select(
        "dir", "name", "taken_at", "frame_no", F.col("name").alias("sequence_id"), F.lit(1).cast("long").alias("pos")
    )
    clocked = files.filter(has_clock).select("dir", "name", F.unix_micros("taken_at").alias("at"), "frame_no")
    crowded = clocked.groupBy("dir").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows).select("dir")
    crowded = cut_lineage(crowded)  # at most one row per ``max_rows`` stills
    if crowded.isEmpty():
        joined = _streamed_sequences(clocked)
    else:
        apart = clocked.join(F.broadcast(crowded.withColumn("_large", F.lit(True))), clocked["dir"].eqNullSafe(crowded["dir"]), "left").drop(crowded["dir"])
        small = apart.filter("_large is null").drop("_large")
        joined = _streamed_sequences(small).unionByName(_sliced_sequences(apart.filter("_large").drop("_large"), max_rows))
    return joined.select("dir", "name", F.timestamp_micros("at").alias("taken_at"), "frame_no", "sequence_id", "pos").unionByName(alone)


def _streamed_sequences(clocked: DataFrame) -> DataFrame:
    """The fold over rows sorted by (dir, name); remembers the sequences of the last moments of one directory."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, known = (), OpenSequences()
        for pdf in batches:
            ids, places = [], []
            for d, name, at, frame in zip(pdf["dir"], pdf["name"], pdf["at"], pdf["frame_no"]):
                if (d,) != last:
                    last, known = (d,), OpenSequences()
                sequence = known.take(frame, at, name)
                ids.append(sequence[4])
                places.append(sequence[3])
            yield pdf.assign(sequence_id=ids, pos=places)

    ordered = clocked.repartition("dir").sortWithinPartitions("dir", "name")
    return ordered.mapInPandas(fold, STILL)


def _sliced_sequences(clocked: DataFrame, max_rows: int) -> DataFrame:
    """Sequences of large directories, folded slice by slice of names.

    A slice is entered with the open sequences (last frame, time) that the one before left.  First all slices are
    folded as if entered with none; then those whose predecessor turned out to leave something else are folded again,
    until nothing changes.  What enters is forgotten after a pause of half a second or when the frames that could tell
    sequences apart have passed, so the second round is the last unless a chain depends on its start over whole slices;
    each round fixes at least one more slice of a directory.  Names and counts do not decide anything: they follow the
    sequences through the slices afterwards, from one row per slice.
    """
    on = ["dir", SLICE]
    sliced, _ = slice_by_order(clocked, ["dir"], ["name"], min(max_rows, SLICE_STILLS), large=True)
    nothing = F.array().cast("array<struct<frame:long,at:long>>")

    def enter(entry) -> tuple[OpenSequences, int]:
        known = OpenSequences()
        for s in entry:
            known.open(s["frame"], s["at"], 0, None)
        return known, known.opened

    def leave(key: tuple, rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        columns = ["dir", SLICE, "entry", "left"]
        if rows.empty or entries.empty:
            return pd.DataFrame(columns=columns)
        rows, entry = rows.sort_values("name", kind="stable"), list(entries["entry"].iloc[0])
        known, _ = enter(entry)
        for name, at, frame in zip(rows["name"], rows["at"], rows["frame_no"]):
            known.take(int(frame), int(at), name)
        left = [{"frame": f, "at": t, "ref": ref, "added": n, "name": name} for f, t, ref, n, name in known.live(int(rows["at"].iloc[-1]))]
        return pd.DataFrame([[*key, [{"frame": s["frame"], "at": s["at"]} for s in entry], left]], columns=columns)

    def folded(entries: DataFrame) -> DataFrame:
        rows = sliced.join(F.broadcast(entries.select(*on)), on, "left_semi") if entries is not first else sliced
        both = rows.groupBy(*on).cogroup(entries.groupBy(*on))
        return cut_lineage(both.applyInPandas(leave, f"dir string, {SLICE} int, entry array<struct<frame:long,at:long>>, left {OPEN}"))

    sliced = sliced.withColumn("dir", F.coalesce("dir", F.lit(NO_DIR)))
    first = cut_lineage(sliced.select(*on).distinct().withColumn("entry", nothing))  # a few rows per slice of the table
    state = folded(first)
    while True:
        before = F.lag("left").over(Window.partitionBy("dir").orderBy(SLICE))
        wanted = F.coalesce(F.transform(before, lambda s: F.struct(s["frame"].alias("frame"), s["at"].alias("at"))), nothing)
        checked = cut_lineage(state.withColumn("wanted", wanted))
        wrong = checked.filter("entry <> wanted").select(*on, F.col("wanted").alias("entry"))
        if wrong.isEmpty():
            break
        state = checked.filter("entry = wanted").select(*on, "entry", "left").unionByName(folded(wrong))

    def name_entries(key: tuple, slices: pd.DataFrame) -> pd.DataFrame:
        named, rows = [], []
        for number, entry, left in slices.sort_values(SLICE)[[SLICE, "entry", "left"]].itertuples(index=False):
            rows.append([key[0], number, [{**s, "added": n, "name": name} for s, (name, n) in zip(entry, named)]])
            named = [(s["name"], s["added"]) if s["ref"] >= len(entry) else (named[s["ref"]][0], named[s["ref"]][1] + s["added"]) for s in left]
        return pd.DataFrame(rows, columns=["dir", SLICE, "entry"])

    entries = state.groupBy("dir").applyInPandas(name_entries, f"dir string, {SLICE} int, entry array<struct<frame:long,at:long,added:long,name:string>>")

    def walk(key: tuple, rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        rows, known = rows.sort_values("name", kind="stable"), OpenSequences()
        for s in entries["entry"].iloc[0]:
            known.open(s["frame"], s["at"], s["added"], s["name"])
        found = [known.take(int(f), int(t), n)[3:] for n, t, f in zip(rows["name"], rows["at"], rows["frame_no"])]
        found = [tuple(x) for x in found]
        return rows[["dir", "name", "at", "frame_no"]].assign(sequence_id=[x[1] for x in found], pos=[x[0] for x in found])

    walked = sliced.groupBy(*on).cogroup(cut_lineage(entries).groupBy(*on)).applyInPandas(walk, STILL)
    return walked.withColumn("dir", F.when(F.col("dir") != NO_DIR, F.col("dir")))


def simple_sequences(files: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Sequences of directories without interleaving: a file continues the one just before it.

    Built-in scans only; equal to ``build_sequences`` when sequences do not overlap in time.
    """
    rows = files.filter("taken_at is not null and frame_no is not null").withColumn("at", F.unix_micros("taken_at"))
    large = has_large_group(files, ["dir"], max_rows)
    seen = with_previous(rows, ["dir"], ["name"], ["at", "frame_no"], max_rows=max_rows, large=large)
    follows = (
        (F.col("frame_no") > 1)
        & (F.col("frame_no") == F.col("prev_frame_no") + 1)
        & (F.col("at") - F.col("prev_at") <= int(JOIN_GAP * 1_000_000))
    )
    numbered = running_sum(seen, ["dir"], ["name"], F.when(follows, 0).otherwise(1), "sequence_no", max_rows, large)
    return numbered.select("dir", "name", "frame_no", "sequence_no")


def best_frames(frames: DataFrame, detections: DataFrame, keys: tuple[str, ...] = ("dir", "sequence_id")) -> DataFrame:
    """Best frame per sequence: 100 for success plus 10 times the best reading confidence.

    ``frames`` has keys, pos, name and status (null when a frame has no metadata: it is not
    considered); ``detections`` has name, text and confidence.  The first frame wins ties, and
    a sequence without any metadata gives its first frame.
    """
    conf = detections.filter("text is not null and text <> ''").groupBy("dir", "name").agg(
        F.max("confidence").alias("conf")
    )
    scored = frames.join(conf, ["dir", "name"], "left").withColumn(
        "score",
        F.when(
            F.col("status").isNotNull(),
            F.when(F.col("status") == "success", 100.0).otherwise(0.0) + 10.0 * F.coalesce("conf", F.lit(0.0)),
        ),
    )
    best = F.struct(F.coalesce("score", F.lit(-1.0)).alias("s"), -F.col("pos"))
    return scored.groupBy(*keys).agg(
        F.max_by(F.struct("name", "score", "pos"), best).alias("b"), F.count(F.lit(1)).alias("frames")
    ).select(*keys, F.col("b.name").alias("best_name"), F.col("b.score").alias("score"), "frames")


def to_process(files: DataFrame, metadata: DataFrame, skip_processed: bool = True, keys: tuple[str, ...] = ("dir", "name")) -> DataFrame:
    """Files without metadata, or whose last outcome was not a success."""
    if not skip_processed:
        return files
    return files.join(metadata.filter("status = 'success'").select(*keys), list(keys), "left_anti")


def flatten_stills(metadata: DataFrame) -> dict[str, DataFrame]:
    """Image, vehicle and code rows out of nested still metadata."""
    image = metadata.select(
        "path", "status", F.col("file_info.dimensions.width").alias("width"),
        F.col("file_info.dimensions.height").alias("height"),
        F.col("radar_data.speed").alias("speed"), F.col("radar_data.direction").alias("direction"),
        F.coalesce(F.size("vehicles"), F.lit(0)).alias("vehicles"),
        F.coalesce(F.size("license_plates"), F.lit(0)).alias("codes"),
        F.coalesce(F.size("yolo_plate_detections"), F.lit(0)).alias("code_boxes"),
    )
    vehicle = metadata.select("path", F.posexplode("vehicles").alias("pos", "v")).select("path", "pos", "v.*")
    code = metadata.select("path", F.posexplode("license_plates").alias("pos", "p")).select("path", "pos", "p.*")
    box = metadata.select("path", F.posexplode("yolo_plate_detections").alias("pos", "b")).select("path", "pos", "b.*")
    return {"images": image, "vehicles": vehicle, "codes": code, "code_boxes": box}


def first_usable_code(boxes: DataFrame, codes: DataFrame, images: DataFrame) -> DataFrame:
    """First detected box with a text, else the first code with a text, per image."""
    def first(rows: DataFrame, text: str, out: str) -> DataFrame:
        return rows.filter(F.col(text).isNotNull() & (F.col(text) != "")).groupBy("path").agg(
            F.min_by(text, "pos").alias(out)
        )

    return (
        images.select("path")
        .join(first(boxes, "recognized_text", "_a"), "path", "left")
        .join(first(codes, "text", "_b"), "path", "left")
        .select("path", F.coalesce("_a", "_b").alias("code"), F.coalesce("_a", "_b").isNotNull().alias("recognised"))
    )
