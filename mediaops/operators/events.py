"""Per-second detection events and change events along a media."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.functions.clock import hms_round, whole_second
from mediaops.functions.vectors import cosine_between
from mediaops.plans.folds import fold_by_key
from mediaops.plans.matching import SCORE_DIGITS
from mediaops.plans.slices import MAX_GROUP_ROWS, SLICE, has_large_group, slice_by_order, with_previous


def with_second(detections: DataFrame, t: str = "t") -> DataFrame:
    """Add the whole second (nearest, halves to even) and its ``HH:MM:SS`` text."""
    return detections.withColumn("second", whole_second(F.col(t))).withColumn("timestamp", hms_round(F.col(t)))


def list_events(
    detections: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lists: Mapping[str, Column],
    counts: Mapping[str, Column] | None = None,
    count_name: str = "count",
) -> DataFrame:
    """One row per key with parallel comma-joined lists in row order, and counts.

    Always one row, however crowded a key is: each task collects its own part of a list before
    the shuffle, so the task that joins the parts holds one key's list, as its row does.
    """
    rows = detections.select(
        *keys, *order, *[c.cast("string").alias(f"_l_{n}") for n, c in lists.items()],
        *[c.alias(f"_c_{n}") for n, c in (counts or {}).items()],
    )
    names = [f"_l_{n}" for n in lists]
    item = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *names)
    grouped = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(item)).alias("_items"),
        F.count(F.lit(1)).alias(count_name),
        *[F.sum(F.col(f"_c_{n}").cast("long")).alias(n) for n in (counts or {})],
    )
    return grouped.withColumns({n: F.array_join(F.col(f"_items._l_{n}"), ",") for n in lists}).drop("_items")


def two_digits(value: Column) -> Column:
    """Text with two decimals."""
    return F.format_string("%.2f", value)


def _point(x: str = "cx", y: str = "cy") -> Column:
    return F.concat(F.lit("("), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit(")"))


KEYS = ("media", "second", "timestamp")
ORDER = ("frame_no", "pos")


def object_events(detections: DataFrame) -> DataFrame:
    """Objects per second: classes, confidences, centres."""
    lists = {"objects": F.col("label"), "confidences": two_digits(F.col("confidence")), "coordinates": _point()}
    return list_events(with_second(detections), KEYS, ORDER, lists)


def code_events(codes: DataFrame) -> DataFrame:
    """Codes per second: numbers, countries, types, regions, confidences, centres."""
    lists = {
        "plate_numbers": F.col("plate_number"), "countries": F.col("country"), "plate_types": F.col("plate_type"),
        "regions": F.col("region"), "confidences": two_digits(F.col("confidence")), "coordinates": _point(),
    }
    return list_events(with_second(codes), KEYS, ORDER, lists)


def vehicle_events(vehicles: DataFrame) -> DataFrame:
    """Vehicles per second with a ``type:count`` summary in order of first appearance."""
    rows = with_second(vehicles)
    lists = {"vehicle_types": F.col("label"), "confidences": two_digits(F.col("confidence")), "coordinates": _point()}
    events = list_events(rows, KEYS, ORDER, lists)
    # Counted per type first: few rows per second are gathered.
    by_type = rows.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("at"))
    text = F.concat(F.col("label"), F.lit(":"), F.col("n").cast("string"))
    summary = by_type.groupBy(*KEYS).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("at", text.alias("text")))), lambda x: x["text"]), ", "
        ).alias("vehicle_summary")
    )
    return events.join(summary, list(KEYS))


def make_events(vehicles: DataFrame) -> DataFrame:
    """Make, model and year per second with identified and unknown counts."""
    lists = {
        "makes": F.col("make"), "models": F.col("model"), "years": F.col("year"),
        "confidences": two_digits(F.col("confidence")), "coordinates": _point(),
    }
    known = F.col("make") != "Unknown"
    return list_events(
        with_second(vehicles), KEYS, ORDER, lists, {"identified_count": known, "unknown_count": ~known}
    )


def entity_events(detections: DataFrame) -> DataFrame:
    """Entities per second: ids, centres, confidences and attributes."""
    lists = {
        "entities": F.col("entity_id"), "coordinates": _point(), "confidences": two_digits(F.col("confidence")),
        "ages": F.col("age"), "genders": F.col("gender"), "emotions": F.col("emotion"),
    }
    return list_events(with_second(detections), KEYS, ORDER, lists)


def pose_events(poses: DataFrame) -> DataFrame:
    """Poses per second: gestures, confidences, centres, head, arms and body."""
    lists = {
        "gestures": F.col("gesture"), "confidences": two_digits(F.col("confidence")), "coordinates": _point(),
        "head_poses": F.col("head_pose"), "arm_positions": F.col("arm_position"),
        "body_orientations": F.col("body_orientation"),
    }
    return list_events(with_second(poses), KEYS, ORDER, lists, count_name="person_count")


def category_counts(events: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """How often each value occurs in comma-joined lists, most frequent first."""
    rows = events.filter((F.col(column).isNotNull()) & (F.col(column) != "")).select(
        F.explode(F.split(column, ",")).alias("value")
    )
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
    return counts.limit(top) if top else counts


def distinct_values(events: DataFrame, column: str) -> DataFrame:
    """Distinct values of comma-joined lists."""
    return (
        events.filter((F.col(column).isNotNull()) & (F.col(column) != ""))
        .select(F.explode(F.split(column, ",")).alias("value"))
        .distinct()
    )


def label_changes(
    frames: DataFrame, label: str = "label", order: Sequence[str] = ("frame_no",), keep: Sequence[str] = (),
    max_rows: int = MAX_GROUP_ROWS, large: bool | None = None,
) -> DataFrame:
    """First row of each media, then one row per change of the label, with the label before."""
    seen = with_previous(
        frames.select("media", *order, label, *keep), ["media"], order, [label], "previous_", max_rows, large
    )
    previous = F.col(f"previous_{label}")
    return seen.filter(previous.isNull() | (previous != F.col(label))).withColumn("change_detected", previous.isNotNull())


def change_similarity(
    frames: DataFrame, label: str = "label", vec: str = "embedding", order: Sequence[str] = ("frame_no",),
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Label changes with the similarity of the vector to the one at the change before (1.0 at first).

    Only change rows carry a reference vector, so this is a look at the preceding change.
    """
    large = has_large_group(frames, ["media"], max_rows)
    changes = label_changes(frames, label, order, [vec], max_rows, large)
    seen = with_previous(changes, ["media"], order, [vec], max_rows=max_rows, large=large)
    score = F.when(F.col("change_detected"), F.round(cosine_between(vec, f"prev_{vec}"), SCORE_DIGITS)).otherwise(1.0)
    return seen.withColumn("similarity", score).drop(vec, f"prev_{vec}")


INTERVAL = 40
DEGRADED_LIMIT = 3


def restart_alerts(
    segments: DataFrame, interval: int = INTERVAL, limit: int = DEGRADED_LIMIT, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Alerts before segments: every ``interval``-th index, or ``limit`` degraded segments so far.

    Rows (media, segment_index, degraded).  The check looks at the segments before the row.
    An interval alert comes first and leaves the count as it is; a degradation alert resets it.
    A count of ``limit`` acts like any larger one until the next check resets it, so counting
    stops there and a slice has ``limit`` + 1 entry states.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType(
        [segments.schema["media"], segments.schema["segment_index"], T.StructField("reason", T.StringType())]
    )

    def run(rows: pd.DataFrame, first: np.ndarray, state: float) -> tuple[list, float]:
        found = []
        count = min(int(state), limit)
        for new, i, bad in zip(first, rows["segment_index"].to_numpy(), rows["degraded"].to_numpy()):
            if new:
                count = 0
            if (i + 1) % interval == 0:
                found.append("interval")
            elif count >= limit:
                found.append("degraded")
                count = 0
            else:
                found.append(None)
            count = min(count + int(bad), limit)
        return found, float(count)

    def walk(rows: pd.DataFrame, first: np.ndarray, state: float, opened: int) -> tuple[pd.DataFrame, float, int]:
        found, state = run(rows, first, state)
        out = rows[["media", "segment_index"]].assign(reason=found)
        return out[out["reason"].notna()], state, opened

    states = list(range(limit + 1))

    def probe(rows: pd.DataFrame) -> tuple[list[float], list[float], list[int]]:
        return [float(s) for s in states], [run(rows, np.zeros(len(rows), bool), s)[1] for s in states], [1] * len(states)

    def choose(state: float, marks: np.ndarray) -> int:
        return int(np.nonzero(marks == state)[0][0])

    rows = segments.select("media", "segment_index", "degraded")
    return fold_by_key(rows, ["media"], ["segment_index"], walk, schema, 0.0, probe, choose, max_rows)
