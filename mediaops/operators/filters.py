"""Row filters, lookups, timelines and plain projections."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label columns a caller may choose from; anything else means the online label.
LABEL_COLUMNS = {"onthefly": "entity_id", "postclustering": "entity_id_batch", "alt": "entity_id_alt"}


def filter_by(table: DataFrame, spec: Mapping[str, object] | None) -> DataFrame:
    """Conjunction of equalities (scalar) and IN lists (list); an empty spec keeps all rows."""
    unknown = [c for c in (spec or {}) if c not in table.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    conds = [
        F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v)
        for c, v in (spec or {}).items()
    ]
    return table.filter(reduce(lambda a, b: a & b, conds)) if conds else table


def lookup(table: DataFrame, **key: object) -> DataFrame:
    """Rows with the given key values."""
    return filter_by(table, key)


def media_timeline(detections: DataFrame, media: object, entity: object | None = None) -> DataFrame:
    """Detections of one media in time order, optionally of one entity."""
    rows = detections.filter(F.col("media") == F.lit(media))
    if entity is not None:
        rows = rows.filter(F.col("entity_id") == F.lit(entity))
    return rows.orderBy("t", "id")


def entity_timeline(detections: DataFrame, entity: object) -> DataFrame:
    """Detections of one entity over all media."""
    return detections.filter(F.col("entity_id") == F.lit(entity)).orderBy("media", "t", "id")


def label_column(kind: str) -> str:
    return LABEL_COLUMNS.get(kind, LABEL_COLUMNS["onthefly"])


def cluster_detections(detections: DataFrame, media: object, kind: str, label: object) -> DataFrame:
    """Detections of one cluster under the chosen labeling."""
    return detections.filter(
        (F.col("media") == F.lit(media)) & (F.col(label_column(kind)) == F.lit(label))
    ).orderBy("t", "id")


def time_range(detections: DataFrame, entities: DataFrame, media: object, start: float, end: float) -> DataFrame:
    """Detections of a media between two times with the entity name when there is one."""
    names = entities.select("media", "entity_id", F.col("name").alias("entity_name"))
    rows = detections.filter((F.col("media") == F.lit(media)) & F.col("t").between(start, end))
    return rows.join(names, ["media", "entity_id"], "left").orderBy("t", "id")


def with_value(table: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    return table.filter(F.col(column).isNotNull()).orderBy(*order)


def without_value(table: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    return table.filter(F.col(column).isNull()).orderBy(*order)


def usable_detections(
    detections: DataFrame, labels: Sequence | None = None, min_confidence: float | None = None, min_side: int | None = None
) -> DataFrame:
    """Detections of wanted classes, confident enough and large enough on both sides."""
    rows = detections
    if labels is not None:
        rows = rows.filter(F.col("label").isin(list(labels)))
    if min_confidence is not None:
        rows = rows.filter(F.col("confidence") >= min_confidence)
    if min_side is not None:
        rows = rows.filter((F.col("w") >= min_side) & (F.col("h") >= min_side))
    return rows


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def search_cards(hits: DataFrame) -> DataFrame:
    """Search hits as shown to a user: renamed and rounded to 3 digits."""
    return hits.select(
        "id", "media", "segment_index", "description",
        *[half_even(F.col(c), 3).alias(n) for c, n in
          (("relevance_score", "relevance"), ("desc_score", "desc_score"), ("search_score", "search_score"))],
    )


def entity_cards(rollup: DataFrame, preview: int = 5) -> DataFrame:
    """Cluster rollup as shown to a user: times to 2 digits, whole mean age, a preview of the ids."""
    return rollup.select(
        "media", "cluster_id", "detection_count",
        half_even(F.col("first_seen"), 2).alias("first_seen"),
        half_even(F.col("last_seen"), 2).alias("last_seen"),
        half_even(F.col("avg_age"), 0).cast("long").alias("avg_age"),
        F.col("common_gender").alias("gender"),
        F.array_join(F.slice(F.split("detection_ids", ","), 1, preview), ",").alias("detection_ids"),
    )


def media_cards(media: DataFrame) -> DataFrame:
    """Media list as shown to a user."""
    return media.select(
        F.col("media").alias("name"), F.col("path"), F.col("duration"), F.col("width"), F.col("height"), F.col("fps")
    )


def sampled_frames(frames: DataFrame, per_second: float, max_frames: int | None = None) -> DataFrame:
    """Every ``int(fps / per_second)``-th frame (at least every frame) with its time in seconds.

    ``frames`` has ``frame_no`` counted from 0 and the source ``fps``.  ``max_frames`` keeps the
    first sampled frames of each media; frame numbers are dense, so this is a plain filter.
    """
    step = F.greatest(F.lit(1), F.floor(F.col("fps") / per_second)).cast("long")
    rows = frames.withColumn("step", step).filter(F.pmod(F.col("frame_no"), F.col("step")) == 0)
    rows = rows.withColumn("sample_no", F.floor(F.col("frame_no") / F.col("step"))).withColumn(
        "t", F.col("frame_no") / F.col("fps")
    )
    return rows if max_frames is None else rows.filter(F.col("sample_no") < max_frames)


def frames_of(media: DataFrame, count: str = "frame_count") -> DataFrame:
    """One row per frame number of each media."""
    from mediaops.operators.segments import explode_range

    return explode_range(media, F.col(count), "frame_no")


def segment_timeline(segments: DataFrame, media: object, start: float, end: float) -> DataFrame:
    """Segments of one media whose start lies in a range, in order."""
    return segments.filter(
        (F.col("media") == F.lit(media)) & F.col("start_time").between(start, end)
    ).orderBy("start_time", "segment_index")


def highlight(text: Column, terms: Sequence[str]) -> Column:
    """Query terms marked in a text, ignoring case; no terms leave it as it is."""
    words = [re.escape(t) for t in terms if t.strip()]
    if not words:
        return text
    return F.regexp_replace(text, "(?i)(" + "|".join(words) + ")", "<b>$1</b>")


def timeline_events(clustered: DataFrame) -> DataFrame:
    """One row per (media, time, entity) with its attributes."""
    return clustered.select("media", "t", "entity_id", "age", "gender", "emotion")


def payload(detections: DataFrame, context: bool = True) -> DataFrame:
    """Stored image of a detection: the wider crop when asked for and present, else the tight one."""
    blob = F.coalesce("crop_context", "thumbnail") if context else F.col("thumbnail")
    return detections.select("id", blob.alias("payload")).filter("payload is not null")
