"""Statistics and rollups over media, segments, detections and processing outcomes.

Aggregates here keep small, fixed-size buffers and combine before the shuffle, so a media or
cluster that holds a large part of a table needs no special treatment.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.operators.filters import label_column
from mediaops.plans.slices import modes_by


def _n() -> Column:
    return F.count(F.lit(1))


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 6)).otherwise(0.0)


# --- clusters and entities -----------------------------------------------------------------


def cluster_rollup(detections: DataFrame, kind: str = "onthefly") -> DataFrame:
    """Clusters of each media under the chosen labeling, most detections first.

    Count, first and last time, mean age, most frequent gender (the smaller one on ties) and all
    distinct detection ids in order, comma-joined.  One scan: rows are counted per (cluster,
    gender) with partial sums first, and the few rows of a cluster are put together after that.
    """
    label = label_column(kind)
    keys = ["media", "cluster_id"]
    rows = detections.filter(F.col(label).isNotNull()).withColumn("cluster_id", F.col(label))
    parts = rows.groupBy(*keys, "gender").agg(
        _n().alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.sum("age").alias("ages"),
        F.count("age").alias("aged"), F.collect_set("id").alias("ids"),
    )
    known = F.col("gender").isNotNull()
    best = F.struct(-F.col("n"), F.col("gender"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
    return (
        parts.groupBy(*keys)
        .agg(
            F.sum("n").alias("detection_count"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
            F.round(F.sum("ages") / F.sum("aged"), 6).alias("avg_age"),
            F.min_by(F.when(known, F.col("gender")), F.when(known, best)).alias("common_gender"),
            F.array_join(ids.cast("array<string>"), ",").alias("detection_ids"),
        )
        .orderBy("media", F.desc("detection_count"), "cluster_id")
    )


def cluster_members(detections: DataFrame, kind: str = "onthefly") -> DataFrame:
    """Distinct detection ids of each cluster, one per row."""
    label = label_column(kind)
    return detections.filter(F.col(label).isNotNull()).select("media", F.col(label).alias("cluster_id"), "id").distinct()


def entities_by_media(entities: DataFrame, detections: DataFrame) -> DataFrame:
    """Entities with their number of detections in each media, most first.

    Detections are counted before the join, so the join has one row per entity and media.
    """
    counts = detections.groupBy("media", "entity_id").agg(_n().alias("detections_in_media"))
    return entities.join(counts, ["media", "entity_id"]).orderBy("media", F.desc("detections_in_media"), "entity_id")


def entity_statistics(entities: DataFrame, detections: DataFrame) -> DataFrame:
    """All entities with appearances, mean age and most frequent gender and emotion (null when unseen)."""
    keys = ["media", "entity_id"]
    stats = detections.groupBy(*keys).agg(_n().alias("n"), F.round(F.avg("age"), 6).alias("avg_age"))
    modes = modes_by(detections, keys, ["gender", "emotion"])
    return (
        entities.select(*keys, "name").join(stats, keys, "left").join(modes, keys, "left")
        .select(*keys, "name", F.coalesce("n", F.lit(0)).alias("appearances"), "avg_age", "common_gender", "common_emotion")
    )


def appearance_counts(detections: DataFrame) -> DataFrame:
    """Detections per entity."""
    return detections.filter("entity_id is not null").groupBy("media", "entity_id").agg(_n().alias("appearances"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    parts = [df.agg(_n().alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- speeds, frames, images ----------------------------------------------------------------


def speed_statistics(readings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Smallest, largest and mean speed; missing and zero speeds do not count."""
    return readings.filter("speed is not null and speed <> 0").groupBy(*keys).agg(
        F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"),
        F.round(F.avg("speed"), 6).alias("avg_speed"), _n().alias("readings"),
    )


def frame_summary(frames: DataFrame, vehicles: DataFrame, code_boxes: DataFrame) -> DataFrame:
    """Per media: frames, successful codes, speed range and vehicles per frame."""
    keys = ["media", "frame_no"]
    v = vehicles.groupBy(*keys).agg(_n().alias("vehicles"))
    c = code_boxes.groupBy(*keys).agg(F.count_if("extraction_success").alias("codes"))
    per_frame = frames.join(v, keys, "left").join(c, keys, "left")
    speed = F.when(F.col("speed") != 0, F.col("speed"))
    count = F.coalesce("vehicles", F.lit(0))
    return per_frame.groupBy("media").agg(
        _n().alias("frames"), F.sum(F.coalesce("codes", F.lit(0))).alias("codes"),
        F.round(F.avg(speed), 6).alias("avg_speed"), F.max(speed).alias("max_speed"), F.min(speed).alias("min_speed"),
        F.round(F.avg(count), 6).alias("avg_vehicles"), F.max(count).alias("max_vehicles"),
    )


def image_statistics(images: DataFrame) -> DataFrame:
    """Counts of a still from its nested metadata."""
    boxes, codes = F.coalesce("yolo_plate_detections", F.array()), F.coalesce("license_plates", F.array())
    return images.select(
        "path",
        F.coalesce(F.size("vehicles"), F.lit(0)).alias("vehicles_detected"),
        F.size(codes).alias("plates_detected"),
        F.size(boxes).alias("yolo_plates_detected"),
        F.size(F.filter(boxes, lambda b: b["recognized_text"].isNotNull() & (b["recognized_text"] != ""))).alias("yolo_plates_with_ocr"),
        F.size(F.array_distinct(F.transform(codes, lambda c: c["text"]))).alias("unique_plates"),
        F.col("radar_data.speed").isNotNull().alias("has_speed_data"),
        F.coalesce(F.exists("vehicles", lambda v: v["is_primary"]), F.lit(False)).alias("primary_vehicle_detected"),
    )


def image_statistics_rows(vehicles: DataFrame, codes: DataFrame, readings: DataFrame, key: str = "image_id") -> DataFrame:
    """The same counts from flat rows: one (image, kind) union, then a single aggregate."""
    rows = (
        vehicles.select(key, F.lit("v").alias("kind"), F.lit(None).cast("string").alias("text"), "is_primary")
        .unionByName(codes.select(key, F.lit("c").alias("kind"), "text", F.lit(None).cast("boolean").alias("is_primary")))
        .unionByName(
            readings.filter("speed is not null").select(
                key, F.lit("s").alias("kind"), F.lit(None).cast("string").alias("text"),
                F.lit(None).cast("boolean").alias("is_primary"),
            )
        )
    )
    kind = F.col("kind")
    return rows.groupBy(key).agg(
        F.count_if(kind == "v").alias("vehicles_detected"),
        F.count_if(kind == "c").alias("plates_detected"),
        F.count_if((kind == "c") & (F.col("text") != "")).alias("plates_with_text"),
        F.count_distinct(F.when(kind == "c", F.col("text"))).alias("unique_plates"),
        (F.count_if(kind == "s") > 0).alias("has_speed_data"),
        F.coalesce(F.bool_or("is_primary"), F.lit(False)).alias("primary_vehicle_detected"),
    )


def outcome_counters(files: DataFrame, seconds: Column | None = None) -> DataFrame:
    """Processed, skipped, corrupted and failed files, and the rate per second of the run."""
    status = F.col("status")
    counts = files.agg(
        _n().alias("total"),
        F.count_if(status == "success").alias("processed"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status == "corrupted").alias("corrupted"),
        F.count_if(status == "error").alias("errors"),
        *([] if seconds is None else [F.sum(seconds).alias("seconds")]),
    )
    if seconds is None:
        return counts
    return counts.withColumn("rate", F.when(F.col("seconds") > 0, F.round(F.col("processed") / F.col("seconds"), 6)))


def result_summary(results: DataFrame, kinds: tuple[str, ...], key: str = "image_id") -> DataFrame:
    """Found results per image and kind, and whether there is any."""
    counts = results.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return counts.withColumn("has_detections", total > 0)


def run_totals(per_media: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Sums over all media of a run."""
    return per_media.agg(_n().alias("media"), *[F.sum(c).alias(f"total_{c}") for c in columns])


# --- processing ------------------------------------------------------------------------------


def processing_metrics(segments: DataFrame, media: DataFrame) -> DataFrame:
    """Per media: success share, processing time against media length, pace and a grade.

    ``media`` has duration and processing_seconds; a segment succeeded when it has an analysis.
    """
    counted = segments.groupBy("media").agg(
        _n().alias("total"), F.count_if(F.col("analysis").isNotNull()).alias("successful")
    )
    ratio = F.col("processing_seconds") / F.col("duration")
    # Grades by ratio of processing time to media length.
    grade = (
        F.when(ratio < 0.5, "Отлично").when(ratio < 1.0, "Хорошо").when(ratio < 2.0, "Удовлетворительно")
        .otherwise("Требует оптимизации")
    )
    return counted.join(media, "media").select(
        "media", "total", "successful", (F.col("total") - F.col("successful")).alias("failed"),
        _pct(F.col("successful"), F.col("total")).alias("success_pct"),
        F.round(ratio, 6).alias("ratio"),
        F.round(F.col("successful") / (F.col("processing_seconds") / 60), 6).alias("segments_per_minute"),
        grade.alias("grade"),
    )


def progress(segments: DataFrame, media: DataFrame) -> DataFrame:
    """Per media: finished share and covered time (end of the last minus start of the first segment)."""
    done = segments.groupBy("media").agg(
        _n().alias("completed"),
        F.round(F.max_by("end_time", "segment_index") - F.min_by("start_time", "segment_index"), 6).alias("covered"),
    )
    return media.join(done, "media", "left").select(
        "media", "total_segments", F.coalesce("completed", F.lit(0)).alias("completed"),
        _pct(F.coalesce("completed", F.lit(0)), F.col("total_segments")).alias("completed_pct"),
        F.coalesce("covered", F.lit(0.0)).alias("covered"),
    )


def sample_segments(segments: DataFrame, n: int = 3, words: int = 5) -> DataFrame:
    """First ``n`` segments of each media with content type and first keywords."""
    w = Window.partitionBy("media").orderBy("segment_index")
    rows = segments.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return rows.select(
        "media", "segment_index", "rank", F.coalesce("analysis.content_type", F.lit("N/A")).alias("content_type"),
        F.array_join(F.slice(F.coalesce("analysis.keywords", F.array().cast("array<string>")), 1, words), ", ").alias("keywords"),
    )


def best_codes(codes: DataFrame, keys: tuple[str, ...] = ("region_id",)) -> DataFrame:
    """Code with the highest confidence per group, the first one on ties."""
    best = F.struct(F.col("confidence"), -F.col("pos"))
    return codes.groupBy(*keys).agg(F.max_by(F.struct("text", "confidence", "source", "pos"), best).alias("b")).select(
        *keys, "b.*"
    )


def union_passes(passes: Mapping[str, DataFrame]) -> DataFrame:
    """Successful readings of several passes, tagged by pass, with a position that follows the pass order."""
    out = None
    for rank, (name, df) in enumerate(passes.items()):
        rows = df.filter("extraction_success").withColumn("source", F.lit(name)).withColumn("pass_no", F.lit(rank))
        out = rows if out is None else out.unionByName(rows)
    return out


def combined_confidence(detector: Column, reading: Column) -> Column:
    return (detector + reading) / 2.0


def token_confidence(tokens: DataFrame, keys: tuple[str, ...] = ("crop_id",)) -> DataFrame:
    return tokens.groupBy(*keys).agg(F.round(F.avg("confidence"), 6).alias("confidence"), _n().alias("tokens"))


def identification_rate(events: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Identified and unknown vehicles and the identified share; 0 without vehicles."""
    sums = events.groupBy(*keys).agg(
        F.sum("count").alias("vehicles"), F.sum("identified_count").alias("identified"), F.sum("unknown_count").alias("unknown")
    )
    return sums.withColumn("rate_pct", _pct(F.col("identified"), F.col("vehicles")))


def keyword_rollup(segments: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent keywords of each media: (media, keyword, n, rank)."""
    counts = segments.select("media", F.explode("keywords").alias("keyword")).groupBy("media", "keyword").agg(_n().alias("n"))
    w = Window.partitionBy("media").orderBy(F.desc("n"), "keyword")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def content_type_rollup(segments: DataFrame) -> DataFrame:
    """Most frequent content type and number of segments of each media."""
    n = segments.groupBy("media").agg(_n().alias("segments"))
    return n.join(modes_by(segments, ["media"], ["content_type"]), "media", "left")


def status_dashboard(media: DataFrame, phases: tuple[str, ...]) -> DataFrame:
    """Media per phase and status, one row per phase."""
    long = media.select(
        F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"{p}_status").alias("status")) for p in phases])).alias("s")
    ).select("s.*")
    status = F.col("status")
    return long.groupBy("phase").agg(
        *[F.count_if(status == s).alias(s) for s in ("pending", "processing", "completed")],
        F.count_if(~status.isin("pending", "processing", "completed") | status.isNull()).alias("other"),
    )


def failed_segments(segments: DataFrame) -> DataFrame:
    """Segments without success per media."""
    return segments.groupBy("media").agg(F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"), _n().alias("segments"))


def frame_context(frames: DataFrame, objects: DataFrame, entities: DataFrame, texts: DataFrame) -> DataFrame:
    """Context text of each frame time from the events of the same second.

    First 5 objects, first 3 entities and first 3 texts, in this order; null when there is
    none.  Events have one row per (media, timestamp).
    """
    # Headings of the three parts.
    parts = [
        (objects, "objects", ",", 5, "Объекты: "), (entities, "entities", ",", 3, "Люди: "), (texts, "texts", r"\|", 3, "Текст: ")
    ]
    rows = frames
    for df, column, sep, n, heading in parts:
        value = F.concat(F.lit(heading), F.array_join(F.slice(F.split(column, sep), 1, n), ", "))
        found = df.filter(F.col(column) != "").select("media", "timestamp", value.alias(f"_{column}"))
        rows = rows.join(found, ["media", "timestamp"], "left")
    named = [f"_{c}" for _, c, *_ in parts]
    context = F.concat_ws("; ", *named)
    return rows.withColumn("context", F.nullif(context, F.lit(""))).drop(*named)
