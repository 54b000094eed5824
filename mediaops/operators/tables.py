"""Upserts, deletes and work queues as new versions of a table.

Tables are immutable parquet versions; an operator returns the next version as a DataFrame.
Joins are on keys that are unique on both sides, so no join can be skewed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, OLD, COALESCE, INCREMENT = "new", "old", "coalesce", "increment"


def last_per_key(updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key within a batch; combines before the shuffle."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert(
    base: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    rules: Mapping[str, str],
    defaults: Mapping[str, Column] | None = None,
    batch_order: Sequence[str] | None = None,
    default_rule: str = OLD,
) -> DataFrame:
    """Next version of ``base`` after inserting or updating by key.

    A matched row takes each column by its rule: ``new`` (also a null), ``coalesce`` (new
    unless null), ``old`` or ``increment`` (old + the number of updates of the key).  Unmatched
    updates are inserted with ``defaults`` for the columns they lack; the further updates of an
    inserted key count as increments.  The batch is reduced to one row per key before the join:
    the last by ``batch_order``, whose columns are not stored unless ``base`` has them; without
    it, the greatest row, so that the result does not depend on the order of arrival.
    """
    defaults = dict(defaults or {})
    rest = [c for c in updates.columns if c not in keys]
    if rest:
        last = F.max_by(F.struct(*rest), F.struct(*(batch_order or rest)))
        reduced = updates.groupBy(*keys).agg(last.alias("_r"), F.count(F.lit(1)).alias("_times")).select(*keys, "_r.*", "_times")
    else:
        reduced = updates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"))
    u = reduced.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in rest], "_times", F.lit(True).alias("_u"))
    both = base.withColumn("_b", F.lit(True)).join(u, list(keys), "full_outer")
    has_old, has_new = F.col("_b").isNotNull(), F.col("_u").isNotNull()
    out = []
    for c in base.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        old = F.col(c)
        given = c in updates.columns
        new = F.col(f"_u_{c}") if given else defaults.get(c, F.lit(None))
        rule = rules.get(c, default_rule)
        if rule == INCREMENT:
            matched = old + F.col("_times")
        elif rule == COALESCE:
            matched = F.coalesce(new, old) if given else old
        elif rule == NEW:
            matched = new
        else:
            matched = old
        inserted = F.coalesce(new, defaults[c]) if c in defaults else new
        if rule == INCREMENT:
            inserted = inserted + F.col("_times") - 1
        value = F.when(has_old & has_new, matched).when(has_old, old).otherwise(inserted)
        out.append(value.cast(base.schema[c].dataType).alias(c))
    return both.select(*out)


def upsert_media(media: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Create media rows or replace the given columns of existing ones; ``updated_at`` becomes ``now``.

    New rows get pending statuses and ``now`` as creation time.
    """
    given = [c for c in updates.columns if c != "media"]
    rules = {c: NEW for c in given} | {"updated_at": NEW}
    defaults = {c: F.lit("pending") for c in media.columns if c.endswith("_status")}
    defaults |= {"created_at": now, "updated_at": now}
    rows = updates.withColumn("updated_at", now)
    return upsert(media, rows, ["media"], rules, defaults)


def update_status(media: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Set the given non-null columns of known media; unknown media change nothing."""
    given = [c for c in changes.columns if c != "media"]
    u = changes.select("media", *[F.col(c).alias(f"_u_{c}") for c in given], F.lit(True).alias("_u"))
    rows = media.join(u, "media", "left")
    return rows.select(
        *[
            F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in given
            else F.when(F.col("_u"), now).otherwise(F.col(c)).alias(c) if c == "updated_at"
            else F.col(c)
            for c in media.columns
        ]
    )


SEGMENT_RULES = {
    c: NEW for c in
    ("description", "keywords", "confidence", "content_type", "embedding", "search_terms", "search_terms_embedding")
}


def upsert_segments(segments: DataFrame, updates: DataFrame, batch_order: Sequence[str] | None = None) -> DataFrame:
    """Segments by id: texts and vectors are replaced, times and paths keep their old values."""
    return upsert(segments, updates, ["id"], SEGMENT_RULES, batch_order=batch_order)


def upsert_entities(entities: DataFrame, updates: DataFrame) -> DataFrame:
    """Entities by (media, entity): new representative, count + 1, the rest kept; new rows start at 1."""
    rules = {"representative": NEW, "appearances": INCREMENT}
    return upsert(entities, updates, ["media", "entity_id"], rules, {"appearances": F.lit(1)})


def keyed_update(table: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Set columns from a table with the same keys; rows without a change keep their values."""
    u = changes.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in columns])
    rows = table.join(u, list(keys), "left")
    return rows.select(
        *[F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns]
    )


# The phases of a media and their count columns.
PHASE_COUNTS = {
    "phase1": ["phase1_segments_created"], "phase2": ["phase2_segments_analyzed"],
    "face": ["face_persons_count", "face_detections_count"], "db_load": ["db_segments_loaded"],
}


def _distinct_media(media_list: DataFrame) -> DataFrame:
    """The media of a list, each once, dealt to a fixed number of tasks, which hold their share of it in a join.

    The rows of a table stream past and are never sorted, so a media with many rows takes no memory.  Left to itself Spark
    sorts them, in one task per core, since ids compress well, and the memory of a task grows with the table.
    """
    count = int(media_list.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return media_list.select("media").repartition(count, "media").distinct().hint("shuffle_hash")


def delete_media(tables: Mapping[str, DataFrame], media_list: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remaining rows of each table without the listed media, and the deleted rows per table.

    ``media_list`` is one column ``media``; each media is matched as a whole, so an anti join
    on its distinct values is enough.
    """
    gone = _distinct_media(media_list)
    kept = {name: df.join(gone, "media", "left_anti") for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        part = df.groupBy("media").agg(F.count(F.lit(1)).alias("n")).join(gone, "media", "left_semi").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("deleted")
        ).select(F.lit(name).alias("table_name"), "deleted")
        counts = part if counts is None else counts.unionByName(part)
    return kept, counts


def reset_media(media: DataFrame, media_list: DataFrame, now: Column) -> DataFrame:
    """Statuses of the listed media back to pending, times and counts to null (loaded segments to 0)."""
    rows = media.join(_distinct_media(media_list).withColumn("_x", F.lit(True)), "media", "left")
    hit = F.col("_x").isNotNull()
    reset: dict[str, Column] = {"updated_at": now}
    for phase, counts in PHASE_COUNTS.items():
        reset[f"{phase}_status"] = F.lit("pending")
        reset[f"{phase}_start_time"] = F.lit(None)
        reset |= {c: F.lit(None) for c in counts}
    reset["db_segments_loaded"] = F.lit(0)
    return rows.select(
        *[
            F.when(hit, reset[c].cast(media.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in reset else F.col(c)
            for c in media.columns
        ]
    )


def delete_segments(segments: DataFrame, media: object) -> DataFrame:
    """Segments without those of one media."""
    return segments.filter(~F.col("media").eqNullSafe(F.lit(media)))


def delete_entities(
    entities: DataFrame, detections: DataFrame, gone: DataFrame, keys: Sequence[str] = ("media", "entity_id")
) -> tuple[DataFrame, DataFrame]:
    """Entities without the listed ones; detections of those lose their entity."""
    keys = list(keys)
    listed = gone.select(*keys).distinct()
    cleared = detections.join(listed.withColumn("_x", F.lit(True)), keys, "left").withColumn(
        "entity_id", F.when(F.col("_x").isNull(), F.col("entity_id"))
    ).select(*detections.columns)
    return entities.join(listed, keys, "left_anti"), cleared


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Child rows whose (non-null) reference has no parent, counted."""
    refs = child.filter(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    lost = refs.join(parent.select(*keys), list(keys), "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(F.lit(name).alias("reference"), "orphans")


def work_queue(media: DataFrame, previous: str | None, own: str, as_of: Column) -> DataFrame:
    """Media ready for a phase: the one before is completed, and this one is pending or stuck.

    Processing media wait while less than twice their length has passed since the start.
    """
    ready = F.lit(True) if previous is None else F.col(f"{previous}_status") == "completed"
    passed = as_of.cast("double") - F.col(f"{own}_start_time").cast("double")
    stuck = (F.col(f"{own}_status") == "processing") & ~(passed < F.col("duration") * 2)
    return media.filter(ready & ((F.col(f"{own}_status") == "pending") | stuck))


def forced_reindex(manifest: DataFrame) -> DataFrame:
    """Media of a manifest to be deleted and queued again."""
    return manifest.filter("force").select("media")


def reindex_forced(
    manifest: DataFrame, media: DataFrame, children: Mapping[str, DataFrame], now: Column
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Forced media of a manifest: their rows leave the tables below ``media``, their statuses begin anew.

    The media that result can be queued with ``work_queue``.
    """
    gone = forced_reindex(manifest)
    kept, _ = delete_media(children, gone)
    return reset_media(media, gone, now), kept


def merge_results(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("media", "segment_index")) -> DataFrame:
    """Results by key, new ones replacing old ones; one aggregate that combines before the shuffle."""
    rest = [c for c in old.columns if c not in keys]
    rows = old.withColumn("_p", F.lit(0)).unionByName(new.select(old.columns).withColumn("_p", F.lit(1)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_p").alias("_r")).select(*keys, "_r.*")


def result_totals(merged: DataFrame, expected: DataFrame) -> DataFrame:
    """Per media: expected, processed and successful segments, and whether the analysis is complete."""
    done = merged.groupBy("media").agg(
        F.count(F.lit(1)).alias("processed_segments"), F.count_if("success").alias("success_segments")
    )
    return expected.join(done, "media").select(
        "media", "total_segments", "processed_segments", "success_segments",
        (
            (F.col("processed_segments") == F.col("total_segments"))
            & (F.col("success_segments") == F.col("total_segments"))
        ).alias("analysis_complete"),
    )


def missing_segments(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Expected (media, segment_index) without a successful result.

    A result is successful when flagged so, or when it has an analysis and no error field.
    """
    from mediaops.operators.segments import explode_range

    ok = F.coalesce("success", F.lit(False)) | (
        F.col("analysis").isNotNull() & F.col("parse_error").isNull() & F.col("error").isNull()
    )
    wanted = explode_range(expected.select("media", "total_segments"), F.col("total_segments"), "segment_index")
    done = results.filter(ok).select("media", F.col("segment_index").cast("long").alias("segment_index"))
    return wanted.select("media", "segment_index").join(done, ["media", "segment_index"], "left_anti")
