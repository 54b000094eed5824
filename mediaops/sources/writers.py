"""Writers: event CSV, result JSON versions, detections with ids, summaries, still metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.operators.tables import merge_results
from mediaops.plans.slices import running_sum

#: Suffix of the folder of each export.
EXPORTS = {"scenes", "objects", "entities", "timeline", "transcription", "vllm_analysis", "scene_segmentation", "vehicles"}


def export_csv(rows: DataFrame, root: str, suffix: str) -> str:
    """CSV files with header below ``root/suffix``, one folder per media; empty input is refused."""
    if rows.isEmpty():
        raise ValueError(f"no {suffix} rows to export")
    target = f"{root}/{suffix}"
    writer = rows.write.mode("overwrite").option("header", True).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.partitionBy("media") if "media" in rows.columns else writer).csv(target)
    return target


def export_scenes(scenes: DataFrame, root: str) -> str:
    """Scene rows: only the second and third column are written (and the media)."""
    kept = [c for c in scenes.columns if c != "media"][1:3]
    return export_csv(scenes.select("media", *kept), root, "scenes")


def segment_summary(segments: DataFrame) -> DataFrame:
    """Frame count, transcript flag and the first 100 characters of the transcript per segment."""
    has = F.col("transcript").isNotNull() & (F.col("transcript") != "")
    return segments.select(
        "media", "segment_index", "start_time", "end_time", "duration",
        F.greatest(F.size(F.coalesce("frames", F.array().cast("array<string>"))), F.lit(0)).alias("frame_count"),
        has.alias("has_transcript"), F.when(has, F.substring("transcript", 1, 100)).alias("transcript_preview"),
    )


def description_rows(frames: DataFrame) -> DataFrame:
    """Frame descriptions with their length."""
    return frames.select(
        "media", "timestamp", "frame_index", "description", "context_provided",
        F.length("description").alias("description_length"),
    )


def segmentation_rows(segments: DataFrame) -> DataFrame:
    """Speech and silence rows with an empty text instead of none."""
    return segments.select(
        "media", F.col("start_time").alias("start"), F.col("end_time").alias("end"), "duration", F.col("kind").alias("type"),
        "has_speech", F.coalesce("text", F.lit("")).alias("audio_text"), *[c for c in ("vllm_analysis", "mini_frame_count") if c in segments.columns],
    )


def _versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def latest_results(spark: SparkSession, root: str) -> DataFrame | None:
    """Newest complete version of a result table."""
    found = _versions(spark, root)
    return spark.read.json(f"{root}/v{found[-1]}", schema=_RESULT_ROWS) if found else None


_RESULT_ROWS = (
    "media string, segment_index int, start_time double, end_time double, duration double, transcript string, "
    "analysis string, frame_count int, success boolean, parse_error string, error string"
)


def save_results(new: DataFrame, root: str, keep: int = 2) -> str:
    """Merge new results into the newest version and write the next one.

    A version is visible only after its success marker, so a failed write leaves the version
    before it in place; that one is the backup.
    """
    spark = new.sparkSession
    old = latest_results(spark, root)
    rows = new if old is None else merge_results(old, new)
    found = _versions(spark, root)
    target = f"{root}/v{(found[-1] if found else 0) + 1}"
    rows.write.mode("overwrite").json(target)
    return target


def assign_ids(rows: DataFrame, order: Sequence[str], after: int = 0) -> DataFrame:
    """Consecutive ids after the given one, in a total order of the rows.

    Numbered per hash bucket first, so no single task sees all rows.
    """
    buckets = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.withColumn("_k", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    numbered = running_sum(placed, ["_k"], order, F.lit(1).cast("long"), "_i")
    sizes = placed.groupBy("_k").agg(F.count(F.lit(1)).alias("_s"))
    offsets = running_sum(sizes.withColumn("_g", F.lit(0)), ["_g"], ["_k"], "_s", "_upto").select(
        "_k", (F.col("_upto") - F.col("_s")).alias("_before")
    )
    # One row per bucket: as many as shuffle partitions.
    return numbered.join(F.broadcast(offsets), "_k").withColumn(
        "id", (F.col("_i") + F.col("_before") + after).cast("long")
    ).drop("_k", "_i", "_before")


def append_detections(rows: DataFrame, path: str, order: Sequence[str], casts: dict[str, str] | None = None) -> DataFrame:
    """Append detections with generated ids to a table; returns the rows with their ids."""
    spark = rows.sparkSession
    last = 0
    if _exists(spark, path):
        last = spark.read.parquet(path).agg(F.max("id")).first()[0] or 0
    for column, kind in (casts or {}).items():
        rows = rows.withColumn(column, F.col(column).cast(kind))
    out = assign_ids(rows, order, last)
    out.write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("id") > last)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def clear_table(spark: SparkSession, schema: str, path: str) -> None:
    """Replace a table by an empty one before a full rebuild."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def save_still_metadata(rows: DataFrame, path: str) -> None:
    """Metadata of stills as one table, a folder per directory."""
    rows.write.mode("append").partitionBy("dir").json(path)


