"""Readers: stored tables, result and manifest JSON, utterance CSV, image files, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops import schema as S

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")
# First bytes (hex) of known image files, and the marks found at byte 6.
MAGIC = ["FFD8FF", "89504E47", "424D", "52494646", "474946383761", "474946383961"]
MAGIC_AT_6 = ["4A464946", "45786966"]


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A stored table, all or some of its columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options) -> DataFrame:
    """A table of a database, read in ``parts`` ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts, **options
    )
    return reader.load()


def file_stem(path):
    """File name without directory and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_results(spark: SparkSession, path: str, suffix: str = "_phase2_vllm_analysis", named: bool = False) -> DataFrame:
    """Segments of result documents (one JSON per media); media from the file name, or from the document if ``named``."""
    docs = spark.read.schema(S.RESULT_FILE).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    name = F.regexp_replace(file_stem(F.col("_metadata.file_name")), suffix + "$", "")
    if named:
        name = F.coalesce(F.nullif(F.col("video_info.video_name"), F.lit("")), name)
    return docs.select(name.alias("media"), F.explode("segments").alias("s")).select("media", "s.*")


def read_results_and_rejects(
    spark: SparkSession, path: str, suffix: str = "_phase2_vllm_analysis", named: bool = False, stream: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Segments as ``read_results`` gives them, and the documents that give none: file, reason, document.

    A document that is no JSON or does not fit the schema is a ``malformed document``, one without a list of segments has
    ``no segments``.  One broken file does not hinder the others.  Files without any content have no document and give
    no row.  With ``stream`` both are streams over the files of the folder.
    """
    reader = spark.readStream if stream else spark.read
    schema = T.StructType.fromDDL(S.RESULT_FILE) if isinstance(S.RESULT_FILE, str) else S.RESULT_FILE
    options = {"multiLine": True, "recursiveFileLookup": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    schema = T.StructType([*schema.fields, T.StructField("broken", T.StringType())])
    docs = reader.schema(schema).options(**options).json(path)
    file = F.col("_metadata.file_path")
    name = F.regexp_replace(file_stem(F.col("_metadata.file_name")), suffix + "$", "")
    if named:
        name = F.coalesce(F.nullif(F.col("video_info.video_name"), F.lit("")), name)
    reason = F.when(F.col("broken").isNotNull(), "malformed document").when(F.col("segments").isNull(), "no segments")
    rows = docs.select(file.alias("file"), name.alias("media"), reason.alias("reason"), F.col("broken").alias("document"), "segments")
    good = rows.filter("reason is null").select("media", F.explode("segments").alias("s")).select("media", "s.*")
    return good, rows.filter("reason is not null").select("file", "reason", "document")


def read_utterances(spark: SparkSession, path: str, suffix: str = "_transcription") -> DataFrame:
    """Utterances of transcript CSV files with the media of the file name."""
    rows = spark.read.schema(S.UTTERANCES).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    name = F.regexp_replace(file_stem(F.col("_metadata.file_name")), suffix + "$", "")
    return rows.select(name.alias("media"), *rows.columns)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Media of a manifest; the name defaults to the stem of the path, entries without a path are skipped."""
    return manifest_rows(spark.read.schema(S.MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).json(path))


def manifest_rows(docs: DataFrame) -> DataFrame:
    """Media rows of read manifest documents."""
    v = docs.select(F.explode("videos").alias("v")).select("v.*").filter("path is not null and path <> ''")
    return v.select(
        F.coalesce(F.nullif(F.col("name"), F.lit("")), file_stem(F.col("path"))).alias("media"),
        "path", "language", F.coalesce("force", F.lit(False)).alias("force"),
    )


def list_images(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """Image files below a folder: path, dir, name, size, header (first 12 bytes).

    Only the listing and the head of each file are kept; the suffix test ignores case.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    return files.filter(suffix.isin(*suffixes) & name.contains(".")).select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), name.alias("name"),
        F.col("length").alias("size"), F.substring("content", 1, 12).alias("header"),
    ).orderBy("dir", "name")


def check_headers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid image files, and the others as skipped rows with the reason."""
    head = F.hex("header")
    known = F.lit(False)
    for magic in MAGIC:
        known = known | head.startswith(magic)
    for magic in MAGIC_AT_6:
        known = known | F.substring(head, 13, 100).startswith(magic)
    reason = (
        F.when(F.col("size") == 0, "empty file").when(F.length("header") < 4, "file too small")
        .when(~known, "unknown header")
    )
    rows = files.withColumn("error", reason)
    valid = rows.filter("error is null").drop("error")
    return valid, rows.filter("error is not null").withColumn("status", F.lit("skipped"))


def read_still_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Stored metadata of stills."""
    rows = spark.read.schema(S.STILL_METADATA + ", dir string").json(path)
    return rows.withColumn("path", F.col("file_info.path"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of run logs with their file and, when they begin with one, their time."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("run"), F.col("value").alias("line"))
    return with_log_time(lines)


def with_log_time(lines: DataFrame) -> DataFrame:
    stamp = F.regexp_extract("line", r"^\[?(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})", 1)
    return lines.withColumn("at", F.try_to_timestamp(F.replace(stamp, F.lit("T"), F.lit(" "))))


# Texts of the start line, the end line and a finished segment.
LOG_START, LOG_END = "Phase 2: VLLM Analysis...", "Phase 2 results saved to:"
LOG_SEGMENT = r"Segment\s+(\d+)\s.*processed successfully"


def mine_run_log(lines: DataFrame) -> DataFrame:
    """Per run: last start, last end, number of finished segments, seconds between start and end."""
    number = F.regexp_extract("line", LOG_SEGMENT, 1)
    rows = lines.groupBy("run").agg(
        F.max(F.when(F.col("line").contains(LOG_START), F.col("at"))).alias("started"),
        F.max(F.when(F.col("line").contains(LOG_END), F.col("at"))).alias("ended"),
        F.count_distinct(F.when(number != "", number)).alias("segments"),
        F.count(F.lit(1)).alias("lines"),
    )
    return rows.withColumn("seconds", F.col("ended").cast("double") - F.col("started").cast("double"))
