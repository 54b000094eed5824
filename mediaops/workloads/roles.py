"""The fixture tables in the roles of media data, for Spark and as SQL for the check.

Every role is a projection (or a distributed rollup) of a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.plans.slices import running_sum

EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- detections: events, one media per user --------------------------------------------------

DET_SQL = f"""det AS (
  SELECT event_id AS id, user_id AS media, event_id AS frame_no, 0 AS pos,
    (epoch_us(ts) - {EPOCH_US}) / 1e6 AS t, event_type AS label, value AS confidence, k,
    CASE WHEN k % 11 <> 0 THEN 'person_' || lpad(CAST(k % 7 + 1 AS VARCHAR), 3, '0') END AS entity_id,
    'post_' || lpad(CAST(k % 5 AS VARCHAR), 2, '0') AS entity_id_batch,
    CASE WHEN k % 3 <> 0 THEN 'alt_' || CAST(k % 3 AS VARCHAR) END AS entity_id_alt,
    18 + k % 60 AS age, CASE WHEN k % 2 = 0 THEN 'Man' ELSE 'Woman' END AS gender,
    CASE k % 4 WHEN 0 THEN 'neutral' WHEN 1 THEN 'happy' WHEN 2 THEN 'sad' ELSE 'angry' END AS emotion,
    (k * 13) % 1200 AS x, (k * 7) % 650 AS y, 40 + (k % 50) * 4 AS w, 20 + (k % 20) * 5 AS h,
    (k * 13) % 1200 + 20 AS cx, (k * 7) % 650 + 10 AS cy
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def detections(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    ev = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return ev.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("media"), F.col("event_id").alias("frame_no"),
        F.lit(0).alias("pos"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / F.lit(1e6)).alias("t"),
        F.col("event_type").alias("label"), F.col("value").alias("confidence"), "k",
        F.when(k % 11 != 0, F.concat(F.lit("person_"), F.lpad((k % 7 + 1).cast("string"), 3, "0"))).alias("entity_id"),
        F.concat(F.lit("post_"), F.lpad((k % 5).cast("string"), 2, "0")).alias("entity_id_batch"),
        F.when(k % 3 != 0, F.concat(F.lit("alt_"), (k % 3).cast("string"))).alias("entity_id_alt"),
        (18 + k % 60).alias("age"), F.when(k % 2 == 0, "Man").otherwise("Woman").alias("gender"),
        F.when(k % 4 == 0, "neutral").when(k % 4 == 1, "happy").when(k % 4 == 2, "sad").otherwise("angry").alias("emotion"),
        ((k * 13) % 1200).alias("x"), ((k * 7) % 650).alias("y"), (40 + (k % 50) * 4).alias("w"), (20 + (k % 20) * 5).alias("h"),
        ((k * 13) % 1200 + 20).alias("cx"), ((k * 7) % 650 + 10).alias("cy"),
    )


# --- entities: one per (media, entity) of the detections, plus one unseen entity per media ----

ENT_SQL = DET_SQL + """, ent AS (
  SELECT media, entity_id, min(t) AS first_seen, count(*) AS appearances,
    CASE WHEN entity_id < 'person_005' THEN 'name ' || entity_id END AS name
  FROM det WHERE entity_id IS NOT NULL GROUP BY media, entity_id
  UNION ALL SELECT DISTINCT media, 'person_999', 0.0, 0, NULL FROM det)"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    det = detections(spark, sf)
    seen = det.filter("entity_id is not null").groupBy("media", "entity_id").agg(
        F.min("t").alias("first_seen"), F.count(F.lit(1)).alias("appearances")
    ).withColumn("name", F.when(F.col("entity_id") < "person_005", F.concat(F.lit("name "), F.col("entity_id"))))
    unseen = det.select("media").distinct().select(
        "media", F.lit("person_999").alias("entity_id"), F.lit(0.0).alias("first_seen"),
        F.lit(0).cast("long").alias("appearances"), F.lit(None).cast("string").alias("name"),
    )
    return seen.unionByName(unseen)


# --- media: orders ----------------------------------------------------------------------------

MEDIA_SQL = """med AS (
  SELECT o_orderkey AS media, 'video/' || CAST(o_orderkey AS VARCHAR) || '.mp4' AS path, o_orderpriority AS language,
    o_totalprice / 1000 AS duration, CAST(ceil(o_totalprice / 1000 / 35) AS BIGINT) AS total_segments,
    640 + (o_custkey % 4) * 320 AS width, 480 + (o_custkey % 3) * 240 AS height, 24.0 + o_custkey % 7 AS fps,
    CASE o_orderstatus WHEN 'P' THEN 'processing' ELSE 'completed' END AS phase1_status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'completed' WHEN '2-HIGH' THEN 'processing' ELSE 'pending' END AS phase2_status,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS db_load_status,
    o_orderdate AS phase2_start_time, o_totalprice AS processing_seconds
  FROM orders)"""


def media(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("media"),
        F.concat(F.lit("video/"), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("path"),
        priority.alias("language"), (F.col("o_totalprice") / 1000).alias("duration"),
        F.ceil(F.col("o_totalprice") / 1000 / 35).alias("total_segments"),
        (640 + (F.col("o_custkey") % 4) * 320).alias("width"), (480 + (F.col("o_custkey") % 3) * 240).alias("height"),
        (24.0 + F.col("o_custkey") % 7).alias("fps"),
        F.when(status == "P", "processing").otherwise("completed").alias("phase1_status"),
        F.when(priority == "1-URGENT", "completed").when(priority == "2-HIGH", "processing").otherwise("pending").alias("phase2_status"),
        F.when(status == "F", "completed").when(status == "O", "pending").otherwise("failed").alias("db_load_status"),
        F.col("o_orderdate").cast("timestamp").alias("phase2_start_time"), F.col("o_totalprice").alias("processing_seconds"),
    )


# --- utterances: conversations, times from text lengths -----------------------------------------

UTT_SQL = """utt AS (
  SELECT conv_id AS media, turn AS pos, role, text,
    (reach_ms - dur_ms) / 1000.0 AS "start", reach_ms / 1000.0 AS "end"
  FROM (SELECT *, CAST(sum(dur_ms + gap_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS reach_ms
    FROM (SELECT *, length(text) * 60 AS dur_ms, ((conv_id * 31 + turn * 17) % 50) * 1000 AS gap_ms FROM conversations)))"""


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    dur = (F.length("text") * 60).cast("long")
    gap = ((F.col("conv_id") * 31 + F.col("turn") * 17) % 50) * 1000
    rows = running_sum(c, ["conv_id"], ["turn"], dur + gap, "reach_ms")
    return rows.select(
        F.col("conv_id").alias("media"), F.col("turn").alias("pos"), "role", "text",
        ((F.col("reach_ms") - dur) / F.lit(1000.0)).alias("start"), (F.col("reach_ms") / F.lit(1000.0)).alias("end"),
    )


# --- segments: documents, one media per source ----------------------------------------------------

SEG_SQL = """seg AS (
  SELECT source AS media, doc_id AS segment_index, CAST(doc_id AS DOUBLE) * 35 AS start_time,
    CAST(doc_id AS DOUBLE) * 35 + 50 AS end_time, CAST(50 AS DOUBLE) AS duration, text AS description, lang AS content_type,
    n_chars, quality, coalesce(quality = 1, false) AS success
  FROM documents LEFT JOIN labels USING (doc_id))"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    start = F.col("doc_id").cast("double") * 35
    return d.select(
        F.col("source").alias("media"), F.col("doc_id").alias("segment_index"), start.alias("start_time"),
        (start + 50).alias("end_time"), F.lit(50.0).alias("duration"), F.col("text").alias("description"),
        F.col("lang").alias("content_type"), "n_chars", "quality",
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("success"),
    )


# --- stored segment vectors: embeddings ---------------------------------------------------------------

VEC_SQL = """vec AS (
  SELECT e.vec_id AS id, CAST(e.label AS BIGINT) AS media, e.vec_id AS segment_index, CAST(e.vec_id AS DOUBLE) AS t,
    CASE e.label % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
    CAST(e.embedding AS DOUBLE[]) AS embedding, CAST(n.embedding AS DOUBLE[]) AS search_terms_embedding
  FROM embeddings e LEFT JOIN embeddings n ON n.vec_id = e.vec_id * 2 + 1)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    nxt = e.select(F.expr("(vec_id - 1) / 2").alias("_h"), F.col("embedding").alias("search_terms_embedding"))
    nxt = nxt.filter(F.col("_h") == F.floor("_h")).select(F.col("_h").cast("long").alias("vec_id"), "search_terms_embedding")
    label = F.col("label") % 3
    return e.join(nxt, "vec_id", "left").select(
        F.col("vec_id").alias("id"), F.col("label").cast("long").alias("media"), F.col("vec_id").alias("segment_index"),
        F.col("vec_id").cast("double").alias("t"),
        F.when(label == 0, "high").when(label == 1, "medium").otherwise("low").alias("confidence"),
        "embedding", "search_terms_embedding",
    )


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector with the smallest id, the query of the search examples."""
    e = table(spark, sf, "embeddings")
    return [float(x) for x in e.orderBy("vec_id").select("embedding").first()[0]]


QUERY_SQL = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)"


def cosine_sql(a: str, b: str) -> str:
    """Cosine of two DOUBLE[] in SQL, 0 when either is a zero vector, null for null."""
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0 "
        f"ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END"
    )


# --- boxes: line items, one frame per order --------------------------------------------------------------

BOX_SQL = """box AS (
  SELECT l_orderkey AS media, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS pos,
    l_partkey AS class_id, l_returnflag AS label, l_discount * 10 AS confidence,
    CAST(l_quantity AS BIGINT) * 20 AS x, l_suppkey % 500 AS y,
    CAST(floor(l_extendedprice / 500) AS BIGINT) + 1 AS w, CAST(l_quantity AS BIGINT) + 10 AS h,
    l_extendedprice / 200 AS t, l_shipdate, l_linestatus
  FROM lineitem)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("media"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.col("l_partkey").alias("class_id"), F.col("l_returnflag").alias("label"), (F.col("l_discount") * 10).alias("confidence"),
        (q * 20).alias("x"), (F.col("l_suppkey") % 500).alias("y"),
        (F.floor(F.col("l_extendedprice") / 500) + 1).alias("w"), (q + 10).alias("h"),
        (F.col("l_extendedprice") / 200).alias("t"), F.col("l_shipdate").cast("timestamp").alias("l_shipdate"), "l_linestatus",
    )
