"""Per-second events, changes, alerts, run counters."""

from pyspark.sql import functions as F

from mediaops.operators import events, labels, rollups, sequences
from mediaops.workloads import roles as R
from mediaops.workloads.detecting import POSE_SQL, pose_rows
from mediaops.workloads.registry import query

DET = f"WITH {R.DET_SQL}"
SEC = f"""{DET}, sec AS (SELECT *, CAST(round_even(t / 3600, 0) AS BIGINT) AS second FROM det),
ts AS (SELECT *, CASE WHEN second // 3600 < 10 THEN '0' ELSE '' END || CAST(second // 3600 AS VARCHAR) || ':' || lpad(CAST(second % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(second % 60 AS VARCHAR), 2, '0') AS "timestamp",
  printf('%.2f', confidence) AS conf, '(' || CAST(cx AS VARCHAR) || ',' || CAST(cy AS VARCHAR) || ')' AS pt FROM sec)"""


def hourly(spark, sf):
    """Detections on a clock where an hour counts as a second, so that seconds hold several rows."""
    return R.detections(spark, sf).withColumn("t", F.col("t") / 3600)


@query("a3_object_events", f"""{SEC} SELECT media, second, "timestamp", string_agg(label, ',' ORDER BY frame_no) AS objects,
string_agg(conf, ',' ORDER BY frame_no) AS confidences, string_agg(pt, ',' ORDER BY frame_no) AS coordinates, count(*) AS "count"
FROM ts GROUP BY media, second, "timestamp" """)
def objects(spark, sf):
    return events.object_events(hourly(spark, sf))


def code_rows(spark, sf):
    return hourly(spark, sf).select(
        "media", "t", "frame_no", "pos", "confidence", "cx", "cy", F.concat(F.lit("N"), F.col("k").cast("string")).alias("plate_number"),
        F.col("label").alias("country"), F.col("emotion").alias("plate_type"), F.col("gender").alias("region"),
    )


@query("a4_code_events", f"""{SEC} SELECT media, second, "timestamp", string_agg('N' || CAST(k AS VARCHAR), ',' ORDER BY frame_no) AS plate_numbers,
string_agg(label, ',' ORDER BY frame_no) AS countries, string_agg(emotion, ',' ORDER BY frame_no) AS plate_types, string_agg(gender, ',' ORDER BY frame_no) AS regions,
string_agg(conf, ',' ORDER BY frame_no) AS confidences, string_agg(pt, ',' ORDER BY frame_no) AS coordinates, count(*) AS "count"
FROM ts GROUP BY media, second, "timestamp" """)
def codes(spark, sf):
    return events.code_events(code_rows(spark, sf))


@query("a5_vehicle_events", f"""{SEC}, ty AS (SELECT media, second, label, count(*) AS n, min(frame_no) AS f FROM ts GROUP BY ALL),
su AS (SELECT media, second, string_agg(label || ':' || CAST(n AS VARCHAR), ', ' ORDER BY f) AS vehicle_summary FROM ty GROUP BY ALL)
SELECT media, second, "timestamp", string_agg(label, ',' ORDER BY frame_no) AS vehicle_types, string_agg(conf, ',' ORDER BY frame_no) AS confidences,
string_agg(pt, ',' ORDER BY frame_no) AS coordinates, count(*) AS "count", any_value(vehicle_summary) AS vehicle_summary
FROM ts JOIN su USING (media, second) GROUP BY media, second, "timestamp" """)
def vehicles(spark, sf):
    return events.vehicle_events(hourly(spark, sf))


MAKE = """CASE WHEN k * 6 < 431 AND confidence > 0.3 THEN CASE WHEN k * 6 < 75 THEN 'Toyota' WHEN k * 6 < 150 THEN 'BMW' WHEN k * 6 < 225 THEN 'Mercedes-Benz'
  WHEN k * 6 < 300 THEN 'Audi' WHEN k * 6 < 375 THEN 'Honda' ELSE 'Ford' END ELSE 'Unknown' END"""


def make_rows(spark, sf):
    return labels.make_model(hourly(spark, sf).withColumn("class_id", F.col("k") * 6))


@query("a6_make_events", f"""{SEC}, mk AS (SELECT *, {MAKE} AS make FROM ts)
SELECT media, second, "timestamp", string_agg(make, ',' ORDER BY frame_no) AS makes, count(*) AS "count",
count(*) FILTER (make <> 'Unknown') AS identified_count, count(*) FILTER (make = 'Unknown') AS unknown_count, string_agg(conf, ',' ORDER BY frame_no) AS confidences
FROM mk GROUP BY media, second, "timestamp" """)
def makes(spark, sf):
    return events.make_events(make_rows(spark, sf)).drop("models", "years", "coordinates")


@query("a7_entity_events", f"""{SEC} SELECT media, second, "timestamp", string_agg(entity_id, ',' ORDER BY frame_no) AS entities,
string_agg(pt, ',' ORDER BY frame_no) AS coordinates, string_agg(conf, ',' ORDER BY frame_no) AS confidences, string_agg(CAST(age AS VARCHAR), ',' ORDER BY frame_no) AS ages,
string_agg(gender, ',' ORDER BY frame_no) AS genders, string_agg(emotion, ',' ORDER BY frame_no) AS emotions, count(*) AS "count"
FROM ts WHERE entity_id IS NOT NULL GROUP BY media, second, "timestamp" """)
def entities(spark, sf):
    return events.entity_events(hourly(spark, sf).filter("entity_id is not null"))


@query("a8_pose_events", f"""WITH {POSE_SQL}, sec AS (SELECT *, CAST(round_even(id / 20, 0) AS BIGINT) AS second, printf('%.2f', pose_confidence) AS conf,
 '(' || CAST(CAST(floor((x1 + x2) / 2) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor((y1 + y2) / 2) AS BIGINT) AS VARCHAR) || ')' AS pt FROM pose)
SELECT media, second, lpad(CAST(second // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(second % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(second % 60 AS VARCHAR), 2, '0') AS "timestamp",
string_agg(gesture, ',' ORDER BY id) AS gestures, string_agg(conf, ',' ORDER BY id) AS confidences, string_agg(pt, ',' ORDER BY id) AS coordinates,
string_agg(head_pose, ',' ORDER BY id) AS head_poses, string_agg(arm_position, ',' ORDER BY id) AS arm_positions, string_agg(body_orientation, ',' ORDER BY id) AS body_orientations,
count(*) AS person_count FROM sec GROUP BY media, second""")
def poses(spark, sf):
    rows = pose_rows(spark, sf).select(
        "media", (F.col("id") / 20).alias("t"), F.col("id").alias("frame_no"), F.lit(0).alias("pos"), "gesture",
        F.col("pose_confidence").alias("confidence"), "cx", "cy", "head_pose", "arm_position", "body_orientation",
    )
    return events.pose_events(rows)


@query("a9_category_counts", f"{DET} SELECT label AS value, count(*) AS n FROM det GROUP BY label")
def categories(spark, sf):
    return events.category_counts(events.object_events(hourly(spark, sf)), "objects")


@query("a9_category_counts_top", f"{DET} SELECT label AS value, count(*) AS n FROM det GROUP BY label ORDER BY n DESC, value LIMIT 3")
def categories_top(spark, sf):
    return events.category_counts(events.object_events(hourly(spark, sf)), "objects", 3)


@query("e4_distinct_values", f"{DET} SELECT DISTINCT emotion AS value FROM det")
def distinct(spark, sf):
    return events.distinct_values(events.code_events(code_rows(spark, sf)), "plate_types")


@query("a21_identification_rate", f"""{DET}, mk AS (SELECT *, {MAKE} AS make FROM det)
SELECT media, count(*) AS vehicles, count(*) FILTER (make <> 'Unknown') AS identified, count(*) FILTER (make = 'Unknown') AS unknown,
round(100.0 * count(*) FILTER (make <> 'Unknown') / count(*), 6) AS rate_pct FROM mk GROUP BY media""")
def rate(spark, sf):
    return rollups.identification_rate(events.make_events(make_rows(spark, sf)), ("media",))


@query("w4_label_changes", f"""{DET}, p AS (SELECT media, frame_no, label, t, lag(label) OVER (PARTITION BY media ORDER BY frame_no) AS previous_label FROM det)
SELECT media, frame_no, label, t, previous_label, previous_label IS NOT NULL AS change_detected FROM p WHERE previous_label IS NULL OR previous_label <> label""")
def changes(spark, sf):
    return events.label_changes(R.detections(spark, sf), keep=("t",))


@query("w5_change_similarity", f"""WITH {R.VEC_SQL}, p AS (SELECT media, id AS frame_no, confidence AS label, embedding, lag(confidence) OVER (PARTITION BY media % 3 ORDER BY id) AS previous_label, media % 3 AS g
  FROM (SELECT id, media, CASE WHEN id % 7 < 3 THEN 'high' WHEN id % 7 < 5 THEN 'medium' ELSE 'low' END AS confidence, embedding FROM vec)),
c AS (SELECT * FROM p WHERE previous_label IS NULL OR previous_label <> label),
s AS (SELECT *, lag(embedding) OVER (PARTITION BY g ORDER BY frame_no) AS pe FROM c)
SELECT g AS media, frame_no, label, previous_label, previous_label IS NOT NULL AS change_detected,
CASE WHEN previous_label IS NULL THEN 1.0 ELSE round({R.cosine_sql('embedding', 'pe')}, 6) END AS similarity FROM s""")
def change_similarity(spark, sf):
    seven = F.col("id") % 7
    v = R.vectors(spark, sf).select(
        (F.col("media") % 3).alias("media"), F.col("id").alias("frame_no"),
        F.when(seven < 3, "high").when(seven < 5, "medium").otherwise("low").alias("label"), "embedding",
    )
    return events.change_similarity(v)


ALERT_SQL = f"""WITH RECURSIVE {R.DET_SQL}, s AS (SELECT media, row_number() OVER (PARTITION BY media ORDER BY frame_no) - 1 AS i, (k % 5 = 0) AS bad FROM det),
w(media, i, before, after) AS (
  SELECT media, i, 0, CAST(bad AS INTEGER) FROM s WHERE i = 0
  UNION ALL
  SELECT s.media, s.i, w.after, CASE WHEN (s.i + 1) % 40 <> 0 AND w.after >= 3 THEN 0 ELSE w.after END + CAST(s.bad AS INTEGER)
  FROM w JOIN s ON s.media = w.media AND s.i = w.i + 1)
SELECT media, i AS segment_index, CASE WHEN (i + 1) % 40 = 0 THEN 'interval' ELSE 'degraded' END AS reason FROM w
WHERE (i + 1) % 40 = 0 OR before >= 3"""


@query("w11_restart_alerts", ALERT_SQL)
def alerts(spark, sf):
    from mediaops.plans.slices import running_sum

    rows = running_sum(R.detections(spark, sf), ["media"], ["frame_no"], F.lit(1), "n").select(
        "media", (F.col("n") - 1).cast("long").alias("segment_index"), (F.col("k") % 5 == 0).alias("degraded")
    )
    return events.restart_alerts(rows)


@query("a13_outcome_counters", """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS processed, count(*) FILTER (o_orderstatus = 'O') AS skipped,
count(*) FILTER (o_orderstatus = 'P') AS corrupted, 0 AS errors, round(sum(o_totalprice), 2) AS seconds, round(count(*) FILTER (o_orderstatus = 'F') / sum(o_totalprice), 6) AS rate FROM orders""")
def outcomes(spark, sf):
    s = F.col("o_orderstatus")
    rows = R.table(spark, sf, "orders").withColumn(
        "status", F.when(s == "F", "success").when(s == "O", "skipped").when(s == "P", "corrupted").otherwise("error")
    )
    return rollups.outcome_counters(rows, F.col("o_totalprice")).withColumn("seconds", F.round("seconds", 2))


@query("j3_frame_context", f"""{SEC}, o AS (SELECT media, "timestamp", list(label ORDER BY frame_no) AS l FROM ts GROUP BY ALL),
e AS (SELECT media, "timestamp", list(entity_id ORDER BY frame_no) AS l FROM ts WHERE entity_id IS NOT NULL GROUP BY ALL)
SELECT f.media, f.frame_no, f."timestamp", nullif(concat_ws('; ', 'Объекты: ' || array_to_string(o.l[1:5], ', '), 'Люди: ' || array_to_string(e.l[1:3], ', '),
  CASE WHEN t.text <> '' THEN 'Текст: ' || t.text END), '') AS context
FROM ts f LEFT JOIN o USING (media, "timestamp") LEFT JOIN e USING (media, "timestamp")
LEFT JOIN (SELECT media, "timestamp", array_to_string((list(emotion ORDER BY frame_no))[1:3], ', ') AS text FROM ts WHERE gender = 'Man' GROUP BY ALL) t USING (media, "timestamp")""")
def context(spark, sf):
    rows = hourly(spark, sf)
    frames = events.with_second(rows).select("media", "frame_no", "timestamp")
    texts = events.list_events(events.with_second(rows).filter("gender = 'Man'"), events.KEYS, events.ORDER, {"texts": F.col("emotion")})
    texts = texts.withColumn("texts", F.replace("texts", F.lit(","), F.lit("|")))
    return rollups.frame_context(
        frames, events.object_events(rows), events.entity_events(rows.filter("entity_id is not null")), texts
    )


# --- stills: events as files of a folder per user --------------------------------------------------

STILL_SQL = f"""{DET}, fl AS (SELECT id, 'cam' || CAST(media % 3 AS VARCHAR) AS dir, make_timestamp(CAST(epoch_us(ts) AS BIGINT) - CAST(epoch_us(ts) % 1000 AS BIGINT)) AS at, k, value
  FROM det JOIN events ON event_id = id)"""


def stills(spark, sf):
    """Files named by a clock that runs 5000 times as fast, so that neighbours are within half a second."""
    e = R.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    fast = F.timestamp_micros(F.lit(R.EPOCH_US) + F.floor((us - R.EPOCH_US) / F.lit(1_000_000)) * 1000)
    name = F.concat(
        F.date_format(fast, "yyyyMMddHHmmssSSS"), F.lit("-"), (F.col("k") % 4 + 1).cast("string"), F.lit(".jpg")
    )
    return e.select(
        F.concat(F.lit("cam"), (F.col("user_id") % 3).cast("string")).alias("dir"), name.alias("name"), "event_id", "k", "value"
    )


@query("x6_file_name_clock", f"""SELECT event_id, dir, name, make_timestamp(m) AS taken_at, k % 4 + 1 AS frame_no FROM (
  SELECT event_id, 'cam' || CAST(user_id % 3 AS VARCHAR) AS dir, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    {R.EPOCH_US} + (epoch_us(ts) - {R.EPOCH_US}) // 1000000 * 1000 AS m,
    strftime(make_timestamp({R.EPOCH_US} + (epoch_us(ts) - {R.EPOCH_US}) // 1000000 * 1000), '%Y%m%d%H%M%S%g') || '-' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 + 1 AS VARCHAR) || '.jpg' AS name FROM events)""")
def name_clock(spark, sf):
    return sequences.parse_file_names(stills(spark, sf)).select("event_id", "dir", "name", "taken_at", "frame_no")


def unique_stills(spark, sf):
    return sequences.parse_file_names(stills(spark, sf)).groupBy("dir", "name").agg(
        F.first("taken_at").alias("taken_at"), F.first("frame_no").alias("frame_no"),
        F.max("k").alias("k"), F.max("value").alias("value"),
    )


FILES_SQL = f"""f AS (SELECT DISTINCT 'cam' || CAST(user_id % 3 AS VARCHAR) AS dir, (epoch_us(ts) - {R.EPOCH_US}) // 1000000 AS ms,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 + 1 AS frame_no FROM events)"""


# Each row takes the first open sequence with the frame before; runs are apart by pauses, so recursion is as deep as a run.
SEQUENCE_SQL = f"""{FILES_SQL},
q AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 500 THEN 0 ELSE 1 END AS b FROM f WINDOW w AS (PARTITION BY dir ORDER BY ms, frame_no)),
r AS (SELECT *, sum(b) OVER (PARTITION BY dir ORDER BY ms, frame_no) AS run FROM q),
i AS (SELECT dir, run, ms, frame_no, row_number() OVER (PARTITION BY dir, run ORDER BY ms, frame_no) AS i,
  strftime(make_timestamp({R.EPOCH_US} + ms * 1000), '%Y%m%d%H%M%S%g') || '-' || CAST(frame_no AS VARCHAR) || '.jpg' AS name FROM r),
walk AS (
  SELECT dir, run, i, ms, frame_no, name, name AS sequence_id, 1 AS pos, [{{'f': frame_no, 'at': ms, 'id': name, 'n': 1}}] AS opened FROM i WHERE i = 1
  UNION ALL
  SELECT dir, run, i, ms, frame_no, name, CASE WHEN hit IS NULL THEN name ELSE opened[hit].id END, CASE WHEN hit IS NULL THEN 1 ELSE opened[hit].n + 1 END,
    CASE WHEN hit IS NULL THEN list_append(opened, {{'f': frame_no, 'at': ms, 'id': name, 'n': 1}})
      ELSE list_concat(opened[1 : hit - 1], [{{'f': frame_no, 'at': ms, 'id': opened[hit].id, 'n': opened[hit].n + 1}}], opened[hit + 1 :]) END
  FROM (SELECT i.*, walk.opened, nullif(list_position(list_transform(walk.opened, lambda s: i.frame_no > 1 AND s.f = i.frame_no - 1 AND i.ms - s.at <= 500), true), 0) AS hit
    FROM walk JOIN i ON i.dir = walk.dir AND i.run = walk.run AND i.i = walk.i + 1)),
s AS (SELECT dir, name, make_timestamp({R.EPOCH_US} + ms * 1000) AS taken_at, frame_no, sequence_id, pos FROM walk)"""


@query("w8_sequences", f"WITH RECURSIVE {SEQUENCE_SQL} SELECT * FROM s")
def build(spark, sf):
    return sequences.build_sequences(unique_stills(spark, sf).select("dir", "name", "taken_at", "frame_no"))


@query("w8_sequences_in_slices", f"WITH RECURSIVE {SEQUENCE_SQL} SELECT * FROM s")
def build_sliced(spark, sf):
    """The same with directories cut into slices, a quarter of their stills each."""
    stills = unique_stills(spark, sf).select("dir", "name", "taken_at", "frame_no")
    return sequences.build_sequences(stills, max_rows=max(1, stills.count() // 12))


@query("w8_simple_sequences", f"""WITH {FILES_SQL},
p AS (SELECT *, lag(ms) OVER w AS pm, lag(frame_no) OVER w AS pf FROM f WINDOW w AS (PARTITION BY dir ORDER BY ms, frame_no)),
n AS (SELECT *, sum(CASE WHEN frame_no > 1 AND frame_no = pf + 1 AND ms - pm <= 500 THEN 0 ELSE 1 END) OVER (PARTITION BY dir ORDER BY ms, frame_no) AS sequence_no FROM p)
SELECT dir, sequence_no, count(*) AS files, min(frame_no) AS first_frame FROM n GROUP BY ALL""")
def simple(spark, sf):
    rows = sequences.simple_sequences(unique_stills(spark, sf).select("dir", "name", "taken_at", "frame_no"))
    return rows.groupBy("dir", "sequence_no").agg(F.count(F.lit(1)).alias("files"), F.min("frame_no").alias("first_frame"))


@query("w6_best_frames", """WITH fr AS (SELECT l_orderkey AS g, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS pos,
  CASE WHEN l_returnflag <> 'N' THEN (CASE l_linestatus WHEN 'O' THEN 100.0 ELSE 0.0 END) + 10.0 * (CASE WHEN l_tax > 0.02 THEN l_discount ELSE 0.0 END) END AS score FROM lineitem)
SELECT g AS sequence_id, count(*) AS frames, round(max(score), 6) AS score, arg_max(pos, (coalesce(score, -1.0), -pos)) AS best_pos FROM fr GROUP BY g""")
def best(spark, sf):
    li = R.table(spark, sf, "lineitem").select(
        F.lit("all").alias("dir"), F.col("l_orderkey").alias("sequence_id"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"),
        "l_returnflag", "l_linestatus", "l_discount", "l_tax",
    ).withColumn("name", F.concat_ws("-", "sequence_id", "pos"))
    frames = li.select(
        "dir", "sequence_id", "pos", "name",
        F.when(F.col("l_returnflag") != "N", F.when(F.col("l_linestatus") == "O", "success").otherwise("error")).alias("status"),
    )
    found = li.select(
        "dir", "name", F.col("l_discount").alias("confidence"), F.when(F.col("l_tax") > 0.02, "text").alias("text")
    )
    out = sequences.best_frames(frames, found)
    return out.select(
        "sequence_id", "frames", F.round("score", 6).alias("score"), F.split("best_name", "-")[1].cast("long").alias("best_pos")
    )


@query("j6_files_to_process", """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def incremental(spark, sf):
    files = R.table(spark, sf, "documents").select("doc_id", "source")
    done = R.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "success").otherwise("error").alias("status"))
    return sequences.to_process(files, done, keys=("doc_id",))
