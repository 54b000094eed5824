"""Detections, entities, boxes: filters, lookups, geometry, rollups."""

from pyspark.sql import functions as F

from mediaops.functions.clock import hms_floor, hms_round, minutes_seconds
from mediaops.operators import boxes, clustering, filters, labels, rollups
from mediaops.workloads import roles as R
from mediaops.workloads.registry import query

DET = f"WITH {R.DET_SQL}"
ENT = f"WITH {R.ENT_SQL}"
MED = f"WITH {R.MEDIA_SQL}"
BOX = f"WITH {R.BOX_SQL}"
MEDIA_COLS = ["media", "path", "duration", "phase1_status", "phase2_status"]


@query("s7_table_projection", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def projection(spark, sf):
    return R.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("p1_filter_media", f"""{MED} SELECT media, path, duration, phase1_status, phase2_status FROM med
WHERE phase1_status = 'completed' AND phase2_status IN ('pending', 'processing')""")
def filter_media(spark, sf):
    spec = {"phase1_status": "completed", "phase2_status": ["pending", "processing"]}
    return filters.filter_by(R.media(spark, sf), spec).select(*MEDIA_COLS)


@query("p1_filter_media_empty_spec", f"{MED} SELECT media, path, duration, phase1_status, phase2_status FROM med")
def filter_media_all(spark, sf):
    return filters.filter_by(R.media(spark, sf), {}).select(*MEDIA_COLS)


@query("p2_lookup_media", f"{MED} SELECT media, path, duration, phase1_status, phase2_status FROM med WHERE media = 77")
def lookup_media(spark, sf):
    return filters.lookup(R.media(spark, sf), media=77).select(*MEDIA_COLS)


@query("p2_lookup_entity", f"{ENT} SELECT * FROM ent WHERE media = 8 AND entity_id = 'person_003'")
def lookup_entity(spark, sf):
    return filters.lookup(R.entities(spark, sf), media=8, entity_id="person_003")


@query("p3_media_timeline", f"{DET} SELECT * FROM det WHERE media = 8 ORDER BY t, id")
def timeline(spark, sf):
    return filters.media_timeline(R.detections(spark, sf), 8)


@query("p3_media_timeline_of_entity", f"{DET} SELECT * FROM det WHERE media = 8 AND entity_id = 'person_003' ORDER BY t, id")
def timeline_entity(spark, sf):
    return filters.media_timeline(R.detections(spark, sf), 8, "person_003")


@query("p4_entity_timeline", f"{DET} SELECT * FROM det WHERE entity_id = 'person_003' ORDER BY media, t, id")
def entity_timeline(spark, sf):
    return filters.entity_timeline(R.detections(spark, sf), "person_003")


@query("p5_cluster_detections", f"{DET} SELECT * FROM det WHERE media = 46 AND entity_id_batch = 'post_02' ORDER BY t, id")
def cluster_detections(spark, sf):
    return filters.cluster_detections(R.detections(spark, sf), 46, "postclustering", "post_02")


@query("p5_cluster_detections_unknown_kind", f"{DET} SELECT * FROM det WHERE media = 46 AND entity_id = 'person_001' ORDER BY t, id")
def cluster_detections_default(spark, sf):
    return filters.cluster_detections(R.detections(spark, sf), 46, "anything", "person_001")


@query("p6_time_range_with_names", f"""{ENT} SELECT det.*, ent.name AS entity_name FROM det LEFT JOIN ent USING (media, entity_id)
WHERE det.media = 8 AND t BETWEEN 86400 AND 1209600 ORDER BY t, id""")
def time_range(spark, sf):
    return filters.time_range(R.detections(spark, sf), R.entities(spark, sf), 8, 86400.0, 1209600.0)


@query("p7_with_label", f"{DET} SELECT id, media, entity_id_alt FROM det WHERE entity_id_alt IS NOT NULL ORDER BY id")
def with_label(spark, sf):
    return filters.with_value(R.detections(spark, sf), "entity_id_alt", ["id"]).select("id", "media", "entity_id_alt")


@query("p7_without_label", f"{DET} SELECT id, media FROM det WHERE entity_id_alt IS NULL ORDER BY id")
def without_label(spark, sf):
    return filters.without_value(R.detections(spark, sf), "entity_id_alt", ["id"]).select("id", "media")


@query("p8_usable_detections", f"""{DET} SELECT id, media, label, confidence, w, h FROM det
WHERE label IN ('click', 'view') AND confidence >= 5.0 AND w >= 60 AND h >= 60""")
def usable(spark, sf):
    return filters.usable_detections(R.detections(spark, sf), ["click", "view"], 5.0, 60).select(
        "id", "media", "label", "confidence", "w", "h"
    )


@query("p9_box_geometry", f"""WITH {R.BOX_SQL}, {R.MEDIA_SQL}
SELECT pos AS id, media, x, y, x + w AS x2, y + h AS y2,
  CAST(floor((x + x + w) / 2) AS BIGINT) AS cx, CAST(floor((y + y + h) / 2) AS BIGINT) AS cy,
  greatest(0, x - 20) AS exp_x, greatest(0, y - 10) AS exp_y,
  least(width, x + w + 20) - greatest(0, x - 20) AS exp_w, least(height, y + h + 10) - greatest(0, y - 10) AS exp_h,
  greatest(0, x - CAST(floor(w * 0.25) AS BIGINT)) AS crop_x1, greatest(0, y - CAST(floor(h * 0.25) AS BIGINT)) AS crop_y1,
  least(width, x + w + CAST(floor(w * 0.25) AS BIGINT)) AS crop_x2, least(height, y + h + CAST(floor(h * 0.25) AS BIGINT)) AS crop_y2,
  (CAST(w AS DOUBLE) / h > 2.0 AND CAST(w AS DOUBLE) / h < 6.0 AND w * h > width * height * 0.01 AND w * h < width * height * 0.3 AND y > height * 0.4) AS plate_like
FROM box JOIN med USING (media)""")
def geometry(spark, sf):
    return boxes.box_geometry(R.boxes(spark, sf).withColumn("id", F.col("pos")), R.media(spark, sf))


@query("p12_sampled_frames", f"""{MED}, fr AS (SELECT media, fps, unnest(range(CAST(floor(duration) AS BIGINT))) AS frame_no FROM med),
s AS (SELECT *, greatest(1, CAST(floor(fps / 2.0) AS BIGINT)) AS step FROM fr)
SELECT media, count(*) AS frames, round(max(frame_no / fps), 6) AS last_t FROM s
WHERE frame_no % step = 0 AND frame_no // step < 30 GROUP BY media""")
def sampled(spark, sf):
    m = R.media(spark, sf).withColumn("frame_count", F.floor("duration"))
    rows = filters.sampled_frames(filters.frames_of(m).select("media", "fps", "frame_no"), 2.0, 30)
    return rows.groupBy("media").agg(F.count(F.lit(1)).alias("frames"), F.round(F.max("t"), 6).alias("last_t"))


@query("p15_timeline_events", f"{DET} SELECT media, t, entity_id, age, gender, emotion FROM det WHERE entity_id IS NOT NULL")
def timeline_events(spark, sf):
    return filters.timeline_events(R.detections(spark, sf).filter("entity_id is not null"))


@query("p11_media_cards", f"{MED} SELECT media AS name, path, duration, width, height, fps FROM med")
def media_cards(spark, sf):
    return filters.media_cards(R.media(spark, sf))


ROLLUP = """r AS (SELECT media, {label} AS cluster_id, count(*) AS detection_count, min(t) AS first_seen, max(t) AS last_seen,
  round(avg(age), 6) AS avg_age, mode() WITHIN GROUP (ORDER BY gender) AS common_gender,
  array_to_string(list(DISTINCT id ORDER BY id), ',') AS detection_ids
  FROM det WHERE {label} IS NOT NULL GROUP BY media, {label})"""


@query("a1_cluster_rollup", f"{DET}, {ROLLUP.format(label='entity_id')} SELECT * FROM r")
def rollup(spark, sf):
    return rollups.cluster_rollup(R.detections(spark, sf), "onthefly")


@query("a1_cluster_rollup_batch_labels", f"{DET}, {ROLLUP.format(label='entity_id_batch')} SELECT * FROM r")
def rollup_batch(spark, sf):
    return rollups.cluster_rollup(R.detections(spark, sf), "postclustering")


@query("a1_cluster_members", f"{DET} SELECT DISTINCT media, entity_id_alt AS cluster_id, id FROM det WHERE entity_id_alt IS NOT NULL")
def members(spark, sf):
    return rollups.cluster_members(R.detections(spark, sf), "alt")


@query("p11_entity_cards", f"""{DET}, {ROLLUP.format(label='entity_id')} SELECT media, cluster_id, detection_count,
round_even(first_seen, 2) AS first_seen, round_even(last_seen, 2) AS last_seen, CAST(round_even(avg_age, 0) AS BIGINT) AS avg_age,
common_gender AS gender, array_to_string(string_split(detection_ids, ',')[1:5], ',') AS detection_ids FROM r""")
def entity_cards(spark, sf):
    return filters.entity_cards(rollups.cluster_rollup(R.detections(spark, sf)))


@query("j1_entities_by_media", f"""{ENT} SELECT ent.media, ent.entity_id, ent.first_seen, ent.appearances, ent.name, count(*) AS detections_in_media
FROM ent JOIN det ON det.media = ent.media AND det.entity_id = ent.entity_id GROUP BY ALL""")
def entities_by_media(spark, sf):
    return rollups.entities_by_media(R.entities(spark, sf), R.detections(spark, sf))


@query("j2_entity_statistics", f"""{ENT} SELECT ent.media, ent.entity_id, ent.name, count(det.id) AS appearances, round(avg(det.age), 6) AS avg_age,
mode() WITHIN GROUP (ORDER BY det.gender) AS common_gender, mode() WITHIN GROUP (ORDER BY det.emotion) AS common_emotion
FROM ent LEFT JOIN det ON det.media = ent.media AND det.entity_id = ent.entity_id GROUP BY ent.media, ent.entity_id, ent.name""")
def entity_statistics(spark, sf):
    return rollups.entity_statistics(R.entities(spark, sf), R.detections(spark, sf))


@query("a23_appearance_counts", f"{DET} SELECT media, entity_id, count(*) AS appearances FROM det WHERE entity_id IS NOT NULL GROUP BY ALL")
def appearances(spark, sf):
    return rollups.appearance_counts(R.detections(spark, sf))


@query("c5_entity_table", """SELECT label AS media, CAST(label AS VARCHAR) AS entity_id, min(vec_id) AS first_seen, count(*) AS appearances,
min(vec_id) AS first_id, round(list_sum(list_transform(arg_min(embedding, vec_id), lambda x: CAST(x AS DOUBLE))), 4) AS vector_sum FROM embeddings GROUP BY label""")
def entity_table(spark, sf):
    v = R.vectors(spark, sf).withColumn("entity_id", F.col("media").cast("string")).withColumn("t", F.col("id"))
    e = clustering.entity_table(v)
    total = F.aggregate("representative", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.withColumn("vector_sum", F.round(total, 4)).drop("representative")


@query("a2_table_counts", """SELECT 'media' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'segments', count(*) FROM documents
UNION ALL SELECT 'detections', count(*) FROM events""")
def table_counts(spark, sf):
    return rollups.table_counts({n: R.table(spark, sf, t) for n, t in (("media", "orders"), ("segments", "documents"), ("detections", "events"))})


@query("w7_primary_object", f"""{BOX}, s AS (SELECT *, w * h * (1 - abs(x + w / 2.0 - 640) / 640 * 0.3) AS score FROM box)
SELECT media, max(round(score, 6)) AS score FROM s WHERE score > 0 GROUP BY media""")
def primary(spark, sf):
    best = boxes.primary_object(R.boxes(spark, sf), ["media"])
    return best.select("media", F.round("score", 6).alias("score"))


@query("a10_speed_statistics", """SELECT user_id AS media, min(value) AS min_speed, max(value) AS max_speed, round(avg(value), 6) AS avg_speed,
count(*) AS readings FROM events WHERE value IS NOT NULL AND value <> 0 GROUP BY user_id""")
def speeds(spark, sf):
    return rollups.speed_statistics(R.detections(spark, sf).withColumn("speed", F.col("confidence")), ("media",))


@query("a11_frame_summary", """WITH v AS (SELECT l_orderkey AS m, l_linenumber AS f, count(*) AS vehicles, count(*) FILTER (l_returnflag = 'R') AS codes,
  max(l_quantity) AS speed FROM lineitem GROUP BY ALL),
s AS (SELECT *, CASE WHEN speed > 20 THEN speed - 20 END AS sp FROM v)
SELECT m AS media, count(*) AS frames, sum(codes) AS codes, round(avg(sp), 6) AS avg_speed, max(sp) AS max_speed, min(sp) AS min_speed,
round(avg(vehicles), 6) AS avg_vehicles, max(vehicles) AS max_vehicles FROM s GROUP BY m""")
def frame_summary(spark, sf):
    li = R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("media"), F.col("l_linenumber").alias("frame_no"), "l_returnflag", "l_quantity")
    frames = li.groupBy("media", "frame_no").agg(F.max("l_quantity").alias("q")).select(
        "media", "frame_no", F.greatest(F.col("q") - 20, F.lit(0.0)).alias("speed")
    )
    return rollups.frame_summary(frames, li, li.withColumn("extraction_success", F.col("l_returnflag") == "R"))


@query("a12_image_statistics", """WITH r AS (SELECT l_orderkey AS image_id, 'v' AS kind, NULL AS text, l_returnflag = 'R' AS is_primary FROM lineitem
  UNION ALL SELECT o_custkey, 'c', o_orderpriority, NULL FROM orders
  UNION ALL SELECT user_id, 's', NULL, NULL FROM events WHERE value > 1)
SELECT image_id, count(*) FILTER (kind = 'v') AS vehicles_detected, count(*) FILTER (kind = 'c') AS plates_detected,
count(*) FILTER (kind = 'c' AND text <> '') AS plates_with_text, count(DISTINCT text) AS unique_plates,
count(*) FILTER (kind = 's') > 0 AS has_speed_data, coalesce(bool_or(is_primary), false) AS primary_vehicle_detected FROM r GROUP BY image_id""")
def image_statistics(spark, sf):
    vehicles = R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_returnflag") == "R").alias("is_primary"))
    codes = R.table(spark, sf, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderpriority").alias("text"))
    readings = R.table(spark, sf, "events").select(
        F.col("user_id").alias("image_id"), F.when(F.col("value") > 1, F.col("value")).alias("speed")
    )
    return rollups.image_statistics_rows(vehicles, codes, readings)


@query("a27_result_summary", f"""{DET} SELECT media AS image_id, count(*) FILTER (label = 'click') AS click, count(*) FILTER (label = 'purchase') AS purchase,
count(*) FILTER (label = 'error') AS error, count(*) FILTER (label IN ('click', 'purchase', 'error')) > 0 AS has_detections FROM det GROUP BY media""")
def result_summary(spark, sf):
    rows = R.detections(spark, sf).select(F.col("media").alias("image_id"), F.col("label").alias("kind"))
    return rollups.result_summary(rows, ("click", "purchase", "error"))


@query("a27_run_totals", f"""{DET}, p AS (SELECT media, count(*) AS detections, count(DISTINCT entity_id) AS entities FROM det GROUP BY media)
SELECT count(*) AS media, sum(detections) AS total_detections, sum(entities) AS total_entities FROM p""")
def run_totals(spark, sf):
    per_media = R.detections(spark, sf).groupBy("media").agg(
        F.count(F.lit(1)).alias("detections"), F.count_distinct("entity_id").alias("entities")
    )
    return rollups.run_totals(per_media, ("detections", "entities"))


@query("x13_clock_formats", """SELECT event_id AS id, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS floor_clock,
lpad(CAST(r // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(r % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(r % 60 AS VARCHAR), 2, '0') AS round_clock,
CASE WHEN s // 60 < 10 THEN '0' ELSE '' END || CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS short_clock
FROM (SELECT event_id, CAST(floor(value * 30) AS BIGINT) AS s, CAST(round_even(value * 30, 0) AS BIGINT) AS r FROM events)""")
def clocks(spark, sf):
    t = F.col("value") * 30
    return R.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), hms_floor(t).alias("floor_clock"), hms_round(t).alias("round_clock"),
        minutes_seconds(t).alias("short_clock"),
    )


@query("j13_vehicle_nearby", """SELECT o_orderkey AS image_id, o_orderpriority AS text,
EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS vehicle_nearby FROM orders""")
def nearby(spark, sf):
    codes = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("text"))
    vehicles = R.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image_id"))
    return labels.mark_with_vehicle(codes, vehicles)


@query("j16_payload_fallback", """SELECT doc_id AS id, coalesce(CASE WHEN quality = 1 THEN text END, CASE WHEN n_chars < 2000 THEN text END) AS payload
FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(CASE WHEN quality = 1 THEN text END, CASE WHEN n_chars < 2000 THEN text END) IS NOT NULL""")
def payload(spark, sf):
    d = R.table(spark, sf, "documents").join(R.table(spark, sf, "labels"), "doc_id", "left")
    rows = d.select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.col("text")).alias("crop_context"),
        F.when(F.col("n_chars") < 2000, F.col("text")).alias("thumbnail"),
    )
    return filters.payload(rows)


@query("j11_speed_bands", """SELECT event_id AS id, value AS speed,
CASE WHEN value <> 0 THEN round(value - 10, 6) END AS excess,
CASE WHEN value = 0 THEN 'Статья не определена' WHEN value - 10 > 60 THEN 'ст. 187 ч.4 КоАП КР' WHEN value - 10 > 40 THEN 'ст. 187 ч.3 КоАП КР'
  WHEN value - 10 > 20 THEN 'ст. 187 ч.2 КоАП КР' WHEN value - 10 > 10 THEN 'ст. 187 ч.1 КоАП КР' ELSE 'Нарушения нет' END AS article,
CASE WHEN value = 0 THEN 0 WHEN value - 10 > 60 THEN 7500 WHEN value - 10 > 40 THEN 5500 WHEN value - 10 > 20 THEN 3000 WHEN value - 10 > 10 THEN 1000 ELSE 0 END AS fine
FROM events""")
def bands(spark, sf):
    rows = labels.speed_bands(R.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("speed")))
    return rows.withColumn("excess", F.round("excess", 6)).drop("violation")


@query("j7_class_lookup", """WITH c AS (SELECT l_partkey AS class_id, l_discount * 10 AS confidence FROM lineitem)
SELECT CASE class_id WHEN 2 THEN 'car' WHEN 3 THEN 'motorcycle' WHEN 5 THEN 'bus' WHEN 7 THEN 'truck' ELSE 'unknown' END AS vehicle,
CASE WHEN class_id < 431 AND confidence > 0.3 THEN CAST(2010 + class_id % 15 AS VARCHAR) ELSE 'Unknown' END AS "year",
CASE WHEN class_id >= 431 OR confidence <= 0.3 THEN 'Unknown' WHEN class_id < 75 THEN 'Toyota' WHEN class_id < 150 THEN 'BMW' WHEN class_id < 225 THEN 'Mercedes-Benz'
  WHEN class_id < 300 THEN 'Audi' WHEN class_id < 375 THEN 'Honda' ELSE 'Ford' END AS make, count(*) AS n
FROM c GROUP BY ALL""")
def class_lookup(spark, sf):
    rows = labels.make_model(R.boxes(spark, sf)).withColumn("vehicle", labels.vehicle_class(F.col("class_id")))
    return rows.groupBy("vehicle", "year", "make").agg(F.count(F.lit(1)).alias("n"))


@query("j7_region_lookup", """SELECT s_suppkey AS id, s_nationkey, CASE lpad(CAST(s_nationkey AS VARCHAR), 2, '0')
WHEN '01' THEN 'Almaty' WHEN '02' THEN 'Almaty Region' WHEN '03' THEN 'Akmola Region' WHEN '04' THEN 'Aktobe Region' WHEN '05' THEN 'Atyrau Region'
WHEN '06' THEN 'West Kazakhstan Region' WHEN '07' THEN 'Zhambyl Region' WHEN '08' THEN 'Karaganda Region' WHEN '09' THEN 'Kostanay Region'
WHEN '10' THEN 'Kyzylorda Region' WHEN '11' THEN 'Mangystau Region' WHEN '12' THEN 'Pavlodar Region' WHEN '13' THEN 'North Kazakhstan Region'
WHEN '14' THEN 'South Kazakhstan Region' WHEN '15' THEN 'East Kazakhstan Region' WHEN '16' THEN 'Nur-Sultan' WHEN '17' THEN 'Shymkent'
ELSE 'Region ' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') END AS region FROM supplier""")
def region_lookup(spark, sf):
    from mediaops.operators.codes import KAZAKHSTAN_REGIONS

    code = F.lpad(F.col("s_nationkey").cast("string"), 2, "0")
    return R.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), "s_nationkey", labels.region_name(code, KAZAKHSTAN_REGIONS).alias("region")
    )


@query("j10_zero_shot_labels", f"""WITH {R.VEC_SQL}, lab AS (SELECT CAST(label AS BIGINT) AS label_no, 'label ' || CAST(label AS VARCHAR) AS label,
  arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS e FROM embeddings GROUP BY embeddings.label),
s AS (SELECT id, label_no, lab.label, round({R.cosine_sql('vec.embedding', 'lab.e')}, 6) AS similarity FROM vec, lab)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, label_no) = 1""")
def zero_shot(spark, sf):
    v = R.vectors(spark, sf)
    named = v.groupBy(F.col("media").alias("label_no")).agg(F.min_by("embedding", "id").alias("embedding")).withColumn(
        "label", F.concat(F.lit("label "), F.col("label_no").cast("string"))
    )
    return labels.zero_shot_labels(v, named)


@query("x14_vector_stats_label", """WITH s AS (SELECT vec_id AS id, list_avg(CAST(embedding AS DOUBLE[])) AS m, list_var_pop(CAST(embedding AS DOUBLE[])) AS v,
  list_max(embedding) AS t FROM embeddings)
SELECT id, round(m, 6) AS mean, round(v, 6) AS variance,
CASE WHEN m > 0.15 THEN CASE WHEN sqrt(v) > 0.2 THEN 'репортаж_улица' WHEN v > 0.03 THEN 'интервью' ELSE 'студия_новости' END
WHEN m > 0.05 THEN CASE WHEN t > 0.25 THEN 'графика_титры' WHEN sqrt(v) > 0.15 THEN 'завод_производство' ELSE 'офис' END
ELSE CASE WHEN v > 0.01 THEN 'природа_ландшафт' ELSE 'реклама' END END AS label FROM s""")
def stats_label(spark, sf):
    rows = labels.vector_stats_label(R.vectors(spark, sf))
    return rows.select("id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "label")


@query("x16_shape_colour_labels", f"""{BOX}, f AS (SELECT pos, class_id, confidence, CAST(w AS DOUBLE) / h AS ratio, CAST(x % 181 AS DOUBLE) AS hue,
  CAST(y % 256 AS DOUBLE) AS saturation, CAST(w % 256 AS DOUBLE) AS val FROM box)
SELECT CASE WHEN ratio > 2.5 THEN 'лимузин' WHEN ratio > 2.0 THEN 'седан' WHEN ratio > 1.8 THEN 'хетчбек' WHEN ratio > 1.5 THEN 'внедорожник' ELSE 'компактный' END AS body_class,
CASE WHEN val < 50 THEN 'черный' WHEN val > 200 AND saturation < 50 THEN 'белый' WHEN saturation < 50 THEN 'серый'
  WHEN hue <= 10 OR hue >= 170 AND hue <= 180 THEN 'красный' WHEN hue BETWEEN 35 AND 85 THEN 'зеленый' WHEN hue BETWEEN 100 AND 130 THEN 'синий'
  WHEN hue BETWEEN 15 AND 35 THEN 'желтый' ELSE 'другой' END AS colour,
CASE WHEN class_id = 3 THEN 'potential_no_helmet' END AS flag, count(*) AS n,
round(sum(CASE WHEN class_id = 3 THEN confidence * 0.7 END), 6) AS flag_confidence FROM f GROUP BY 1, 2, 3""")
def shape_colour(spark, sf):
    rows = R.boxes(spark, sf).select(
        "w", "h", "class_id", "confidence", (F.col("x") % 181).cast("double").alias("hue"),
        (F.col("y") % 256).cast("double").alias("saturation"), (F.col("w") % 256).cast("double").alias("value"),
    )
    return labels.shape_colour_labels(rows).groupBy("body_class", "colour", "flag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("flag_confidence"), 6).alias("flag_confidence")
    )


# The poses of pose_rows and the labels of each, as SQL; points are numbered from 1 here.
POSE_SQL = f"""{R.VEC_SQL}, pts AS (SELECT id, media, t, [{{'x': least(1.0, greatest(0.0, embedding[i] * 2 + 0.5)), 'y': least(1.0, greatest(0.0, embedding[i + 15] * 2 + 0.5)),
 'v': least(1.0, least(1.0, greatest(0.0, embedding[i + 31] * 2 + 0.5)) + 0.2)}} FOR i IN range(1, 34)] AS p FROM vec),
vis AS (SELECT *, [q FOR q IN p IF q.v > 0.5] AS s, p[1] AS nose, p[8] AS le, p[9] AS re, p[12] AS ls, p[13] AS rs, p[16] AS lw, p[17] AS rw FROM pts),
sums AS (SELECT *, len(s) AS points, list_sum([q.v FOR q IN s]) / len(s) AS pose_confidence, (ls.y + rs.y) / 2 AS sy, lw.v > 0.5 AS lseen, rw.v > 0.5 AS rseen,
 CAST(floor(list_min([q.x * 1280 FOR q IN s])) AS BIGINT) AS lx, CAST(floor(list_max([q.x * 1280 FOR q IN s])) AS BIGINT) AS hx,
 CAST(floor(list_min([q.y * 720 FOR q IN s])) AS BIGINT) AS ly, CAST(floor(list_max([q.y * 720 FOR q IN s])) AS BIGINT) AS hy FROM vis WHERE len(s) > 0),
pose AS (SELECT id, media, t, points, pose_confidence,
 CASE WHEN (lw.y < sy - 0.1 AND lseen) OR (rw.y < sy - 0.1 AND rseen) THEN 'presenting' WHEN (lw.y < nose.y + 0.1 AND lseen) OR (rw.y < nose.y + 0.1 AND rseen) THEN 'speaking'
  WHEN (lw.y < ls.y AND lseen) OR (rw.y < rs.y AND rseen) THEN 'gesturing' WHEN lw.y > ls.y + 0.2 AND rw.y > rs.y + 0.2 THEN 'standing' ELSE 'neutral' END AS gesture,
 CASE WHEN le.v > 0.5 AND re.v > 0.5 THEN CASE WHEN abs(le.x - re.x) < 0.05 THEN 'front' WHEN le.x - re.x > 0 THEN 'right' ELSE 'left' END ELSE 'unknown' END AS head_pose,
 CASE WHEN lw.y < ls.y AND lseen AND rw.y < rs.y AND rseen THEN 'both_raised' WHEN lw.y < ls.y AND lseen THEN 'left_raised' WHEN rw.y < rs.y AND rseen THEN 'right_raised' ELSE 'down' END AS arm_position,
 CASE WHEN ls.v > 0.5 AND rs.v > 0.5 THEN CASE WHEN abs(ls.x - rs.x) > 0.15 THEN 'angled' ELSE 'front' END ELSE 'side' END AS body_orientation,
 greatest(0, lx - 20) AS x1, greatest(0, ly - 20) AS y1, least(1280, hx + 20) AS x2, least(720, hy + 20) AS y2 FROM sums WHERE pose_confidence >= 0.5)"""


@query("x15_pose_labels", f"""WITH {POSE_SQL} SELECT id, media, gesture, head_pose, arm_position, body_orientation, x1, y1, x2, y2,
CAST(floor((x1 + x2) / 2) AS BIGINT) AS cx, CAST(floor((y1 + y2) / 2) AS BIGINT) AS cy, round(pose_confidence, 6) AS pose_confidence, points FROM pose""")
def poses(spark, sf):
    """Body points from the values of an embedding: x and y from two shifted reads, visibility from a third."""
    return pose_rows(spark, sf).select(
        "id", "media", "gesture", "head_pose", "arm_position", "body_orientation", "x1", "y1", "x2", "y2", "cx", "cy",
        F.round("pose_confidence", 6).alias("pose_confidence"), "points",
    )


def pose_rows(spark, sf):
    def share(i):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.element_at("embedding", i).cast("double") * 2 + 0.5))

    points = F.transform(
        F.sequence(F.lit(1), F.lit(33)),
        lambda i: F.struct(
            share(i).alias("x"), share(i + 15).alias("y"), F.least(F.lit(1.0), share(i + 31) + 0.2).alias("visibility")
        ),
    )
    rows = R.vectors(spark, sf).select(
        "id", "media", "t", points.alias("landmarks"), F.lit(1280).alias("width"), F.lit(720).alias("height")
    )
    return labels.pose_labels(rows)
