"""Segments, frames in segments, speech packing, processing state of segments."""

from pyspark.sql import functions as F

from mediaops.operators import filters, rollups, segments, tables, transcripts
from mediaops.sources import writers
from mediaops.workloads import roles as R
from mediaops.workloads.registry import query

MED = f"WITH {R.MEDIA_SQL}"
W1_SQL = """w AS (SELECT media, duration, segment_index, segment_index * 35.0 AS start_time, least(segment_index * 35.0 + 50, duration) AS end_time
  FROM (SELECT media, duration, unnest(range(CAST(ceil(duration / 35) AS BIGINT))) AS segment_index FROM med))"""


def windows(spark, sf):
    return segments.overlapping_segments(R.media(spark, sf)).select("media", "segment_index", "start_time", "end_time", "segment_duration")


@query("w1_overlapping_segments", f"""{MED}, {W1_SQL} SELECT media, segment_index, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time,
round(end_time - start_time, 6) AS segment_duration FROM w""")
def overlapping(spark, sf):
    return windows(spark, sf).select(
        "media", "segment_index", *[F.round(c, 6).alias(c) for c in ("start_time", "end_time", "segment_duration")]
    )


@query("j4_frames_in_segments", f"""WITH {R.MEDIA_SQL}, {W1_SQL}, {R.BOX_SQL}, f AS (SELECT media, pos, CAST(round_even(t, 0) AS BIGINT) AS sec FROM box)
SELECT f.media, segment_index, count(*) AS frames, min(sec) AS first_sec, max(sec) AS last_sec
FROM f JOIN w ON f.media = w.media AND sec BETWEEN start_time AND end_time GROUP BY ALL""")
def frames(spark, sf):
    rows = segments.frames_in_segments(R.boxes(spark, sf).select("media", "pos", "t"), windows(spark, sf))
    return rows.groupBy("media", "segment_index").agg(
        F.count(F.lit(1)).alias("frames"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec")
    )


@query("w2_previous_context", f"""WITH {R.SEG_SQL} SELECT a.media, a.segment_index, coalesce(b.description, '') AS context
FROM seg a LEFT JOIN seg b ON b.media = a.media AND b.segment_index = a.segment_index - 1 AND b.success""")
def previous(spark, sf):
    rows = R.segments(spark, sf)
    return segments.previous_context(rows.select("media", "segment_index", "description", "success")).select(
        "media", "segment_index", "context"
    )


@query("w3_clean_repetitive", r"""WITH d AS (SELECT conv_id AS media, turn AS pos, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations),
w AS (SELECT *, string_split_regex(t, '\s+') AS words FROM d WHERE t <> ''),
r AS (SELECT *, list_max(map_values(list_histogram(words))) AS top FROM w),
k AS (SELECT * FROM r WHERE NOT (len(words) > 5 AND CAST(top AS DOUBLE) / len(words) > 0.7)),
p AS (SELECT *, lag(t) OVER (PARTITION BY media ORDER BY pos) AS prev FROM k)
SELECT media, pos, t AS text FROM p WHERE prev IS NULL OR prev <> t""")
def clean(spark, sf):
    u = R.table(spark, sf, "conversations").select(F.col("conv_id").alias("media"), F.col("turn").alias("pos"), "text")
    return segments.clean_repetitive(u).withColumn("text", segments.strip_text(F.col("text")))


@query("w3_clean_repetitive_documents", r"""WITH d AS (SELECT lang AS media, doc_id AS pos, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
w AS (SELECT *, string_split_regex(t, '\s+') AS words FROM d WHERE t <> ''),
r AS (SELECT *, list_max(map_values(list_histogram(words))) AS top FROM w),
k AS (SELECT * FROM r WHERE NOT (len(words) > 5 AND CAST(top AS DOUBLE) / len(words) > 0.7)),
p AS (SELECT *, lag(t) OVER (PARTITION BY media ORDER BY pos) AS prev FROM k)
SELECT media, pos FROM p WHERE prev IS NULL OR prev <> t""")
def clean_documents(spark, sf):
    u = R.table(spark, sf, "documents").select(F.col("lang").alias("media"), F.col("doc_id").alias("pos"), "text")
    return segments.clean_repetitive(u).select("media", "pos")


CHUNK_SQL = f"""WITH RECURSIVE {R.UTT_SQL}, n AS (SELECT media, pos, length(text) AS size FROM utt),
w(media, pos, chunk, used) AS (
  SELECT media, pos, 0, size FROM n WHERE pos = 0
  UNION ALL
  SELECT n.media, n.pos, CASE WHEN w.used + n.size > 1500 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.used + n.size > 1500 THEN n.size ELSE w.used + n.size END
  FROM w JOIN n ON n.media = w.media AND n.pos = w.pos + 1)"""


@query("w10_character_chunks", f"{CHUNK_SQL} SELECT media, pos, chunk FROM w")
def chunks(spark, sf):
    return segments.character_chunks(R.utterances(spark, sf), limit=1500).select("media", "pos", "chunk")


SPEECH_SQL = f"""WITH RECURSIVE {R.UTT_SQL}, p AS (SELECT *, lag("end") OVER (PARTITION BY media ORDER BY "start", pos) AS pe FROM utt),
v AS (SELECT *, CASE WHEN pe IS NULL THEN CASE WHEN "start" <= 40 THEN 0.0 ELSE "start" END ELSE greatest(pe, "start") END AS enter FROM p),
w(media, pos, chunk, s, left_s, opens, "start", "end", pe, text) AS (
  SELECT media, pos, 0, enter, CAST(NULL AS DOUBLE), true, "start", "end", pe, text FROM v WHERE pos = 0
  UNION ALL
  SELECT v.media, v.pos, CASE WHEN v."end" - w.s > 40 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN v."end" - w.s > 40 THEN v.enter ELSE w.s END,
    w.s, v."end" - w.s > 40, v."start", v."end", v.pe, v.text
  FROM w JOIN v ON v.media = w.media AND v.pos = w.pos + 1),
o AS (SELECT *, opens AND pos > 0 AND "start" - pe > 3 AND "start" - left_s <= 40 AS taken FROM w),
sp AS (SELECT media, chunk, any_value(s) AS start_time, max("end") AS last_end, string_agg(text, ' ' ORDER BY pos) AS text FROM o GROUP BY ALL),
ab AS (SELECT media, chunk - 1 AS chunk, "start" AS longer FROM o WHERE taken),
speech AS (SELECT media, start_time, coalesce(longer, last_end) AS end_time, 'speech' AS kind, text FROM sp LEFT JOIN ab USING (media, chunk)),
gaps AS (SELECT media, CASE WHEN taken THEN "start" ELSE pe END AS g0, "start" AS g1, 30.0 AS hop FROM o WHERE opens AND pos > 0
  UNION ALL SELECT media, 0.0, "start", 35.0 FROM o WHERE pos = 0 AND "start" > 40),
sil AS (SELECT media, g0 + i * hop AS start_time, least(g0 + i * hop + 40, g1) AS end_time FROM
  (SELECT *, unnest(range(CASE WHEN g1 - g0 > 40 THEN CAST(ceil((g1 - g0 - 40) / hop) + 1 AS BIGINT) ELSE 1 END)) AS i FROM gaps WHERE g1 > g0)),
dur AS (SELECT media, max("end") AS last_end, max("end") + 7 + media % 3 AS duration FROM o GROUP BY media)"""


@query("w9_speech_segments", f"""{SPEECH_SQL} SELECT media, round(start_time, 4) AS start_time, round(end_time, 4) AS end_time, kind, text,
round(end_time - start_time, 4) AS duration, kind = 'speech' AS has_speech FROM (
  SELECT * FROM speech UNION ALL SELECT media, start_time, end_time, 'silence', NULL FROM sil
  UNION ALL SELECT media, last_end, duration, 'silence', NULL FROM dur WHERE last_end < duration)""")
def speech(spark, sf):
    rows = speech_rows(spark, sf)
    return rows.select("media", "kind", "text", "has_speech", *[F.round(c, 4).alias(c) for c in ("start_time", "end_time", "duration")])


def speech_rows(spark, sf):
    u = R.utterances(spark, sf).select("media", "pos", "start", "end", "text")
    m = u.groupBy("media").agg((F.max("end") + 7 + F.col("media") % 3).alias("duration"))
    return segments.speech_segments(u, m)


@query("s13_segmentation_rows", f"""{SPEECH_SQL} SELECT media, round(start_time, 4) AS "start", kind AS type, coalesce(text, '') AS audio_text FROM (
  SELECT * FROM speech UNION ALL SELECT media, start_time, end_time, 'silence', NULL FROM sil
  UNION ALL SELECT media, last_end, duration, 'silence', NULL FROM dur WHERE last_end < duration)""")
def segmentation(spark, sf):
    rows = writers.segmentation_rows(speech_rows(spark, sf))
    return rows.select("media", F.round("start", 4).alias("start"), "type", "audio_text")


@query("p14_segment_timeline", f"""WITH {R.SEG_SQL} SELECT media, segment_index, start_time, end_time,
regexp_replace(description, '(the|que)', '<b>\\1</b>', 'gi') AS marked FROM seg WHERE media = 'src1' AND start_time BETWEEN 1000 AND 20000 ORDER BY start_time""")
def segment_timeline(spark, sf):
    rows = filters.segment_timeline(R.segments(spark, sf), "src1", 1000.0, 20000.0)
    return rows.select(
        "media", "segment_index", "start_time", "end_time", filters.highlight(F.col("description"), ["the", "que"]).alias("marked")
    )


# Results of a run: a line item is the result of one segment of its order.
RES_SQL = """res AS (SELECT l_orderkey AS media, l_linenumber - 1 AS segment_index, max(l_returnflag) AS flag, max(l_linestatus) AS line,
  min(l_quantity) AS quantity FROM lineitem GROUP BY ALL)"""


def results(spark, sf):
    li = R.table(spark, sf, "lineitem")
    r = li.groupBy(F.col("l_orderkey").alias("media"), (F.col("l_linenumber") - 1).cast("long").alias("segment_index")).agg(
        F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("line"), F.min("l_quantity").alias("quantity")
    )
    return r.select(
        "media", "segment_index", "flag", "line", "quantity",
        F.when(F.col("flag") == "R", True).alias("success"),
        F.when(F.col("line") == "O", F.concat(F.lit('{"description": "'), "flag", F.lit('"}'))).alias("analysis"),
        F.when(F.col("flag") == "N", "bad json").alias("parse_error"), F.lit(None).cast("string").alias("error"),
    )


@query("j5_missing_segments", f"""WITH {R.MEDIA_SQL}, {RES_SQL}, want AS (SELECT media, unnest(range(total_segments)) AS segment_index FROM med)
SELECT media, segment_index FROM want ANTI JOIN (SELECT * FROM res WHERE flag = 'R' OR line = 'O' AND flag <> 'N') d USING (media, segment_index)""")
def missing(spark, sf):
    return tables.missing_segments(R.media(spark, sf), results(spark, sf))


@query("e3_index_difference", f"""WITH {R.MEDIA_SQL}, {RES_SQL} SELECT media, unnest(range(total_segments)) AS segment_index FROM med
EXCEPT SELECT media, segment_index FROM res""")
def difference(spark, sf):
    m = R.media(spark, sf).select("media", "total_segments")
    wanted = segments.explode_range(m, F.col("total_segments"), "segment_index").select("media", "segment_index")
    return wanted.subtract(results(spark, sf).select("media", "segment_index"))


@query("j8_merge_results", f"""WITH {RES_SQL}, old AS (SELECT media, segment_index, flag, quantity FROM res),
new AS (SELECT o_orderkey AS media, 2 AS segment_index, o_orderstatus AS flag, o_totalprice AS quantity FROM orders)
SELECT coalesce(n.media, o.media) AS media, coalesce(n.segment_index, o.segment_index) AS segment_index, CASE WHEN n.media IS NOT NULL THEN n.flag ELSE o.flag END AS flag,
CASE WHEN n.media IS NOT NULL THEN n.quantity ELSE o.quantity END AS quantity FROM old o FULL JOIN new n ON o.media = n.media AND o.segment_index = n.segment_index""")
def merge(spark, sf):
    return merged(spark, sf).select("media", "segment_index", "flag", "quantity")


def merged(spark, sf):
    old = results(spark, sf).select("media", "segment_index", "flag", "quantity")
    new = R.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("media"), F.lit(2).cast("long").alias("segment_index"), F.col("o_orderstatus").alias("flag"),
        F.col("o_totalprice").alias("quantity"),
    )
    return tables.merge_results(old, new)


@query("j8_result_totals", f"""WITH {R.MEDIA_SQL}, {RES_SQL}, k AS (SELECT media, count(*) AS processed_segments, count(*) FILTER (flag IN ('R', 'N')) AS success_segments FROM res GROUP BY media)
SELECT media, total_segments, processed_segments, success_segments, processed_segments = total_segments AND success_segments = total_segments AS analysis_complete FROM med JOIN k USING (media)""")
def totals(spark, sf):
    rows = results(spark, sf).withColumn("success", F.col("flag").isin("R", "N"))
    return tables.result_totals(rows, R.media(spark, sf))


@query("a14_processing_metrics", f"""WITH {R.MEDIA_SQL}, {RES_SQL}, k AS (SELECT media, count(*) AS total, count(*) FILTER (line = 'O') AS successful FROM res GROUP BY media),
m AS (SELECT media, duration, processing_seconds / 1500 AS ps FROM med)
SELECT media, total, successful, total - successful AS failed, round(100.0 * successful / total, 6) AS success_pct, round(ps / duration, 6) AS ratio,
round(successful / (ps / 60), 6) AS segments_per_minute,
CASE WHEN ps / duration < 0.5 THEN 'Отлично' WHEN ps / duration < 1 THEN 'Хорошо' WHEN ps / duration < 2 THEN 'Удовлетворительно' ELSE 'Требует оптимизации' END AS grade
FROM k JOIN m USING (media)""")
def metrics(spark, sf):
    m = R.media(spark, sf).withColumn("processing_seconds", F.col("processing_seconds") / 1500)
    return rollups.processing_metrics(results(spark, sf), m)


@query("a16_progress", f"""WITH {R.MEDIA_SQL}, {RES_SQL}, k AS (SELECT media, count(*) AS completed, round(max(segment_index) * 35.0 + 50 - min(segment_index) * 35.0, 6) AS covered FROM res GROUP BY media)
SELECT media, total_segments, coalesce(completed, 0) AS completed, round(100.0 * coalesce(completed, 0) / total_segments, 6) AS completed_pct, coalesce(covered, 0) AS covered
FROM med LEFT JOIN k USING (media)""")
def progress(spark, sf):
    rows = results(spark, sf).withColumn("start_time", F.col("segment_index") * 35.0).withColumn("end_time", F.col("start_time") + 50)
    return rollups.progress(rows, R.media(spark, sf))


@query("a16_sample_segments", f"""WITH {R.SEG_SQL} SELECT media, segment_index, row_number() OVER (PARTITION BY media ORDER BY segment_index) AS "rank", content_type,
array_to_string(string_split(description, ' ')[1:5], ', ') AS keywords FROM seg QUALIFY "rank" <= 3""")
def samples(spark, sf):
    rows = R.segments(spark, sf).withColumn(
        "analysis", F.struct("content_type", F.split("description", " ").alias("keywords"))
    )
    return rollups.sample_segments(rows)


@query("a17_utterance_stats", f"""WITH {R.UTT_SQL} SELECT media, count(*) AS utterances, round(max("end") - min("start"), 6) AS span, round(avg("end" - "start"), 6) AS avg_length,
round(max("end" - "start"), 6) AS max_length, round(min("end" - "start"), 6) AS min_length, count(*) FILTER ("end" - "start" > 60) AS over_minute,
count(*) FILTER ("end" - "start" > 41) AS over_limit FROM utt GROUP BY media""")
def utterance_stats(spark, sf):
    return transcripts.utterance_stats(R.utterances(spark, sf))


@query("a25_keyword_rollup", r"""WITH k AS (SELECT source AS media, unnest(string_split_regex(lower(text), '\s+')) AS keyword FROM documents),
c AS (SELECT media, keyword, count(*) AS n FROM k GROUP BY ALL)
SELECT media, keyword, n, row_number() OVER (PARTITION BY media ORDER BY n DESC, keyword) AS "rank" FROM c QUALIFY "rank" <= 10""")
def keywords(spark, sf):
    rows = R.segments(spark, sf).select("media", F.split(F.lower("description"), r"\s+").alias("keywords"))
    return rollups.keyword_rollup(rows)


@query("a25_content_type_rollup", f"""WITH {R.SEG_SQL} SELECT media, count(*) AS segments, mode() WITHIN GROUP (ORDER BY content_type) AS common_content_type FROM seg GROUP BY media""")
def content_types(spark, sf):
    return rollups.content_type_rollup(R.segments(spark, sf))


@query("a26_status_dashboard", f"""WITH {R.MEDIA_SQL}, l AS (SELECT 'phase1' AS phase, phase1_status AS s FROM med UNION ALL SELECT 'phase2', phase2_status FROM med UNION ALL SELECT 'db_load', db_load_status FROM med)
SELECT phase, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'processing') AS processing, count(*) FILTER (s = 'completed') AS completed,
count(*) FILTER (s IS NULL OR s NOT IN ('pending', 'processing', 'completed')) AS other FROM l GROUP BY phase""")
def dashboard(spark, sf):
    return rollups.status_dashboard(R.media(spark, sf), ("phase1", "phase2", "db_load"))


@query("a26_failed_segments", f"WITH {R.SEG_SQL} SELECT media, count(*) FILTER (NOT success) AS failed, count(*) AS segments FROM seg GROUP BY media")
def failed(spark, sf):
    return rollups.failed_segments(R.segments(spark, sf))


@query("s11_segment_summary", f"""WITH {R.SEG_SQL} SELECT media, segment_index, start_time, end_time, duration, len(string_split(description, chr(10))) AS frame_count,
description IS NOT NULL AND description <> '' AS has_transcript, CASE WHEN description <> '' THEN substring(description, 1, 100) END AS transcript_preview FROM seg""")
def summary(spark, sf):
    rows = R.segments(spark, sf).withColumn("transcript", F.col("description")).withColumn("frames", F.split("description", "\n"))
    return writers.segment_summary(rows)


@query("s12_description_rows", f"""WITH {R.SEG_SQL} SELECT media, CAST(segment_index AS VARCHAR) AS "timestamp", segment_index AS frame_index, description, quality IS NOT NULL AS context_provided,
length(description) AS description_length FROM seg""")
def descriptions(spark, sf):
    rows = R.segments(spark, sf).select(
        "media", F.col("segment_index").cast("string").alias("timestamp"), F.col("segment_index").alias("frame_index"),
        "description", F.col("quality").isNotNull().alias("context_provided"),
    )
    return writers.description_rows(rows)
