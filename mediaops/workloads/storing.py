"""Upserts, deletes, queues, sources and sinks."""


from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.operators import rollups, tables
from mediaops.plans.staging import scratch_folder as scratch
from mediaops.sources import image_files, readers, writers
from mediaops.workloads import roles as R
from mediaops.workloads.registry import query

NOW = "1999-01-01 00:00:00"
MED = f"WITH {R.MEDIA_SQL}"


def now():
    return F.lit(NOW).cast("timestamp")


def stored_media(spark, sf):
    return R.media(spark, sf).select(
        "media", "path", "language", "duration", "phase1_status", "phase2_status",
        F.col("phase2_start_time").alias("created_at"), F.col("phase2_start_time").alias("updated_at"),
    )


@query("d1_upsert_media", f"""{MED}, u AS (SELECT l_orderkey AS media, 'new/' || CAST(l_orderkey AS VARCHAR) AS path, max(l_extendedprice) / 1000 AS duration FROM lineitem GROUP BY 1
  UNION ALL SELECT -1 - c_custkey, 'customer', c_acctbal FROM customer)
SELECT coalesce(u.media, m.media) AS media, coalesce(u.path, m.path) AS path, m.language, coalesce(u.duration, m.duration) AS duration,
coalesce(m.phase1_status, 'pending') AS phase1_status, coalesce(m.phase2_status, 'pending') AS phase2_status,
CASE WHEN m.media IS NULL THEN TIMESTAMP '{NOW}' ELSE phase2_start_time END AS created_at, CASE WHEN u.media IS NULL THEN phase2_start_time ELSE TIMESTAMP '{NOW}' END AS updated_at
FROM med m FULL JOIN u ON u.media = m.media""")
def upsert_media(spark, sf):
    li = R.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("media")).agg((F.max("l_extendedprice") / 1000).alias("duration"))
    changed = li.select("media", F.concat(F.lit("new/"), F.col("media").cast("string")).alias("path"), "duration")
    added = R.table(spark, sf, "customer").select((-1 - F.col("c_custkey")).alias("media"), F.lit("customer").alias("path"), F.col("c_acctbal").alias("duration"))
    return tables.upsert_media(stored_media(spark, sf), changed.unionByName(added), now())


@query("d2_update_status", f"""{MED}, u AS (SELECT l_orderkey AS media, CASE WHEN max(l_returnflag) = 'R' THEN 'completed' END AS s FROM lineitem GROUP BY 1)
SELECT med.media, path, language, duration, phase1_status, coalesce(s, phase2_status) AS phase2_status, phase2_start_time AS created_at,
CASE WHEN u.media IS NULL THEN phase2_start_time ELSE TIMESTAMP '{NOW}' END AS updated_at FROM med LEFT JOIN u ON u.media = med.media""")
def update_status(spark, sf):
    changes = R.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("media")).agg(
        F.when(F.max("l_returnflag") == "R", "completed").alias("phase2_status")
    )
    return tables.update_status(stored_media(spark, sf), changes, now())


@query("d3_upsert_segments", """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_shipdate) AS start_time, min(l_quantity) AS duration, min(l_returnflag) AS description FROM lineitem GROUP BY 1),
u AS (SELECT o_orderkey * 10 + 3 AS id, o_orderdate AS start_time, o_totalprice AS duration, o_orderpriority AS description FROM orders)
SELECT coalesce(b.id, u.id) AS id, coalesce(b.start_time, u.start_time) AS start_time, coalesce(b.duration, u.duration) AS duration, coalesce(u.description, b.description) AS description
FROM b FULL JOIN u ON u.id = b.id""")
def upsert_segments(spark, sf):
    base = R.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(
        F.min("l_shipdate").alias("start_time"), F.min("l_quantity").alias("duration"), F.min("l_returnflag").alias("description")
    )
    new = R.table(spark, sf, "orders").select(
        (F.col("o_orderkey") * 10 + 3).alias("id"), F.col("o_orderdate").alias("start_time"), F.col("o_totalprice").alias("duration"),
        F.col("o_orderpriority").alias("description"), F.col("o_custkey").alias("row_no"),
    )
    older = new.withColumn("description", F.lit("older")).withColumn("row_no", F.lit(-1).cast("long"))
    return tables.upsert_segments(base, new.unionByName(older), batch_order=["row_no"])


@query("d4_upsert_entities", f"""WITH {R.ENT_SQL}, u AS (SELECT user_id AS media, 'person_00' || CAST(event_id % 3 + 6 AS VARCHAR) AS entity_id, max(value) AS rep, count(*) AS n FROM events GROUP BY ALL)
SELECT coalesce(ent.media, u.media) AS media, coalesce(ent.entity_id, u.entity_id) AS entity_id, coalesce(u.rep, ent.first_seen) AS representative,
coalesce(ent.appearances, 0) + coalesce(u.n, 0) AS appearances, ent.name
FROM ent FULL JOIN u ON u.media = ent.media AND u.entity_id = ent.entity_id""")
def upsert_entities(spark, sf):
    base = R.entities(spark, sf).select("media", "entity_id", F.col("first_seen").alias("representative"), "appearances", "name")
    new = R.table(spark, sf, "events").select(
        F.col("user_id").alias("media"), F.concat(F.lit("person_00"), (F.col("event_id") % 3 + 6).cast("string")).alias("entity_id"),
        F.col("value").alias("representative"),
    )
    return tables.upsert_entities(base, new)


@query("d5_keyed_label_update", f"""WITH {R.DET_SQL} SELECT d.id, d.media, CASE WHEN e.value > 10 THEN 'post_' || e.event_type ELSE d.entity_id_batch END AS entity_id_batch
FROM det d JOIN events e ON e.event_id = d.id""")
def keyed_update(spark, sf):
    table = R.detections(spark, sf).select("id", "media", "entity_id_batch")
    changes = R.table(spark, sf, "events").filter("value > 10").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("media"), F.concat(F.lit("post_"), "event_type").alias("entity_id_batch")
    )
    return tables.keyed_update(table, changes, ["id", "media"], ["entity_id_batch"])


def gone_media(spark, sf):
    """Media with more than 66 detections, to be removed."""
    return R.table(spark, sf, "events").groupBy(F.col("user_id").alias("media")).agg(F.count(F.lit(1)).alias("n")).filter("n > 66").select("media")


GONE_SQL = "gone AS (SELECT user_id AS media FROM events GROUP BY user_id HAVING count(*) > 66)"


@query("d6_delete_media_counts", f"""WITH {R.ENT_SQL}, {GONE_SQL} SELECT 'detections' AS table_name, count(*) AS deleted FROM det WHERE media IN (SELECT media FROM gone)
UNION ALL SELECT 'entities', count(*) FROM ent WHERE media IN (SELECT media FROM gone)""")
def delete_counts(spark, sf):
    _, counts = tables.delete_media({"detections": R.detections(spark, sf), "entities": R.entities(spark, sf)}, gone_media(spark, sf))
    return counts


@query("d6_delete_media_rows", f"WITH {R.ENT_SQL}, {GONE_SQL} SELECT * FROM ent WHERE media NOT IN (SELECT media FROM gone)")
def delete_rows(spark, sf):
    kept, _ = tables.delete_media({"entities": R.entities(spark, sf)}, gone_media(spark, sf))
    return kept["entities"]


@query("d6_reset_media", f"""{MED}, g AS (SELECT DISTINCT l_orderkey AS media FROM lineitem WHERE l_quantity >= 50)
SELECT med.media, duration, CASE WHEN g.media IS NULL THEN phase1_status ELSE 'pending' END AS phase1_status, CASE WHEN g.media IS NULL THEN phase2_status ELSE 'pending' END AS phase2_status,
CASE WHEN g.media IS NULL THEN phase2_start_time END AS phase2_start_time, CASE WHEN g.media IS NULL THEN total_segments ELSE 0 END AS db_segments_loaded,
CASE WHEN g.media IS NULL THEN phase2_start_time ELSE TIMESTAMP '{NOW}' END AS updated_at FROM med LEFT JOIN g ON g.media = med.media""")
def reset(spark, sf):
    m = R.media(spark, sf).select(
        "media", "duration", "phase1_status", "phase2_status", "phase2_start_time", F.col("total_segments").alias("db_segments_loaded"),
        F.col("phase2_start_time").alias("updated_at"),
    )
    gone = R.table(spark, sf, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("media"))
    return tables.reset_media(m, gone, now())


@query("d7_delete_segments", f"WITH {R.SEG_SQL} SELECT media, segment_index FROM seg WHERE media <> 'src3'")
def delete_segments(spark, sf):
    return tables.delete_segments(R.segments(spark, sf).select("media", "segment_index"), "src3")


ORPHAN_SQL = """SELECT 'lineitem part' AS reference, count(*) AS orphans FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'event customer', count(*) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)"""


@query("d8_orphans", ORPHAN_SQL)
def orphans(spark, sf):
    li = R.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))
    part = R.table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    ev = R.table(spark, sf, "events").select(F.col("user_id").alias("k"))
    sup = R.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    return tables.orphans(li, part, ["k"], "lineitem part").unionByName(tables.orphans(ev, sup, ["k"], "event customer"))


@query("d8_delete_entities", f"""WITH {R.DET_SQL} SELECT id, media, CASE WHEN entity_id = 'person_002' THEN NULL ELSE entity_id END AS entity_id FROM det""")
def delete_entities(spark, sf):
    ent = R.entities(spark, sf)
    gone = ent.filter("entity_id = 'person_002'")
    _, cleared = tables.delete_entities(ent, R.detections(spark, sf).select("id", "media", "entity_id"), gone)
    return cleared


QUEUE_AS_OF = "1998-06-01 00:00:00"


@query("d9_work_queue", f"""{MED} SELECT media, phase2_status, phase2_start_time, duration FROM (SELECT *, duration * 1000 AS d FROM med)
WHERE phase1_status = 'completed' AND (phase2_status = 'pending' OR phase2_status = 'processing' AND NOT (epoch(TIMESTAMP '{QUEUE_AS_OF}') - epoch(phase2_start_time) < d * 2))""")
def work_queue(spark, sf):
    m = R.media(spark, sf).withColumn("duration", F.col("duration") * 1000)
    rows = tables.work_queue(m, "phase1", "phase2", F.lit(QUEUE_AS_OF).cast("timestamp"))
    return rows.select("media", "phase2_status", "phase2_start_time", (F.col("duration") / 1000).alias("duration"))


@query("d10_forced_reindex", f"""{MED} SELECT media, CASE WHEN db_load_status = 'failed' THEN 'pending' ELSE phase2_status END AS phase2_status FROM med""")
def forced(spark, sf):
    m = R.media(spark, sf)
    manifest = m.select("media", (F.col("db_load_status") == "failed").alias("force"))
    return tables.reset_media(m.select("media", "phase2_status"), tables.forced_reindex(manifest), now())


@query("d10_deleted_and_queued", f"""WITH {R.MEDIA_SQL}, {R.ENT_SQL}, f AS (SELECT media FROM med WHERE db_load_status = 'failed'),
q AS (SELECT med.media, 'queue' AS part, 1 AS n FROM med LEFT JOIN f ON f.media = med.media
 WHERE f.media IS NOT NULL OR phase2_status = 'pending' OR phase2_status = 'processing' AND NOT (epoch(TIMESTAMP '{QUEUE_AS_OF}') - epoch(phase2_start_time) < duration * 2))
SELECT * FROM q UNION ALL SELECT media, 'detections', count(*) FROM det WHERE media NOT IN (SELECT media FROM f) GROUP BY media
UNION ALL SELECT media, 'entities', count(*) FROM ent WHERE media NOT IN (SELECT media FROM f) GROUP BY media""")
def deleted_and_queued(spark, sf):
    """What forced media leave: rows of the other media, and the queue of the phase with the forced ones in it."""
    m = R.media(spark, sf)
    manifest = m.select("media", (F.col("db_load_status") == "failed").alias("force"))
    children = {"detections": R.detections(spark, sf), "entities": R.entities(spark, sf)}
    after, kept = tables.reindex_forced(manifest, m.select("media", "duration", "phase2_status", "phase2_start_time"), children, now())
    queue = tables.work_queue(after, None, "phase2", F.lit(QUEUE_AS_OF).cast("timestamp"))
    out = queue.select("media", F.lit("queue").alias("part"), F.lit(1).cast("long").alias("n"))
    for name, rows in kept.items():
        out = out.unionByName(rows.groupBy("media").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name)))
    return out


# --- files: tables are written to the shared scratch folder and read back -------------------------------


@query("s1_result_documents", """SELECT source AS media, doc_id AS segment_index, text AS transcript, n_chars % 7 AS frame_count FROM documents""")
def result_documents(spark, sf):
    """One JSON document per media, written and scanned; a media has a bounded number of segments per file part."""
    d = R.table(spark, sf, "documents")
    seg = F.struct(
        F.col("doc_id").cast("int").alias("segment_index"), F.col("text").alias("transcript"), (F.col("n_chars") % 7).cast("int").alias("frame_count")
    )
    # One document per (media, hundred segments), so no document grows with the table.
    docs = d.groupBy("source", F.floor(F.col("doc_id") / 100).alias("b")).agg(F.collect_list(seg).alias("segments"))
    root = scratch(spark)
    docs.select(F.col("source"), "segments").write.partitionBy("source").json(root)
    rows = spark.read.schema("segments array<struct<segment_index:int,transcript:string,frame_count:int>>, source string").json(root)
    return rows.select(F.col("source").alias("media"), F.explode("segments").alias("s")).select(
        "media", F.col("s.segment_index").cast("long").alias("segment_index"), "s.transcript", F.col("s.frame_count").cast("long").alias("frame_count")
    )


@query("s2_utterance_csv", f"""WITH {R.UTT_SQL} SELECT round("start", 4) AS "start", round("end", 4) AS "end", text FROM utt""")
def utterance_csv(spark, sf):
    root = scratch(spark)
    u = R.utterances(spark, sf).select(
        "start", "end", "text", F.lit("00:00:00").alias("start_formatted"), F.lit("00:00:01").alias("end_formatted")
    )
    u.write.option("header", True).option("escape", '"').option("lineSep", "\n").csv(root)
    rows = readers.read_utterances(spark, root)
    return rows.select(F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "text")


@query("s3_manifest", """SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'm' || CAST(o_orderkey AS VARCHAR) END AS media, 'video/m' || CAST(o_orderkey AS VARCHAR) || '.mp4' AS path,
o_orderpriority AS language, o_orderstatus = 'P' AS force FROM orders""")
def manifest(spark, sf):
    o = R.table(spark, sf, "orders")
    entry = F.struct(
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("name"),
        F.concat(F.lit("video/m"), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("path"),
        F.col("o_orderpriority").alias("language"), F.when(F.col("o_orderstatus") == "P", True).alias("force"),
    )
    root = scratch(spark)
    o.select(F.array(entry).alias("videos")).write.json(root)
    from mediaops import schema as S

    docs = spark.read.schema(S.MANIFEST).json(root)
    return readers.manifest_rows(docs)


@query("s8_event_export", """SELECT event_type AS media, event_id AS frame, value FROM events""")
def export(spark, sf):
    root = scratch(spark)
    e = R.table(spark, sf, "events").select(F.col("event_type").alias("media"), F.col("event_id").alias("frame"), "value")
    target = writers.export_csv(e, root, "objects")
    return spark.read.schema("frame long, value double, media string").option("header", True).csv(target)


@query("s9_result_versions", """SELECT o_orderkey AS media, CASE WHEN o_orderstatus = 'F' THEN 'second' ELSE 'first' END AS transcript, o_orderstatus <> 'F' AS success FROM orders""")
def result_versions(spark, sf):
    root = scratch(spark)
    o = R.table(spark, sf, "orders")

    def rows(df, text, ok):
        return df.select(
            F.col("o_orderkey").cast("string").alias("media"), F.lit(0).alias("segment_index"), F.lit(0.0).alias("start_time"),
            F.lit(50.0).alias("end_time"), F.lit(50.0).alias("duration"), F.lit(text).alias("transcript"), F.lit("{}").alias("analysis"),
            F.lit(1).alias("frame_count"), F.lit(ok).alias("success"), F.lit(None).cast("string").alias("parse_error"),
            F.lit(None).cast("string").alias("error"),
        )

    writers.save_results(rows(o, "first", True), root)
    writers.save_results(rows(o.filter("o_orderstatus = 'F'"), "second", False), root)
    return writers.latest_results(spark, root).select(F.col("media").cast("long").alias("media"), "transcript", "success")


@query("s10_appended_detections", """SELECT count(*) AS n, min(id) AS first_id, max(id) AS last_id, count(DISTINCT id) AS ids FROM (SELECT row_number() OVER () AS id FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events))""")
def appended(spark, sf):
    root = scratch(spark)
    e = R.table(spark, sf, "events").select("event_id", "user_id", "value")
    writers.append_detections(e, root, ["event_id"], {"value": "float"})
    writers.append_detections(e, root, ["event_id"], {"value": "float"})
    return spark.read.parquet(root).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("id").alias("ids")
    )


@query("s6_still_metadata", "SELECT o_orderstatus AS dir, 'img' || CAST(o_orderkey AS VARCHAR) AS path, CAST(floor(o_totalprice / 5000) AS INTEGER) AS speed FROM orders")
def still_metadata(spark, sf):
    root = scratch(spark)
    rows = R.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("dir"), F.lit("success").alias("status"),
        F.struct(F.concat(F.lit("img"), F.col("o_orderkey").cast("string")).alias("path")).alias("file_info"),
        F.struct(F.floor(F.col("o_totalprice") / 5000).cast("int").alias("speed")).alias("radar_data"),
    )
    writers.save_still_metadata(rows, root)
    return readers.read_still_metadata(spark, root).select("dir", "path", F.col("radar_data.speed").alias("speed"))


def write_in_folders(docs, root: str) -> None:
    """A text file per row (key, value) in a folder of its own, written by the tasks.

    Spark's writer holds each file open in turn and moves it twice, one after the other on the driver: with as many
    folders as media that takes longer than the rest.  Rows are dealt by their folder to all tasks, however small they are.
    """
    import pyarrow as pa

    key = docs.columns[0]
    name = F.concat(F.lit(f"/{key}="), F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = docs.select(name.alias("below"), F.col("value").cast("binary").alias("value")).repartition(tasks, "below")

    def write(batches):
        fs, top = image_files.open_folder(root)
        for batch in batches:
            for below, value in zip(batch.column("below"), batch.column("value")):
                fs.create_dir(top + below.as_py())
                with fs.open_output_stream(f"{top}{below.as_py()}/part-0.txt") as file:
                    file.write(value.as_py() + b"\n")
            yield pa.RecordBatch.from_arrays([batch.column("below")], ["below"])

    files.mapInArrow(write, "below string").write.format("noop").mode("overwrite").save()


@query("s1_result_files", """SELECT 'user ' || CAST(user_id AS VARCHAR) AS media, event_id AS segment_index, value AS start_time, event_type AS transcript,
event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 'broken' END AS "error" FROM events""")
def result_files(spark, sf):
    """Result documents, one JSON file per media in a folder of its own, read as the loader reads them."""
    root = scratch(spark)
    bad = F.col("event_type") == "error"
    segment = F.struct(
        F.col("event_id").cast("int").alias("segment_index"), F.col("value").alias("start_time"), F.col("event_type").alias("transcript"),
        (~bad).alias("success"), F.when(bad, "broken").alias("error"),
    )
    docs = R.table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(segment).alias("segments"), F.count(F.lit(1)).cast("int").alias("n"))
    info = F.struct(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("video_name"), F.col("n").alias("total_segments"))
    text = F.to_json(F.struct(info.alias("video_info"), F.col("segments")))
    write_in_folders(docs.select(F.col("user_id").alias("folder"), text.alias("value")), root)
    return readers.read_results(spark, root, named=True).select("media", F.col("segment_index").cast("long").alias("segment_index"), "start_time", "transcript", "success", "error")


@query("s3_manifest_files", """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'f' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS media, '/in/f' || CAST(c_custkey AS VARCHAR) || '.mp4' AS path,
c_mktsegment AS language, c_custkey % 5 = 0 AS force FROM customer WHERE c_custkey % 7 <> 0""")
def manifest_files(spark, sf):
    """A manifest file per nation; names are missing for some media, paths for others."""
    root = scratch(spark)
    c = R.table(spark, sf, "customer")
    key = F.col("c_custkey")
    entry = F.struct(
        F.when(key % 3 != 0, F.col("c_name")).alias("name"),
        F.when(key % 7 != 0, F.concat(F.lit("/in/f"), key.cast("string"), F.lit(".mp4"))).alias("path"),
        F.col("c_mktsegment").alias("language"), F.when(key % 5 == 0, True).alias("force"),
    )
    docs = c.groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(entry).alias("videos"))).alias("value"))
    docs.withColumnRenamed("c_nationkey", "folder").write.partitionBy("folder").text(root)
    return readers.read_manifest(spark, root)


@query("s12_description_csv", r"""SELECT source AS media, doc_id AS frame_index, text AS description, length(text) AS description_length FROM documents WHERE text <> ''""")
def description_csv(spark, sf):
    """Frame descriptions with line feeds and quotes to CSV and back; media are the folders."""
    root = scratch(spark)
    d = R.table(spark, sf, "documents").filter("text <> ''").select(
        F.col("source").alias("media"), F.col("n_chars").alias("timestamp"), F.col("doc_id").alias("frame_index"), F.col("text").alias("description"),
        F.lit(False).alias("context_provided"),
    )
    rows = writers.description_rows(d)
    target = writers.export_csv(rows, root, "vllm_analysis")
    kept = [f for f in rows.schema.fields if f.name != "media"]
    read = spark.read.schema(T.StructType([*kept, rows.schema["media"]])).option("header", True).option("multiLine", True).option("escape", '"')
    back = read.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(target)
    return back.select("media", "frame_index", "description", "description_length")


@query("s13_segmentation_csv", f"""WITH {R.UTT_SQL} SELECT media % 10 AS media, "start", "end", 'speech' AS type, true AS has_speech, text AS audio_text FROM utt""")
def segmentation_csv(spark, sf):
    root = scratch(spark)
    u = R.utterances(spark, sf).select(
        (F.col("media") % 10).alias("media"), F.col("start").alias("start_time"), F.col("end").alias("end_time"), (F.col("end") - F.col("start")).alias("duration"),
        F.lit("speech").alias("kind"), F.lit(True).alias("has_speech"), "text",
    )
    rows = writers.segmentation_rows(u)
    target = writers.export_csv(rows, root, "scene_segmentation")
    kept = [f for f in rows.schema.fields if f.name != "media"]
    read = spark.read.schema(T.StructType([*kept, rows.schema["media"]])).option("header", True).option("multiLine", True).option("escape", '"')
    return read.csv(target).select("media", "start", "end", "type", "has_speech", "audio_text")


@query("s8_scene_csv", """SELECT l_orderkey % 10 AS media, l_quantity AS "start", l_extendedprice AS "end" FROM lineitem""")
def scene_csv(spark, sf):
    """Of a scene row only the second and third column are written."""
    root = scratch(spark)
    scenes = R.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 10).alias("media"), F.col("l_linenumber").alias("scene"), F.col("l_quantity").alias("start"), F.col("l_extendedprice").alias("end"), "l_tax"
    )
    target = writers.export_scenes(scenes, root)
    return spark.read.schema("start double, end double, media long").option("header", True).csv(target)


HEADS = ["FFD8FFE000104A46", "89504E470D0A1A0A", "424D000000000000", "25504446", "474946383961AA", "00"]


@query("s5_header_check", """SELECT event_id AS path, CASE event_id % 6 WHEN 3 THEN 'unknown header' WHEN 5 THEN 'file too small' END AS error FROM events""")
def header_check(spark, sf):
    """Headers derived from the event number: four kinds of image, one other file, one too small."""
    e = R.table(spark, sf, "events")
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("event_id") % 6 + 1).cast("int"))
    files = e.select(F.col("event_id").alias("path"), F.unhex(head).alias("header"), F.lit(100).cast("long").alias("size"))
    valid, skipped = readers.check_headers(files)
    return valid.select("path", F.lit(None).cast("string").alias("error")).unionByName(skipped.select("path", "error"))


@query("s4_file_listing", """SELECT 'media=' || CAST(user_id AS VARCHAR) AS dir, length(CAST(count(*) AS VARCHAR)) + 1 AS size FROM events GROUP BY user_id""")
def file_listing(spark, sf):
    """Listing below a folder that holds one small file per media."""
    root = scratch(spark)
    e = R.table(spark, sf, "events").groupBy(F.col("user_id").alias("media")).agg(F.count(F.lit(1)).alias("n"))
    write_in_folders(e.select("media", F.col("n").cast("string").alias("value")), root)
    return readers.list_images(spark, root, ("txt",)).select(F.regexp_extract("dir", r"media=\d+$", 0).alias("dir"), "size")




# Heads of the stills below by user: five kinds of image, another file, one too small, an empty one.
STILL_HEADS = ["FFD8FFE000104A46", "89504E470D0A1A0A", "424D0000", "474946383961", "52494646", "25504446", "FFD8FF", ""]
STILL_SUFFIXES = ["jpg", "JPEG", "png", "bmp", "tiff", "webp", "txt"]
STILL_SQL = f"""still AS (SELECT user_id, user_id % 7 AS s, list_extract({STILL_HEADS!r}, CAST(user_id % 8 + 1 AS BIGINT)) AS head,
  list_extract({STILL_SUFFIXES!r}, CAST(user_id % 7 + 1 AS BIGINT)) AS suffix, CASE WHEN user_id % 8 < 6 THEN count(*) ELSE 0 END AS body FROM events GROUP BY user_id)"""


def still_files(spark, sf):
    """A file per user, written by the tasks: a head, then a byte per event; names in folders by user."""
    import pyarrow as pa

    root = scratch(spark)
    u = R.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    head = F.element_at(F.array(*[F.lit(h) for h in STILL_HEADS]), (F.col("user_id") % 8 + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in STILL_SUFFIXES]), (F.col("user_id") % 7 + 1).cast("int"))
    below = F.format_string("/%d/still %d.%s", F.col("user_id") % 4, F.col("user_id"), suffix)
    files = u.select(below.alias("below"), F.unhex(head).alias("head"), F.when(F.col("user_id") % 8 < 6, F.col("n")).otherwise(0).alias("body"))

    def write(batches):
        fs, top = image_files.open_folder(root)
        for batch in batches:
            for row in batch.to_pylist():
                path = top + row["below"]
                fs.create_dir(path.rsplit("/", 1)[0])
                with fs.open_output_stream(path) as file:
                    file.write(row["head"] + b"." * row["body"])
            yield pa.RecordBatch.from_arrays([batch.column("below")], ["below"])

    files.mapInArrow(write, "below string").write.format("noop").mode("overwrite").save()
    return root


@query("s4_image_heads", f"""WITH {STILL_SQL} SELECT 'still ' || CAST(user_id AS VARCHAR) || '.' || suffix AS name, CAST(user_id % 4 AS VARCHAR) AS folder, length(head) // 2 + body AS size,
substr(head || repeat('2E', CAST(body AS BIGINT)), 1, 24) AS header FROM still WHERE suffix <> 'txt'""")
def image_heads(spark, sf):
    """Image files of six suffixes, listed and read by tasks."""
    files = image_files.read_image_heads(spark, still_files(spark, sf))
    return files.select("name", F.element_at(F.split("dir", "/"), -1).alias("folder"), "size", F.hex("header").alias("header"))


@query("s5_image_checks", f"""WITH {STILL_SQL} SELECT 'still ' || CAST(user_id AS VARCHAR) || '.' || suffix AS name, CASE user_id % 8 WHEN 5 THEN 'unknown header'
WHEN 6 THEN 'file too small' WHEN 7 THEN 'empty file' END AS error FROM still WHERE suffix <> 'txt'""")
def image_checks(spark, sf):
    """Heads of real files checked; empty and short files and other formats are skipped with a reason."""
    valid, skipped = readers.check_headers(image_files.read_image_heads(spark, still_files(spark, sf)))
    return valid.select("name", F.lit(None).cast("string").alias("error")).unionByName(skipped.select("name", "error"))


BROKEN_SQL = "doc AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)"


def broken_result_files(spark, sf):
    """A result document per user; those of every fifth user are cut, the next users' have no segments."""
    root = scratch(spark)
    segment = F.struct(F.col("event_id").cast("int").alias("segment_index"), F.col("event_type").alias("transcript"))
    docs = R.table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(segment).alias("segments"))
    info = F.struct(F.format_string("user %d", "user_id").alias("video_name"))
    whole = F.to_json(F.struct(info.alias("video_info"), F.col("segments")))
    form = F.col("user_id") % 5
    text = F.when(form == 0, F.substring(whole, F.lit(1), F.length(whole) - 7)).when(form == 1, F.to_json(F.struct(info.alias("video_info")))).otherwise(whole)
    write_in_folders(docs.select(F.col("user_id").alias("folder"), text.alias("value")), root)
    return root


@query("s1_good_documents", f"""WITH {BROKEN_SQL} SELECT 'user ' || CAST(user_id AS VARCHAR) AS media, n AS segments FROM doc WHERE user_id % 5 > 1""")
def good_documents(spark, sf):
    """Segments per media of the documents that load, with broken ones beside them."""
    good, _ = readers.read_results_and_rejects(spark, broken_result_files(spark, sf), named=True)
    return good.groupBy("media").agg(F.count(F.lit(1)).alias("segments"))


@query("s1_rejected_documents", f"""WITH {BROKEN_SQL} SELECT user_id AS media, CASE user_id % 5 WHEN 0 THEN 'malformed document' ELSE 'no segments' END AS reason FROM doc WHERE user_id % 5 < 2""")
def rejected_documents(spark, sf):
    _, rejects = readers.read_results_and_rejects(spark, broken_result_files(spark, sf), named=True)
    return rejects.select(F.regexp_extract("file", r"folder=(\d+)", 1).cast("long").alias("media"), "reason")


@query("x17_run_log", """SELECT user_id AS run, count(*) FILTER (event_type = 'click') AS segments, count(*) AS "lines",
date_trunc('second', max(ts) FILTER (event_type = 'view')) AS started, date_trunc('second', max(ts) FILTER (event_type = 'error')) AS ended FROM events GROUP BY user_id""")
def run_log(spark, sf):
    root = scratch(spark)
    e = R.table(spark, sf, "events")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit("Segment "), F.col("event_id").cast("string"), F.lit(" processed successfully")))
        .when(kind == "view", F.lit("Phase 2: VLLM Analysis...")).when(kind == "error", F.lit("Phase 2 results saved to: x"))
        .otherwise(F.lit("other"))
    )
    line = F.concat_ws(" ", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), text)
    # A line names its run: a folder for each would be as many files as there are runs, times the tasks.
    e.select(F.col("user_id").alias("run"), line.alias("line")).write.json(root)
    lines = readers.with_log_time(spark.read.schema("run long, line string").json(root))
    return readers.mine_run_log(lines).drop("seconds")


@query("e2_union_of_counts", """SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def counts(spark, sf):
    return rollups.table_counts({t: R.table(spark, sf, t) for t in ("customer", "supplier")})


@query("d11_cleared_table", "SELECT 0 AS n, count(*) AS before FROM events")
def cleared(spark, sf):
    root = scratch(spark)
    e = R.table(spark, sf, "events").select("event_id", "value")
    e.write.parquet(root)
    before = spark.read.parquet(root).count()
    writers.clear_table(spark, "event_id long, value double", root)
    return spark.read.parquet(root).agg(F.count(F.lit(1)).alias("n"), F.lit(before).alias("before"))
