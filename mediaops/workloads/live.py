"""Streaming operators run to the end of the stored tables as streams of files."""


from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.functions.clock import whole_second
from mediaops.operators import hooks, tables
from mediaops.plans.staging import scratch_folder as scratch
from mediaops.sources import writers
from mediaops.sources.image_files import open_folder
from mediaops.streaming import operators as S
from mediaops.streaming import stateful
from mediaops.streaming.sequences import frame_sequences
from mediaops.streaming.stateful import use_state_store
from mediaops.workloads import clustering as CL
from mediaops.workloads import roles as R
from mediaops.workloads.grouping import FILES_SQL, SEQUENCE_SQL, unique_stills
from mediaops.workloads.registry import query


FILE_ROWS = 100_000


def drain(spark, stream, mode: str = "append"):
    """Run a stream over all present files and give the written rows."""
    root = scratch(spark)
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/state"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def drain_stateful(spark, stream):
    """The same for operators with state of their own; the session's state store is as before afterwards."""
    keys = [f"spark.sql.streaming.stateStore.{k}" for k in ("providerClass", "rocksdb.changelogCheckpointing.enabled")]
    before = {k: spark.conf.get(k, None) for k in keys}
    use_state_store(spark)
    try:
        return drain(spark, stream)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(spark, df, order: str, files: int = 3, closing=None):
    """Rows as the files of a stream in ranges of ``order``, range after range; each range is a micro-batch.

    ``closing`` has rows that tell the operator that the input has ended; they are the last batch.
    """
    ranged = df.repartitionByRange(files, order).withColumn("_file", F.spark_partition_id())
    return staged_by(spark, ranged, files, closing)


def staged_by(spark, df, files: int, closing=None):
    """The same for rows that bring the number of their micro-batch in ``_file``.

    A range is written by as many tasks as its size asks for, all ranges by the same number; the stream reads that many
    files at a time.
    """
    root = scratch(spark)
    df.write.partitionBy("_file").parquet(f"{root}/ranges")
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "_file"], T.StructField("_file", T.IntegerType())])
    ranges = spark.read.schema(schema).parquet(f"{root}/ranges")
    least = ranges.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    tasks = max(1, least // FILE_ROWS)
    for number in range(files):
        ranges.filter(F.col("_file") == number).drop("_file").repartition(tasks).write.mode("append").parquet(f"{root}/arrived")
    if closing is not None:
        closing.coalesce(1).write.mode("append").parquet(f"{root}/arrived")
    return S.file_stream(spark, f"{root}/arrived", T.StructType(schema.fields[:-1]), tasks)


def later(df, ts: str = "ts"):
    """One row a day after all others, otherwise null: it closes every window and session before it."""
    end = df.agg((F.max(ts) + F.expr("INTERVAL 1 DAY")).alias("_end"))
    return end.select(*[(F.col("_end") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])




@query("u1_second_events", f"""SELECT user_id AS media, date_trunc('second', ts) AS second, count(*) AS "count", string_agg(event_type, ',' ORDER BY event_id) AS objects
FROM events GROUP BY ALL""")
def second_events(spark, sf):
    e = R.table(spark, sf, "events").select(
        F.col("user_id").alias("media"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("frame_no"), F.col("event_type").alias("label")
    )
    return drain(spark, S.second_events(staged(spark, e, "ts", closing=later(e))))


@query("u4_label_changes", f"""WITH {R.DET_SQL}, p AS (SELECT media, frame_no, label, lag(label) OVER (PARTITION BY media ORDER BY frame_no) AS previous_label FROM det)
SELECT * FROM p WHERE previous_label IS NULL OR previous_label <> label""")
def label_changes(spark, sf):
    return drain(spark, S.label_changes(staged(spark, R.detections(spark, sf).select("media", "frame_no", "label"), "frame_no")))


@query("u5_frame_batches", f"""WITH {R.DET_SQL}, n AS (SELECT media, frame_no, row_number() OVER (PARTITION BY media ORDER BY frame_no) - 1 AS i FROM det)
SELECT media, i // 3 AS request_no, string_agg(CAST(frame_no AS VARCHAR), ',' ORDER BY frame_no) AS frames FROM n GROUP BY ALL""")
def frame_batches(spark, sf):
    frames = R.detections(spark, sf).select("media", "frame_no")
    ends = frames.select("media").distinct().withColumn("frame_no", F.lit(None).cast("long"))
    return drain(spark, S.frame_batches(staged(spark, frames, "frame_no", closing=ends)))


# Two thirds of the rows come in order of time, a third one batch later: late for what the watermark closed meanwhile.
ARRIVAL_SQL = f"""a AS (SELECT user_id AS media, event_id, event_type, ts, CAST(epoch_us(ts) AS BIGINT) AS us,
  least((epoch_us(ts) - {R.EPOCH_US}) // (span // 4 + 1), 3) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS file
  FROM events, (SELECT max(epoch_us(ts)) - {R.EPOCH_US} + 1 AS span FROM events)),
w AS (SELECT file + 1 AS file, max(max(us)) OVER (ORDER BY file) // 1000 - 10000 AS mark FROM a GROUP BY file),
j AS (SELECT a.*, date_trunc('second', ts) AS second, (us // 1000000 + 1) * 1000 <= coalesce(mark, 0) AS late FROM a LEFT JOIN w USING (file))"""


@query("u1_late_rows", f"""WITH {ARRIVAL_SQL}
SELECT media, second, count(*) AS "count", string_agg(event_type, ',' ORDER BY event_id) AS objects, false AS late FROM j WHERE NOT late GROUP BY media, second
UNION ALL SELECT media, second, 1, event_type, true FROM j WHERE late""")
def late_rows(spark, sf):
    """Seconds without what came too late for them, and what came too late."""
    e = R.table(spark, sf, "events").select(
        F.col("user_id").alias("media"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("frame_no"), F.col("event_type").alias("label")
    )
    since = F.unix_micros("ts") - R.EPOCH_US
    span = e.agg(F.max(since) + 1).first()[0]
    file = F.least(F.floor(since / (span // 4 + 1)), F.lit(3)) + F.when(F.col("frame_no") % 3 == 0, 1).otherwise(0)
    stream = staged_by(spark, e.withColumn("_file", file.cast("int")), 5, later(e))
    return drain_stateful(spark, stateful.second_events_and_late_rows(stream))


@query("u2_online_clusters", CL.online_sql("best"))
def online_clusters(spark, sf):
    rows = R.vectors(spark, sf).select("media", "id", "t", "embedding")
    return drain_stateful(spark, stateful.online_clusters(staged(spark, rows, "t"), 0.3))


@query("u3_quiet_sessions", f"""WITH {FILES_SQL}, q AS (SELECT *, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY dir ORDER BY ms, frame_no) AS run
  FROM (SELECT *, ms - lag(ms) OVER (PARTITION BY dir ORDER BY ms, frame_no) <= 500 AS b FROM f))
SELECT dir, make_timestamp({R.EPOCH_US} + min(ms) * 1000) AS started, count(*) AS files,
  arg_min(strftime(make_timestamp({R.EPOCH_US} + ms * 1000), '%Y%m%d%H%M%S%g') || '-' || CAST(frame_no AS VARCHAR) || '.jpg', (ms, frame_no)) AS first_name,
  max(frame_no) AS last_frame FROM q GROUP BY dir, run""")
def quiet_sessions(spark, sf):
    rows = unique_stills(spark, sf).select("dir", "name", "frame_no", F.col("taken_at").alias("ts"))
    return drain(spark, S.quiet_sessions(staged(spark, rows, "ts", closing=later(rows))))


@query("u3_frame_sequences", f"""WITH RECURSIVE {SEQUENCE_SQL}
SELECT dir, sequence_id, count(*) AS files, arg_min(frame_no, pos) AS first_frame, arg_max(frame_no, pos) AS last_frame, min(taken_at) AS started, max(taken_at) AS ended
FROM s GROUP BY dir, sequence_id""")
def sequences_on_a_stream(spark, sf):
    """Stills in five batches, every fifth a batch later than its neighbours, within a lateness that covers it."""
    rows = unique_stills(spark, sf).select("dir", "name", "taken_at", "frame_no")
    ends = rows.agg(F.min("taken_at"), F.max("taken_at")).first()
    span = int((ends[1] - ends[0]).total_seconds()) + 1
    at = F.floor((F.unix_micros("taken_at") / 1_000_000 - F.unix_seconds(F.lit(ends[0]))) * 4 / span)
    file = F.least(at, F.lit(3)) + F.when(F.pmod(F.xxhash64("name"), F.lit(5)) == 0, 1).otherwise(0)
    stream = staged_by(spark, rows.withColumn("_file", file.cast("int")), 5, later(rows, "taken_at"))
    return drain_stateful(spark, frame_sequences(stream, f"{span} seconds"))


@query("u6_sliding_segments", f"""WITH {R.UTT_SQL}, g AS (SELECT media, "start" AS t, length(text) AS n, unnest(range(CAST(greatest(0, ceil(("start" - 50 + 0.000001) / 35)) AS BIGINT), CAST(floor("start" / 35) AS BIGINT) + 1)) AS segment_index FROM utt)
SELECT media, segment_index, count(*) AS utterances, sum(n) AS chars FROM g GROUP BY ALL""")
def sliding_segments(spark, sf):
    """Media one after the other, each from its own beginning in two batches; a row without a start ends each."""
    u = R.utterances(spark, sf).select("media", "start", "text")
    half = F.col("start") > F.max("start").over(Window.partitionBy("media")) / 2
    file = F.pmod("media", F.lit(2)) * 2 + F.when(half, 1).otherwise(0)
    ends = u.select("media").distinct().select("media", F.lit(None).cast("double").alias("start"), F.lit(None).cast("string").alias("text"))
    stream = staged_by(spark, u.withColumn("_file", file.cast("int")), 4, ends)
    return drain_stateful(spark, stateful.sliding_segments(stream)).filter("not late").drop("late")


@query("u7_incremental_upsert", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END AS start_time,
o_orderpriority AS description FROM orders""")
def incremental(spark, sf):
    """A table that has a third of the segments; files arrive one by one, and every segment comes twice."""
    root = scratch(spark)
    rows = R.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("start_time"), F.col("o_orderpriority").alias("description")
    )
    old = rows.filter("id % 3 = 0").withColumn("description", F.lit("old"))
    old.withColumn("start_time", F.col("start_time") - F.expr("INTERVAL 1 DAY")).write.parquet(f"{root}/v0")

    def merge(batch, number):
        base = spark.read.schema(rows.schema).parquet(f"{root}/v{number}")
        tables.upsert_segments(base, batch).write.mode("overwrite").parquet(f"{root}/v{number + 1}")

    arrived = f"{root}/arrived"
    for text in (rows.withColumn("description", F.lit("draft")), rows):
        text.repartitionByRange(2, "id").sortWithinPartitions("id").write.mode("append").parquet(arrived)
    source = S.file_stream(spark, arrived, rows.schema, 1)
    S.upsert_batches(source, merge, f"{root}/state").awaitTermination()
    last = 0
    while writers._exists(spark, f"{root}/v{last + 1}/_SUCCESS"):
        last += 1
    return spark.read.schema(rows.schema).parquet(f"{root}/v{last}")


@query("h1_scored_batches", "SELECT event_id, value * 2 AS score FROM events")
def scored(spark, sf):
    rows = R.table(spark, sf, "events").select("event_id", "value")
    return hooks.score_batches(rows, lambda p: p.assign(score=p["value"] * 2)[["event_id", "score"]], "event_id long, score double", 500)


@query("h1_model_scores", """WITH m AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS spread FROM events GROUP BY 1)
SELECT event_id, round(1 / (1 + exp(-(value - mean) / spread)), 6) AS score FROM events JOIN m USING (event_type)""")
def model_scores(spark, sf):
    """A model fitted per kind of event, stored as a table and loaded once by every Python worker."""
    e = R.table(spark, sf, "events").select("event_id", "event_type", "value")
    kinds = F.abs(F.xxhash64("event_type") % 1_000_003)
    folder = scratch(spark)
    e.groupBy(kinds.alias("kind")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread")).write.parquet(folder)

    def load():
        import numpy as np
        import pyarrow.parquet as pq

        fs, path = open_folder(folder)
        model = pq.read_table(path, filesystem=fs).sort_by("kind")
        known, mean, spread = (model.column(c).to_numpy() for c in ("kind", "mean", "spread"))

        def predict(kind, value):
            at = np.searchsorted(known, kind.astype(np.int64))
            return 1 / (1 + np.exp(-(value - mean[at]) / spread[at]))

        return predict

    rows = hooks.score_with_model(e.withColumn("kind", kinds), load, ["kind", "value"])
    return rows.select("event_id", F.round("score", 6).alias("score"))


@query("h2_embedded_texts", """SELECT doc_id, CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 0.0 ELSE 1.0 END AS length FROM documents""")
def embedded(spark, sf):
    rows = hooks.embed(R.table(spark, sf, "documents").select("doc_id", "text"), "text", dim=384)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return rows.select("doc_id", F.round(F.sqrt(square), 4).alias("length"))


@query("h3_keyed_fold", f"""WITH {R.DET_SQL} SELECT media, count(*) AS seconds FROM (SELECT DISTINCT media, CAST(round_even(t, 0) AS BIGINT) AS s FROM det) GROUP BY media""")
def folded(spark, sf):
    """Number of distinct seconds per media as a fold with the last second as state."""
    import numpy as np

    from mediaops.plans.folds import fold_by_key

    det = R.detections(spark, sf).select("media", "id", whole_second(F.col("t")).alias("s"))

    def walk(pdf, first, state, opened):
        s = pdf["s"].to_numpy(float)
        new = first | (s != np.concatenate([[state], s[:-1]]))
        return pdf[["media", "s"]][new], float(s[-1]), opened + int(new.sum())

    def probe(pdf):
        return [0.0], [float(pdf["s"].iloc[-1])], [1]

    schema = det.select("media", "s").schema
    rows = fold_by_key(det, ["media"], ["s", "id"], walk, schema, float("nan"), probe, lambda state, marks: 0)
    return rows.groupBy("media").agg(F.count(F.lit(1)).alias("seconds"))
