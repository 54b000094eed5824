"""Sequences in slices and stream operators with state of their own, against plain models."""

import collections
import datetime
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaops.operators import clustering, sequences
from mediaops.streaming import operators as S
from mediaops.streaming import stateful
from mediaops.streaming.sequences import frame_sequences
from mediaops.workloads.live import drain_stateful, later, staged_by

EPOCH = datetime.datetime(2025, 9, 22, 14)


def model(files):
    """The rule as written: every file looks through all sequences in the order of their making."""
    groups, out = [], {}
    for name, at, frame in sorted(files):
        hit = next((g for g in groups if frame > 1 and g[-1][1] == frame - 1 and abs(at - g[-1][0]) <= 500_000), None)
        if hit is None:
            hit = []
            groups.append(hit)
        hit.append((at, frame, name))
        out[name] = (hit[0][2], len(hit))
    return out


def stills(seed, count, steps, frames=5, odd=False):
    rnd, at, found = random.Random(seed), 0, {}
    for _ in range(count):
        at += rnd.choice(steps) * 1000
        frame = rnd.randrange(1, frames)
        stamp = (EPOCH + datetime.timedelta(microseconds=at)).strftime("%Y%m%d%H%M%S%f")
        digits = rnd.choice([14, 15, 16, 17]) if odd else 17
        clock = at if digits == 17 else at // 1_000_000 * 1_000_000
        found[f"{stamp[:digits]}-{frame}.jpg"] = (clock, frame)
    return [(n, at, f) for n, (at, f) in found.items()]


def frame_of(spark, by_dir):
    rows = [(d, n) for d, files in by_dir.items() for n, _, _ in files]
    parsed = sequences.parse_file_names(spark.createDataFrame(rows, "dir string, name string"))
    return parsed.select("dir", "name", "taken_at", "frame_no").repartition(5)


@pytest.mark.parametrize("max_rows", [10**6, 150, 25])
def test_sequences_in_slices(spark, max_rows):
    by_dir = {
        "dense": stills(1, 600, [0, 1, 20, 90], 4), "loose": stills(2, 200, [0, 300, 499, 500, 501, 900]),
        "odd": stills(3, 300, [0, 7, 120, 400], 4, odd=True), None: stills(4, 120, [0, 30, 200]), "few": stills(5, 3, [100]),
        "chain": [((EPOCH + datetime.timedelta(milliseconds=200 * i)).strftime("%Y%m%d%H%M%S%f")[:17] + f"-{i + 1}.jpg", 200_000 * i, i + 1) for i in range(300)],
    }
    got = {(r.dir, r.name): (r.sequence_id, r.pos) for r in sequences.build_sequences(frame_of(spark, by_dir), max_rows).collect()}
    assert got == {(d, n): v for d, files in by_dir.items() for n, v in model(files).items()}


def test_endless_chain_is_split(spark):
    """One sequence of 100,000 stills, a fifth of a second apart: several tasks, one id, positions in a row."""
    at = F.timestamp_micros(F.lit(1_758_549_600_000_000) + F.col("id") * 200_000)
    files = spark.range(100_000).select(
        F.lit("cam").alias("dir"), F.concat(F.date_format(at, "yyyyMMddHHmmssSSS"), F.lit("-"), F.col("id") + 1, F.lit(".jpg")).alias("name"),
        at.alias("taken_at"), (F.col("id") + 1).alias("frame_no"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few bytes become one task
    try:
        found = sequences.build_sequences(files, max_rows=20_000).withColumn("task", F.spark_partition_id())
        r = found.agg(F.count_distinct("sequence_id"), F.sum((F.col("pos") != F.col("frame_no")).cast("int")), F.count_distinct("task")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert r[0] == 1 and r[1] == 0 and r[2] > 1


def test_sequences_on_a_stream(spark):
    """Interleaved and late stills in five batches; what the watermark drops is unknown to the model too."""
    by_dir = {"a": stills(11, 250, [0, 30, 200, 499, 501, 2000], odd=True), "b": stills(12, 250, [0, 90, 400, 900])}
    frame = frame_of(spark, by_dir)
    rows = [(d, *f) for d, files in by_dir.items() for f in files]
    top = max(at for _, _, at, _ in rows)
    rnd = random.Random(0)
    file = {(d, n): min(3, at * 4 // (top + 1)) + rnd.choice([0, 0, 0, 1]) for d, n, at, _ in rows}
    lost = ("a", *min(by_dir["a"], key=lambda f: f[1]))
    file[lost[:2]] = 4
    numbered = spark.createDataFrame([(d, n, k) for (d, n), k in file.items()], "dir string, name string, _file int")
    arrived = frame.join(numbered, ["dir", "name"])
    lateness = top // 4_000_000 * 2 + 2  # covers one batch, not four
    got = drain_stateful(spark, frame_sequences(staged_by(spark, arrived, 5, later(frame, "taken_at")), f"{lateness} seconds")).collect()
    want = collections.Counter()
    for d, files in by_dir.items():
        kept = [f for f in files if (d, f[0]) != lost[:2]]
        found, by = model(kept), collections.defaultdict(list)
        for n, at, f in sorted(kept):
            by[found[n][0]].append((at, f))
        want.update((d, s, len(x), x[0][1], x[-1][1]) for s, x in by.items())
    assert collections.Counter((r.dir, r.sequence_id, r.files, r.first_frame, r.last_frame) for r in got) == want


def test_names_without_a_clock_on_a_stream(spark):
    frame = spark.createDataFrame([("a", "odd.jpg", None, None), ("a", None, EPOCH, 1)], "dir string, name string, taken_at timestamp, frame_no long")
    got = drain_stateful(spark, frame_sequences(staged_by(spark, frame.withColumn("_file", F.lit(0)), 1))).collect()
    assert [(r.dir, r.sequence_id, r.files, r.first_frame) for r in got] == [("a", "odd.jpg", 1, None)]


def test_late_rows_are_set_aside(spark):
    at = lambda s: EPOCH + datetime.timedelta(seconds=s)
    data = [(1, at(0.2), 2, "b", 0), (1, at(0.1), 1, "a", 0), (2, at(0.5), 3, "c", 0), (1, at(40), 4, "d", 0),
            (1, at(0.9), 5, "late", 1), (2, at(31.5), 6, "in time", 1), (1, at(90), None, None, 1), (2, None, 7, "no time", 1),
            (1, at(79.2), 8, "on the edge", 2), (1, at(80.2), 9, "after", 2)]
    rows = spark.createDataFrame(data, "media long, ts timestamp, frame_no long, label string, _file int")
    stream = staged_by(spark, rows, 3, later(rows.drop("_file")))
    got = {(r.media, r.second, r["count"], r.objects, r.late) for r in drain_stateful(spark, stateful.second_events_and_late_rows(stream, shares=3)).collect()}
    want = {(1, at(0), 2, "a,b", False), (2, at(0), 1, "c", False), (1, at(40), 1, "d", False), (1, at(0), 1, "late", True),
            (2, at(31), 1, "in time", False), (1, at(90), 1, "", False), (1, at(79), 1, "on the edge", True), (1, at(80), 1, "after", False)}
    assert got == want


def test_segments_follow_their_own_media(spark):
    rnd = random.Random(3)
    rows, want = [], collections.defaultdict(lambda: [0, 0])
    for media in range(4):
        for start in sorted(round(rnd.uniform(0, 400), 3) for _ in range(60)):
            text = "x" * rnd.randrange(9)
            rows.append((media, start, text, 3 - media))  # the last media first
            for i in range(max(0, int((start - 50) // 35) + 1), int(start // 35) + 1):
                want[media, i][0] += 1
                want[media, i][1] += len(text)
    rows += [(3, 1.0, "late", 1), (3, None, None, 2)]
    ends = [(m, None, None) for m in range(3)]
    schema = "media long, start double, text string"
    stream = staged_by(spark, spark.createDataFrame(rows, schema + ", _file int"), 4, spark.createDataFrame(ends, schema))
    got = drain_stateful(spark, stateful.sliding_segments(stream)).collect()
    assert {(r.media, r.segment_index): [r.utterances, r.chars] for r in got if not r.late} == dict(want)
    assert [(r.media, r.segment_index, r.utterances) for r in got if r.late] == [(3, 0, 1)]


def test_idle_media_are_closed(spark, tmp_path):
    """Nothing ends the media but time."""
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, 10.0, "ab"), (1, 40.0, "c")], "media long, start double, text string").coalesce(1).write.parquet(path)
    stateful.use_state_store(spark)
    try:
        rows = stateful.sliding_segments(S.file_stream(spark, path, "media long, start double, text string"), idle_ms=500)
        run = rows.writeStream.format("memory").queryName("idle_media").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
        found, end = [], time.time() + 60
        while len(found) < 2 and time.time() < end:
            time.sleep(1)
            found = spark.table("idle_media").collect()
        run.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r.segment_index, r.utterances, r.chars, r.late) for r in found) == [(0, 2, 3, False), (1, 1, 1, False)]


def test_known_entities_are_not_written_again(spark, tmp_path):
    """A first batch opens 300 entities; later ones open one each, and write about as much as that."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 48))
    rows = [(1, i, float(i), v.tolist(), 0) for i, v in enumerate(base)]
    for batch in (1, 2, 3):
        again = base[rng.choice(300, 40, replace=False)] + 0.01 * rng.normal(size=(40, 48))
        new = [*again, rng.normal(size=48)]
        rows += [(1, 1000 * batch + i, 1000.0 * batch + i, v.tolist(), batch) for i, v in enumerate(new)]
    frame = spark.createDataFrame(rows, "media long, id long, t double, embedding array<double>, _file int")
    source, sizes = staged_by(spark, frame, 4), {}
    stateful.use_state_store(spark)
    try:
        out = stateful.online_clusters(source, 0.8)
        run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    for file in (tmp_path / "c" / "state").rglob("*.changelog"):
        version = int(file.name.split(".")[0].split("_")[0])
        sizes[version] = sizes.get(version, 0) + file.stat().st_size
    first, *rest = [sizes[v] for v in sorted(sizes)][:4]
    assert len(rest) == 3 and max(rest) < first / 20
    got = {r.id: r.entity_no for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.entity_no for r in clustering.online_clusters(frame.drop("_file"), 0.8).collect()}


def test_late_rows_of_many_media_share_state(spark, tmp_path):
    """2,000 media in two shares: state has entries of many media, not some per media, and nulls stay what they are."""
    data = [(m, EPOCH + datetime.timedelta(seconds=m % 7, milliseconds=m % 3), m, "x", 0) for m in range(2000)]
    data += [(None, EPOCH, None, "b", 0), (None, EPOCH, 2**60 + 1, None, 0), (2**60 + 1, EPOCH, 2, "c", 0), (2**60 + 1, EPOCH, 1, "d", 0), (0, EPOCH, None, "n", 0)]
    rows = spark.createDataFrame(data, "media long, ts timestamp, frame_no long, label string, _file int")
    source = staged_by(spark, rows, 1, later(rows.drop("_file")))
    stateful.use_state_store(spark)
    try:
        out = stateful.second_events_and_late_rows(source, shares=2)
        run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert max(s.numRowsUpdated for p in run.recentProgress for s in p.stateOperators) < 200
    got = {(r.media, r.second): (r["count"], r.objects, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(m, at.replace(microsecond=0)): (1, "x", False) for m, at, _, _, _ in data[:2000]}
    assert got == want | {(None, EPOCH): (2, "b", False), (2**60 + 1, EPOCH): (2, "d,c", False), (0, EPOCH): (2, "n,x", False)}


def test_folds_of_many_media_share_state(spark, tmp_path):
    """1,000 media in two batches: state has a row per share, and a null media, null labels and ends are as before."""
    data = [(m, 10 * b + i, f"l{(m + b + i // 2) % 3}", b) for m in range(1000) for b in range(2) for i in range(2)]
    data += [(None, 1, "x", 0), (None, 2, None, 0), (None, 12, "x", 1), (2**60 + 1, 2**60 + 3, "y", 0), (2**60 + 1, None, None, 1), (2**60 + 1, 2**60 + 5, "y", 1)]
    rows = spark.createDataFrame(data, "media long, frame_no long, label string, _file int")

    def run(name, op):
        out = op(staged_by(spark, rows, 2))
        query = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert max(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators) < 100
        return [tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect()]

    got = run("batches", lambda s: S.frame_batches(s.select("media", "frame_no")))
    want = [(m, 0, "0,1,10") for m in range(1000)] + [(None, 0, "1,2,12"), (2**60 + 1, 0, f"{2**60 + 3},{2**60 + 5}")]
    assert collections.Counter(got) == collections.Counter(want)
    kept = [r for r in data if r[1] is not None]
    some = rows.filter("frame_no is not null")
    rows, want = some, []
    for media in {r[0] for r in kept}:
        last = None
        for m, f, label, _ in sorted((r for r in kept if r[0] == media), key=lambda r: r[1]):
            if last is None or last != label:
                want.append((m, f, label, last))
            last = label
    assert collections.Counter(run("changes", S.label_changes)) == collections.Counter(want)


def test_waiting_stills_are_merged_from_runs(spark):
    """Three batches that overlap in time, runs of 40 stills in blocks of 7: the same sequences, and what is left stays."""
    by_dir = {"a": stills(21, 300, [0, 30, 200, 499, 501, 2000], odd=True), "b": stills(22, 100, [0, 90, 400])}
    frame = frame_of(spark, by_dir)
    top = max(at for files in by_dir.values() for _, at, _ in files)
    rnd = random.Random(5)
    file = [(d, n, min(2, at * 3 // (top + 1) + rnd.choice([0, 0, 1]))) for d, files in by_dir.items() for n, at, _ in files]
    arrived = frame.join(spark.createDataFrame(file, "dir string, name string, _file int"), ["dir", "name"])
    unnamed = frame.limit(1).withColumn("name", F.lit(None).cast("string")).withColumn("_file", F.lit(0))
    stream = staged_by(spark, arrived.unionByName(unnamed.select(arrived.columns)), 3, later(frame, "taken_at"))
    got = drain_stateful(spark, frame_sequences(stream, f"{top // 1_000_000 // 2 + 2} seconds", 40, 7)).collect()
    want = collections.Counter()
    for d, files in by_dir.items():
        found = model(files)
        want.update(collections.Counter((d, s) for s, _ in found.values()).items())
    assert collections.Counter(((r.dir, r.sequence_id), r.files) for r in got) == want
