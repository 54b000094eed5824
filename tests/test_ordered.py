"""Sliced scans and folds give the plain results when a key is cut into many slices."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from mediaops.operators import events, rollups, segments
from mediaops.plans import slices
from mediaops.plans.folds import budget_chunks


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(5)
    data = []
    for i in range(600):
        key = rnd.choice(["hot", "hot", "hot", "a", "b", None])
        data.append((key, float(rnd.randrange(40)), i, rnd.choice(["x", "y", None]), rnd.randrange(1, 30)))
    return spark.createDataFrame(data, "k string, t double, id long, label string, size long").cache()


def test_previous(table):
    plain = slices.with_previous(table, ["k"], ["t", "id"], ["label", "size"])
    cut = slices.with_previous(table, ["k"], ["t", "id"], ["label", "size"], max_rows=25)
    assert rows(plain) == rows(cut.select(plain.columns))


def test_one_instant_is_split(spark):
    same = spark.range(300).select(F.lit("m").alias("k"), F.lit(1.0).alias("t"), "id")
    cut, large = slices.slice_by_order(same, ["k"], ["t", "id"], 40)
    assert large
    assert cut.groupBy("_slice").count().agg(F.max("count")).first()[0] < 150
    prev = slices.with_previous(same, ["k"], ["t", "id"], ["id"], max_rows=40)
    assert all(r["prev_id"] == (r["id"] - 1 if r["id"] else None) for r in prev.collect())


def test_running_sum(table):
    plain = slices.running_sum(table, ["k"], ["t", "id"], "size", "s")
    cut = slices.running_sum(table, ["k"], ["t", "id"], "size", "s", max_rows=25)
    assert rows(plain.select("id", "s")) == rows(cut.select("id", "s"))


def test_modes(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (2, "a"), (3, None)], "k int, v string")
    got = {r["k"]: r["common_v"] for r in slices.modes_by(df, ["k"], ["v"]).collect()}
    assert got == {1: "a", 2: "c"}


@pytest.mark.parametrize("budget", [20, 100, 900])
def test_budget_chunks(table, budget):
    x = slices.running_sum(table, ["k"], ["t", "id"], "size", "reach").withColumn("enter", F.col("reach") - F.col("size"))
    plain = budget_chunks(x, ["k"], ["t", "id"], "enter", "reach", budget)
    cut = budget_chunks(x, ["k"], ["t", "id"], "enter", "reach", budget, max_rows=25)
    assert rows(plain) == rows(cut)
    seen = {}
    for r in sorted(plain.collect(), key=lambda r: (str(r["k"]), r["t"], r["id"])):
        used, chunk = seen.get(r["k"], (0, -1))
        if chunk < 0 or used + r["size"] > budget:
            used, chunk = 0, chunk + 1
        seen[r["k"]] = (used + r["size"], chunk)
        assert r["chunk"] == chunk


def speech_model(utterances, duration):
    """Plain loop over (start, end, text) of one media."""
    out = []

    def silence(a, b, back):
        while a < b:
            e = min(a + 40, b)
            out.append((round(a, 3), round(e, 3), "silence", None))
            if e >= b:
                break
            a = e - back

    if not utterances:
        silence(0.0, duration, 0)
        return sorted(out, key=str)
    i, now = 0, 0.0
    if utterances[0][0] > 40:
        silence(0.0, utterances[0][0], 5)
        now = utterances[0][0]
    while i < len(utterances):
        begin, end, texts = now, now, []
        while i < len(utterances):
            s, e, t = utterances[i]
            if texts and e - begin > 40:
                break
            texts.append(t)
            end, i = e, i + 1
            if e - begin > 40:
                break
            if i < len(utterances) and utterances[i][0] - end > 3:
                if utterances[i][0] - begin > 40:
                    break
                end = utterances[i][0]
        out.append((round(begin, 3), round(end, 3), "speech", " ".join(texts)))
        now = end
        if i < len(utterances) and utterances[i][0] > now:
            silence(now, utterances[i][0], 10)
            now = utterances[i][0]
    if now < duration:
        out.append((round(now, 3), round(duration, 3), "silence", None))
    return sorted(out, key=str)


def test_speech_segments(spark):
    rnd = random.Random(3)
    media, data, want = [], [], {}
    for m in range(30):
        t, utts = rnd.choice([0.0, 2.0, 20.0, 130.0]), []
        for _ in range(rnd.randrange(0, 40)):
            length = rnd.choice([1.0, 4.5, 12.0, 39.0, 41.0, 70.0])
            utts.append((t, t + length, f"w{len(utts)}"))
            t += length + rnd.choice([0.0, 0.5, 2.0, 3.0, 3.5, 9.0, 45.0, 120.0])
        duration = t + rnd.choice([0.0, 5.0])
        media.append((m, duration))
        data += [(m, i, *u) for i, u in enumerate(utts)]
        want[m] = speech_model(utts, duration)
    u = spark.createDataFrame(data, "media long, pos long, start double, end double, text string")
    d = spark.createDataFrame(media, "media long, duration double")
    for max_rows in (slices.MAX_GROUP_ROWS, 7):
        got = {m: [] for m, _ in media}
        for r in segments.speech_segments(u, d, max_rows=max_rows).collect():
            got[r["media"]].append((round(r["start_time"], 3), round(r["end_time"], 3), r["kind"], r["text"]))
        assert {m: sorted(v, key=str) for m, v in got.items()} == want


def test_alerts_cut(spark):
    rnd = random.Random(9)
    data = [(m, i, rnd.random() < 0.5) for m in range(3) for i in range(rnd.randrange(50, 200))]
    df = spark.createDataFrame(data, "media long, segment_index long, degraded boolean")
    want, count, last = [], 0, None
    for m, i, bad in data:
        count = count if m == last else 0
        last = m
        if (i + 1) % 40 == 0:
            want.append((m, i, "interval"))
        elif count >= 3:
            want.append((m, i, "degraded"))
            count = 0
        count += bad
    assert rows(events.restart_alerts(df)) == sorted(want)
    assert rows(events.restart_alerts(df, max_rows=30)) == sorted(want)


def test_crowded_second_among_ordinary_ones(spark):
    """200 seconds of 6 rows and one of 30,000: one row each, and contexts as if nothing were crowded."""
    ordinary = spark.range(1200).select((F.col("id") % 200).alias("s"), "id")
    crowded = spark.range(5000, 35_000).select(F.lit(500).cast("long").alias("s"), "id")

    def detections(rows):
        return rows.select(
            F.lit(1).alias("media"), F.col("s").cast("double").alias("t"), "id", F.col("id").alias("frame_no"), F.lit(0).alias("pos"),
            F.concat(F.lit("c"), F.col("id") % 7).alias("label"), F.lit(0.5).alias("confidence"), F.lit(1).alias("cx"), F.lit(2).alias("cy"),
        )

    def contexts(rows):
        found = events.object_events(detections(rows))
        assert found.groupBy("media", "second").count().filter("count > 1").isEmpty() and "part" not in found.columns
        people = found.withColumnRenamed("objects", "entities")
        texts = found.withColumnRenamed("objects", "texts")
        frames = found.select("media", "timestamp")
        return {(r["timestamp"], r["context"]) for r in rollups.frame_context(frames, found, people, texts).collect()}

    alone, both = contexts(ordinary), contexts(ordinary.union(crowded))
    assert len(alone) == 200 and len(both) == 201 and alone < both
    got = events.vehicle_events(detections(crowded)).collect()
    assert len(got) == 1 and got[0]["count"] == 30_000 and len(got[0]["vehicle_types"].split(",")) == 30_000


def test_restart_alerts_at_every_interval(spark):
    data = [(1, i, True) for i in range(60)]
    df = spark.createDataFrame(data, "media long, segment_index long, degraded boolean")
    assert rows(events.restart_alerts(df, interval=1)) == rows(events.restart_alerts(df, interval=1, max_rows=9))


def test_segments_of_a_35_minute_media(spark):
    m = spark.createDataFrame([(1, 2100.0), (2, 35.0), (3, 0.0), (4, 36.0)], "media int, duration double")
    got = segments.overlapping_segments(m).groupBy("media").agg(F.count("*").alias("n"), F.max("end_time").alias("e"))
    assert {(r["media"], r["n"], r["e"]) for r in got.collect()} == {(1, 60, 2100.0), (2, 1, 35.0), (4, 2, 36.0)}


def test_clean_repetitive(spark):
    texts = ["a a a a a a b", "hello there", " hello there ", "", "x", "hello there", "a a a a b b b"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "media int, pos int, text string")
    assert [r["pos"] for r in segments.clean_repetitive(df).orderBy("pos").collect()] == [1, 4, 5, 6]
    assert [r["pos"] for r in segments.clean_repetitive(df, max_rows=2).orderBy("pos").collect()] == [1, 4, 5, 6]


def test_speech_segments_of_overlapping_utterances_do_not_depend_on_slices(spark):
    """200 media with long utterances before short ones: the sliced layout agrees with the plain one."""
    rnd = random.Random(12)
    data = []
    for m in range(200):
        for p in range(rnd.randrange(1, 40)):
            start = round(rnd.uniform(0, 150), 1)
            data.append((m, p, start, round(start + rnd.choice([1, 3, 8, 90]) * rnd.random(), 2), f"t{p}"))
    utterances = spark.createDataFrame(data, "media long, pos long, start double, end double, text string")
    media = spark.range(200).select(F.col("id").alias("media"), F.lit(200.0).alias("duration"))
    plain = rows(segments.speech_segments(utterances, media))
    assert len(plain) > 1000 and rows(segments.speech_segments(utterances, media, max_rows=6)) == plain
