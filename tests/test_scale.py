"""Rows, plans and files that only larger tables bring to light."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaops.operators import clustering, responses, segments, sequences, tables
from mediaops.plans import slices
from mediaops.workloads import roles as R
from mediaops.workloads import storing

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_generated_segments_are_not_broadcast(spark):
    """Their size is taken for that of the media they come from, so nothing but a hint keeps them off the driver."""
    windows = segments.overlapping_segments(R.media(spark, SF)).select("media", "segment_index", "start_time", "end_time")
    assert "BroadcastHashJoin" not in plan(segments.frames_in_segments(R.boxes(spark, SF).select("media", "pos", "t"), windows))
    media = spark.createDataFrame([(1, 500.0), (2, 90.0)], "media long, duration double")
    frames = spark.createDataFrame([(1, 7, 36.2), (1, 8, 499.0), (2, 9, 10.0)], "media long, pos long, t double")
    rows = segments.frames_in_segments(frames, segments.overlapping_segments(media))
    assert sorted((r.pos, r.segment_index) for r in rows.collect()) == [(7, 0), (7, 1), (8, 13), (8, 14), (9, 0)]


def test_rounds_name_a_media_by_text(spark):
    """Blocks of which nothing is left to compare give no rows, whatever the type of the media."""
    rng = np.random.default_rng(3)
    rows = [("a", i, rng.normal(size=6).tolist()) for i in range(90)]
    points = spark.createDataFrame([(m, i, v, 1) for m, i, v in rows], "media string, cid long, vec array<double>, size long")
    found = clustering._merge_rounds(points, 0.6, 8).select("cid", "root").collect()
    got = dict(tuple(r) for r in found)
    vectors = np.array([v for _, _, v in rows])
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert [got[i] for i in range(90)] == clustering._linkage(units, np.ones(90), 0.6).tolist()


def linked(spark, monkeypatch, vectors, sizes, cut, group_rows):
    """Tables that the rounds write, after their roots have been compared with those of the matrix."""
    written = []
    monkeypatch.setattr(clustering, "cut_lineage", lambda df, cut=clustering.cut_lineage: written.append(df) or cut(df))
    points = [("a", i, [float(x) for x in v], int(n)) for i, (v, n) in enumerate(zip(vectors, sizes))]
    points = spark.createDataFrame(points, "media string, cid long, vec array<double>, size long")
    got = dict(tuple(r) for r in clustering._merge_rounds(points, cut, group_rows).select("cid", "root").collect())
    want = clustering._linkage(vectors * sizes[:, None], sizes, cut)
    assert [got[i] for i in range(len(vectors))] == want.tolist() and len(set(want)) < len(want)
    return len(written)


def test_final_clusters_leave_the_rounds(spark, monkeypatch):
    """What nothing is near to is compared once; the rest fits a group, so what a hub takes one by one are no rounds."""
    axes = np.eye(40)
    c = np.linspace(0.95, 0.7, 12)[:, None]
    vectors = np.vstack([axes[:1], c * axes[:1] + np.sqrt(1 - c**2) * axes[1:13], -axes])
    assert linked(spark, monkeypatch, vectors, np.array([500.0] + [1.0] * 52), 0.5, 20) < 20


def test_a_hub_makes_no_round_per_merge(spark, monkeypatch):
    """All clusters can merge still and are too many for a matrix, but a round merges few of them."""
    monkeypatch.setattr(clustering, "SLOW", 20, raising=False)
    rng, around = np.random.default_rng(2), []
    while len(around) < 24:
        v = rng.normal(size=7)
        v /= np.linalg.norm(v)
        if all(v @ w < 0.4 for w in around):
            around.append(v)
    c = np.linspace(0.8, 0.75, 24)[:, None]
    vectors = np.vstack([np.eye(8)[:1], np.hstack([c, np.sqrt(1 - c**2) * np.array(around)])])
    assert linked(spark, monkeypatch, vectors, np.array([500.0] + [1.0] * 24), 0.5, 15) < 20


def test_linkage_without_a_matrix():
    rng = np.random.default_rng(4)
    for n, width, cut in ((1, 3, 0.5), (2, 3, 2.1), (60, 3, 1.2), (200, 8, 0.6), (300, 30, 0.9)):
        sums, sizes = rng.normal(size=(n, width)) + 0.2, rng.integers(1, 4, n).astype(float)
        sums *= (sizes / np.linalg.norm(sums, axis=1))[:, None]
        found, merges = [], ([], [])
        for link, kept in zip((clustering._linkage, clustering._linkage_by_means), merges):
            found.append(link(sums, sizes, cut, kept).tolist())
        assert found[0] == found[1] and [m[:2] for m in merges[0]] == [m[:2] for m in merges[1]]
        assert np.allclose([m[2:] for m in merges[0]], [m[2:] for m in merges[1]], atol=1e-11)


def test_texts_do_not_meet_their_neighbours(spark):
    docs = spark.createDataFrame([("a", 0, " same words "), ("a", 1, "same words"), ("a", 2, "other")], "media string, pos long, text string")
    rows = segments.clean_repetitive(docs).select("media", "pos")
    assert sorted(r.pos for r in rows.collect()) == [0, 2]
    sent = plan(rows).split("Exchange hashpartitioning(media")[1].split("\n")[1]
    assert "sha2" in sent


def test_flags_of_neighbours(spark):
    texts = ["", "", "a description that is long enough", "a description that is long enough", "汉 a description that is long enough", None]
    rows = spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "media string, segment_index long, response string")
    rows = rows.withColumn("analysis", F.struct(
        F.col("response").alias("description"), F.lit("high").alias("confidence"), F.array().cast("array<string>").alias("keywords"),
        F.col("response").alias("search_terms"),
    ))
    for max_rows in (100, 2):
        found = responses.quality_flags(rows, max_rows=max_rows).orderBy("segment_index")
        got = [r["flags"] for r in found.collect()]
        short = ["short_description", "empty_required_fields"]
        assert got == [short, short, [], ["duplicate_description"], ["chinese_characters"], short]
    moved = plan(responses.quality_flags(rows).select("media", "segment_index", "flags")).split("Exchange hashpartitioning(media")[0]
    assert "response#" not in moved


def test_slices_of_stills_are_bounded(spark, monkeypatch):
    """A task holds a slice of a large directory, not a share of the table that grows with it."""
    cut = []
    monkeypatch.setattr(sequences, "SLICE_STILLS", 10)
    monkeypatch.setattr(sequences, "slice_by_order", lambda df, keys, order, rows, large: cut.append(rows) or slices.slice_by_order(df, keys, order, rows, large))
    start = datetime.datetime(2025, 1, 1)
    stills = spark.createDataFrame(
        [("d", f"{i:03d}", start + datetime.timedelta(milliseconds=200 * i), i % 4 + 1) for i in range(60)], "dir string, name string, taken_at timestamp, frame_no long"
    )
    got = {tuple(r) for r in sequences.build_sequences(stills, max_rows=30).collect()}
    assert cut == [10] and got == {tuple(r) for r in sequences.build_sequences(stills).collect()}


@pytest.mark.parametrize("name", ["x17_run_log", "s4_file_listing", "s1_result_files", "s1_good_documents", "s1_rejected_documents"])
def test_files_are_not_moved_by_a_committer(spark, tmp_path, monkeypatch, name):
    """Spark's writer opens and moves a file per folder one by one; as many folders as media are written by the tasks."""
    from pyspark.sql import DataFrameWriter

    def refuse(self, *columns):
        raise AssertionError(f"a folder for each value of {columns}")

    monkeypatch.setattr(DataFrameWriter, "partitionBy", refuse)
    from mediaops.workloads.registry import QUERIES

    assert QUERIES[name](spark, SF).count() > 0


def test_files_in_folders(spark, tmp_path):
    docs = spark.createDataFrame([(1, "eins\nzwei"), (None, "è"), (3, "")], "media long, value string")
    storing.write_in_folders(docs, str(tmp_path / "out"))
    found = {p.parent.name: p.read_bytes() for p in (tmp_path / "out").glob("*/*")}
    assert found == {"media=1": "eins\nzwei\n".encode(), "media=__HIVE_DEFAULT_PARTITION__": "è\n".encode(), "media=3": b"\n"}


def test_first_rows_of_inverted_lists_are_not_repeated_in_memory(spark):
    """Each batch is given on once per list that is asked, so what Python holds does not grow with the lists."""
    from mediaops.operators import inverted_lists as IL

    v = R.vectors(spark, SF).select("id", "embedding")
    centres = IL.fit_centres(v)
    stored = IL.to_lists(v, centres)
    found = IL.knn_join_lists(v, stored, centres, 3, len(centres.matrix), other_only=True)
    from mediaops.operators import search

    exact = search.knn_join(v, v, 3, other_only=True)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in exact.select(found.columns).collect()}


def test_deleting_many_media_keeps_its_tasks(spark):
    """Rows meet a list of media in all tasks of the shuffle, not in one per core, and are not sorted for it."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k, None) for k in names}
    rows = spark.createDataFrame([(i % 50 if i % 7 else None, i) for i in range(400)], "media long, x long")
    listed = spark.createDataFrame([(i % 20 if i % 5 else None,) for i in range(100)], "media long")
    statuses = rows.select("media", F.lit("completed").alias("phase2_status"))
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        kept = tables.delete_media({"rows": rows}, listed)[0]["rows"]
        again = tables.reset_media(statuses, listed, F.lit("2024-01-01").cast("timestamp"))
        assert [df.rdd.getNumPartitions() for df in (kept, again)] == [24, 24]
        assert all("Sort [" not in df._jdf.queryExecution().executedPlan().toString() for df in (kept, again))
        gone = {i % 20 for i in range(100) if i % 5}
        want = {i for i in range(400) if not i % 7 or i % 50 not in gone}
        assert sorted(r.x for r in kept.select("x").collect()) == sorted(want) and again.count() == 400
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
