"""Physical plans keep the shape meant for large tables."""

import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from mediaops.operators import filters, labels, rollups, search, segments
from mediaops.plans import matching
from mediaops.workloads import roles as R

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_reach_the_scan(spark):
    p = plan(filters.filter_by(R.table(spark, SF, "orders"), {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]}).select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in p or "EqualTo(o_orderstatus,F)" in p
    assert "o_totalprice" not in p.split("ReadSchema")[1].split("\n")[0]


def test_search_takes_ordered(spark):
    p = plan(search.hybrid_search(R.vectors(spark, SF), R.first_vector(spark, SF), 10))
    assert "TakeOrderedAndProject" in p and "CartesianProduct" not in p


def test_range_join_is_an_equi_join(spark):
    seg = segments.overlapping_segments(R.media(spark, SF)).select("media", "segment_index", "start_time", "end_time")
    p = plan(segments.frames_in_segments(R.boxes(spark, SF).select("media", "pos", "t"), seg))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_ranks_are_limited_before_the_shuffle(spark):
    p = plan(search.first_per_key(R.detections(spark, SF).select("media", "id", "t"), ["media"], ["t", "id"], 3))
    assert p.count("WindowGroupLimit") >= 2


def test_rollup_combines_before_the_shuffle(spark):
    p = plan(rollups.speed_statistics(R.detections(spark, SF).withColumn("speed", F.col("confidence")), ("media",)))
    assert "partial_min" in p and p.count("Exchange") <= 4


def test_labels_are_matched_where_frames_are_read(spark):
    frames = R.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    named = frames.filter("id < 5").select(F.col("id").alias("label_no"), F.col("id").cast("string").alias("label"), "embedding")
    assert "Exchange" not in plan(labels.zero_shot_labels(frames, named))
    few = {tuple(r) for r in labels.zero_shot_labels(frames, named).collect()}
    assert few == {tuple(r) for r in labels.zero_shot_labels(frames, named, max_bytes=0).collect()}


def test_cluster_rollup_reads_once(spark):
    detections = R.detections(spark, SF)
    assert plan(rollups.cluster_rollup(detections)).count("Scan parquet") == plan(detections).count("Scan parquet")


def test_best_of_tiles_equals_a_full_sort():
    rng = np.random.default_rng(1)
    queries, vectors = rng.normal(size=(40, 3)).round(1), rng.normal(size=(90, 3)).round(1)
    ids = rng.permutation(90)
    scores = np.round(queries @ vectors.T, 6)
    for k in (1, 5, 90, 200):
        got = matching._best(np.arange(40), queries, ids, vectors, k, False)
        want = [(q, ids[j], scores[q, j]) for q in range(40) for j in sorted(range(90), key=lambda j: (-scores[q, j], ids[j]))[:k]]
        assert [tuple(r) for r in got.itertuples(index=False)] == want


def test_memory_of_scores_is_bounded():
    """2,000 queries against a full block: scores are 320 MB, of which a few tiles at once are held."""
    import tracemalloc

    rng = np.random.default_rng(2)
    queries, vectors = rng.normal(size=(2000, 4)), rng.normal(size=(matching.BLOCK_ROWS, 4))
    tracemalloc.start()
    try:
        matching.best_of_block(np.arange(2000), queries, np.arange(len(vectors)), vectors, 5, True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 << 20
