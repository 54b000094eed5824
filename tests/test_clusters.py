"""Clustering and nearest vectors against brute force, in bounded groups and in rounds."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from mediaops.operators import clustering as C
from mediaops.operators import inverted_lists as IL
from mediaops.operators import search
from mediaops.plans.components import connected
from mediaops.streaming import stateful as S
from mediaops.workloads.live import drain_stateful, staged


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 8))
    data = []
    for i in range(180):
        media = "hot" if i % 3 else f"m{i % 4}"
        v = centres[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.0, 0.3, 0.8])
        if i in (5, 77, 78):
            v = np.zeros(8)
        data.append((media, i, float(i // 2), [float(x) for x in np.round(v, 4)]))
    return data


@pytest.fixture(scope="module")
def table(spark, vectors):
    return spark.createDataFrame(vectors, "media string, id long, t double, embedding array<double>").cache()


def unit(v):
    v = np.asarray(v)
    n = np.linalg.norm(v)
    return v / n if n else v


def online_model(data, threshold, policy):
    out, known = [], {}
    for media, i, t, v in sorted(data, key=lambda r: (r[2], r[1])):
        ents = known.setdefault(media, [])
        sims = [round(float(unit(v) @ e), 12) for e in ents]
        fits = [k for k, s in enumerate(sims) if s >= threshold]
        if not fits:
            ents.append(unit(v))
            out.append((media, i, len(ents)))
        else:
            k = fits[0] if policy == "first" else max(fits, key=lambda k: (sims[k], -k))
            out.append((media, i, k + 1))
    return sorted(out)


@pytest.mark.parametrize("policy", ["best", "first"])
@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_online(table, vectors, policy, threshold):
    want = online_model(vectors, threshold, policy)
    assert rows(C.online_clusters(table, threshold, policy)) == want
    assert rows(C.online_clusters(table, threshold, policy, group_rows=40, leaders_per_round=4)) == want


def linkage_model(data, cut):
    out = []
    for media in {r[0] for r in data}:
        groups = [[(i, unit(v))] for m, i, _, v in data if m == media]
        while len(groups) > 1:
            best = min(
                (np.mean([round(1 - float(a @ b), 12) for _, a in x for _, b in y]), p, q)
                for p, x in enumerate(groups) for q, y in enumerate(groups) if p < q
            )
            if not best[0] < cut - 1e-9:
                break
            groups[best[1]] += groups.pop(best[2])
        for no, g in enumerate(sorted(groups, key=lambda g: min(i for i, _ in g))):
            out += [(media, i, no) for i, _ in g]
    return sorted(out)


@pytest.mark.parametrize("cut", [0.1, 0.3, 0.6])
def test_linkage(table, vectors, cut):
    want = linkage_model(vectors, cut)
    assert rows(C.linkage_clusters(table, cut)) == want
    assert rows(C.linkage_clusters(table, cut, group_rows=25)) == want


def test_single_member_and_copies(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.0, [1.0, 0.0])] + [("b", i, 0.0, [0.0, 1.0]) for i in range(2, 40)],
        "media string, id long, t double, embedding array<double>",
    )
    assert {r["cluster_no"] for r in C.linkage_clusters(df, 0.3, group_rows=5).collect()} == {0}


def test_documented_contingency(spark):
    sizes = [("p06", "b01", 6), ("p16", "b01", 2), ("p05", "b09", 1), ("p14", "b09", 3), ("p05", "b14", 4)]
    data = [("m", a, b) for a, b, n in sizes for _ in range(n)]
    cells = C.compare_labels(spark.createDataFrame(data, "media string, x string, y string"), "x", "y")
    got = {(r["first"], r["second"]): (r["n"], r["split"], r["merged"]) for r in cells.collect()}
    assert got[("p06", "b01")] == (6, False, True) and got[("p05", "b14")] == (4, True, False)
    assert got[("p05", "b09")] == (1, True, True)


def test_knn_layouts_agree(table, vectors):
    v = table.select("id", "embedding")
    near = search.knn_join(v, v, 4, other_only=True)
    blocks = search.knn_join(v, v, 4, other_only=True, broadcast_queries=10, block_rows=33)
    cols = ["query_id", "match_id", "score", "rank"]
    assert rows(near.select(cols)) == rows(blocks.select(cols))
    want = []
    for _, i, _, a in vectors:
        sims = sorted((-round(float(unit(a) @ unit(b)), 6), j) for _, j, _, b in vectors if i != j)
        want += [(i, j, -s, r + 1) for r, (s, j) in enumerate(sims[:4])]
    assert [(a, b, d) for a, b, _, d in rows(near.select(cols))] == [(a, b, d) for a, b, _, d in sorted(want)]


def grouped_vectors(groups, count, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    return [(i, (centre[rng.integers(groups)] + 0.35 * rng.normal(size=dim)).tolist()) for i in range(count)]


def recall_of(exact, found):
    pairs = [{(r["query_id"], r["match_id"]) for r in x.collect()} for x in (exact, found)]
    return len(pairs[0] & pairs[1]) / len(pairs[0])


@pytest.mark.parametrize("count", [1500, 6000])
def test_inverted_lists_find_most_in_a_fifth(spark, tmp_path, count):
    v = spark.createDataFrame(grouped_vectors(30, count), "id long, embedding array<double>").repartition(4)
    IL.save_lists(v, IL.fit_centres(v), str(tmp_path / "lists"))
    stored, centres = IL.load_lists(spark, str(tmp_path / "lists"))
    probes = IL.tune_probes(stored, centres, 5)
    queries = v.filter("id % 10 = 0")
    found = IL.knn_join_lists(queries, stored, centres, 5, probes, other_only=True, block_rows=100)
    assert recall_of(search.knn_join(queries, v, 5, other_only=True), found) >= 0.9
    sizes = dict(stored.groupBy("list_no").count().collect())
    near = centres.nearest(np.array([unit(r.embedding) for r in queries.collect()]), probes)
    assert sum(sizes[n] for row in near.tolist() for n in row) <= 0.2 * count * len(near)
    whole = IL.knn_join_lists(queries, stored, centres, 5, len(centres.matrix), other_only=True)
    assert rows(whole) == rows(search.knn_join(queries, v, 5, other_only=True))
    query = grouped_vectors(30, 1)[0][1]
    some = IL.probe(stored, centres, query, probes)
    assert rows(search.nearest_to(some.drop("list_no"), query, 5)) == rows(search.nearest_to(v, query, 5))


def test_inverted_lists_odd_rows(spark):
    """Nulls, zero vectors and many copies: nothing is lost, blocks split the crowded list."""
    data = [(i, [1.0, 0.0, 0.0]) for i in range(50)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [0.0, 1.0, 0.0]), (63, [0.0, 0.9, 0.1])]
    v = spark.createDataFrame(data, "id long, embedding array<double>")
    centres = IL.fit_centres(v, lists=3)
    stored = IL.to_lists(v, centres)
    assert stored.count() == 54 and {r.list_no for r in stored.filter("id in (60, 61)").collect()} == {0}
    found = IL.knn_join_lists(v, stored, centres, 2, len(centres.matrix), other_only=True, block_rows=7)
    assert rows(found) == rows(search.knn_join(v, v, 2, other_only=True))
    nothing = v.limit(0)
    assert IL.knn_join_lists(v, IL.to_lists(nothing, centres), centres, 2, 1).count() == 0
    assert len(IL.fit_centres(nothing).matrix) == 1 and IL.tune_probes(stored.limit(0), centres, 3) == 1


@pytest.mark.parametrize("group_rows", [10**6, 25])
def test_one_tree_gives_every_cut(table, vectors, group_rows):
    tree, cuts = C.linkage_tree(table, 0.7, group_rows=group_rows), (0.1, 0.3, 0.6) if group_rows > 25 else (0.3,)
    for cut in cuts:
        assert rows(C.cut_tree(tree, cut)) == linkage_model(vectors, cut)
    sweep = C.threshold_sweep(table, cuts, group_rows=group_rows)
    want = []
    for cut in cuts:
        found = linkage_model(vectors, cut)
        want += [(cut, m, len({no for x, _, no in found if x == m}), sum(x == m for x, _, _ in found)) for m in {x for x, _, _ in found}]
    assert rows(sweep) == sorted(want)
    heights = {(r["media"], r["id"]): r for r in tree.collect()}
    for r in heights.values():  # heights do not fall towards the root
        above = heights.get((r["media"], r["parent"]))
        assert r["parent"] is None or above["height"] is None or above["height"] >= r["height"] - 1e-12


def test_components(spark):
    edges = [("a", i, i + 1) for i in range(40)] + [("a", 100, 90), ("a", 90, 95), ("b", 5, 1), ("b", 7, 7)] + [("b", 1000, i) for i in range(200, 260)]
    frame = spark.createDataFrame(edges, "media string, a long, b long").repartition(4)
    got = {(r.media, r.node): r.component for r in connected(frame, ["media"]).collect()}
    want = {("a", i): 0 for i in range(41)} | {("a", i): 90 for i in (90, 95, 100)} | {("b", 5): 1, ("b", 1): 1, ("b", 7): 7}
    assert got == want | {("b", i): 200 for i in [*range(200, 260), 1000]}


def test_stream_equals_batch(spark, vectors):
    media = {"hot": 0, "m0": 1, "m1": 2, "m2": 3, "m3": 4}
    df = spark.createDataFrame(
        [(media[m], i, t, v) for m, i, t, v in vectors], "media long, id long, t double, embedding array<double>"
    )
    assert rows(drain_stateful(spark, S.online_clusters(staged(spark, df, "t", 3), 0.6))) == rows(C.online_clusters(df, 0.6))


def test_search_edges(spark):
    df = spark.createDataFrame(
        [(1, [0.0, 0.0], None), (2, [1.0, 0.0], [0.0, 2.0]), (3, [2.0, 0.0], None)],
        "id long, embedding array<double>, search_terms_embedding array<double>",
    ).withColumn("media", F.lit("m")).withColumn("confidence", F.lit("high"))
    got = [(r["id"], r["relevance_score"]) for r in search.hybrid_search(df, [1.0, 0.0]).collect()]
    assert got == [(3, 1.0), (2, 0.5), (1, 0.0)]
    assert search.hybrid_search(df, None).count() == 0
