"""The pipeline on a small corpus with planted cases, and on tables with awkward rows."""

import collections
import hashlib
import random

import corpus_pipeline
import pytest

from mediaops.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, labels = [], []
    for i in range(300):
        w = [word() for _ in range(rng.randrange(60, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vermin", "blockhead"]))
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, i % 2, int(toxic)))
    for i in range(1, 300, 10):
        rows.append((1000 + i, rows[i][1], "en", "s1", 0))
        w = rows[i + 1][1].split(" ")
        w[len(w) // 2] = "edited"
        rows.append((2000 + i, " ".join(w), "en", "s2", 0))
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, labels


def test_stages(spark, corpus, tmp_path):
    folder, rows, labels = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {i for i, _, t in labels if t}
    toxic |= {j for j, t, *_ in rows if any(w in t for w in ("vermin", "blockhead"))}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or out.columns == docs.columns
        kept[name] = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
        if name != "packing":
            docs = out
    everything = {r[0] for r in rows}
    assert set(kept["toxicity"]) == everything - toxic
    by_text = collections.defaultdict(list)
    for i, t, *_ in rows:
        if i not in toxic:
            by_text[t].append(i)
    assert set(kept["exact_dedup"]) == {max(g) for g in by_text.values()}
    copies = {2000 + i for i in range(1, 300, 10)}
    assert set(kept["near_dedup"]) == set(kept["exact_dedup"]) - copies
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and max(kept["mixing"].values()) <= 3
    assert set(kept["packing"]) == set(kept["mixing"])


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, None, "a", 0), (1, None, None, "a", 0), (2, "", "en", None, 0), (3, "word", None, "a", None)]])
def test_awkward_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    docs.collect()


def test_near_dedup_by_rows(spark):
    """One row of each class stays, whatever null and repeated ids there are, and no other row goes."""
    rng = random.Random(3)
    groups = []
    for _ in range(8):
        w = [f"w{rng.randrange(9000)}" for _ in range(150)]
        groups.append([" ".join(w), " ".join([*w[:-1], "edited"]), " ".join(["edited", *w[1:]])])
    a, b, c, d, e, f, g, h = groups
    rows = [(None, a[0]), (1, a[1]), (None, b[0]), (None, c[0]), (None, c[1]), (None, c[2])]  # null ids: near an id, alone, near each other
    rows += [(5, d[0]), (5, d[1]), (7, e[0]), (7, f[0]), (6, f[1]), (9, g[0]), (9, g[0]), (10, g[1])]  # repeated ids
    rows += [(7, h[0]), (8, h[1]), (None, None), (11, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    least = lambda texts: min(texts, key=lambda t: hashlib.sha256(t.encode()).digest())
    want = [(1, a[1]), (None, b[0]), (None, least(c)), (5, least(d[:2])), (7, e[0]), (6, f[1]), (9, g[0]), (7, h[0]), (11, "")]
    assert got == collections.Counter(want)


def test_a_query_for_each_operator():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)} and len(QUERIES) == 13
    assert set(ORACLES) <= set(QUERIES)
