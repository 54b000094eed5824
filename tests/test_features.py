"""Keyword tables, image heads, rejected documents, models loaded once."""

import json
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaops.operators import hooks, keywords
from mediaops.sources import image_files, readers


def test_keyword_tables_equal_a_chain_of_contains(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("абвxyz"), rng.integers(1, 5)))
    listed = [(word(), int(p)) for p in rng.integers(0, 60, 200)] + [("", 0), (None, 1), ("x", None), ("yy", 2), ("yy", 50)]
    texts = [("".join(rng.choice(list("абвгxyzw "), 9)), i, "own") for i in range(300)] + [(None, 400, "own"), ("", 401, "own"), ("yy", 402, None)] * 2
    frame = spark.createDataFrame(texts, "text string, number long, p string")
    table = spark.createDataFrame(listed, "keyword string, place long")
    least = {}
    for w, p in listed:
        if w and p is not None:
            least[w] = min(p, least.get(w, p))
    order = sorted((p, w) for w, p in least.items())
    expected = sorted((i, next((w for _, w in order if w in (t or "")), "-")) for t, i, _ in texts)
    for limit in (1 << 20, 300):  # one automaton, several slices
        got = keywords.first_listed(frame, table, max_bytes=limit, text_rows=50)
        assert got.columns == ["text", "number", "p", "keyword_found"]
        assert sorted((r.number, r.keyword_found or "-") for r in got.collect()) == expected
    none = keywords.first_listed(frame, table.limit(0))
    assert none.count() == len(texts) and none.filter("keyword_found is not null").count() == 0
    assert keywords.first_listed(frame.limit(0), table).count() == 0


def test_image_heads_of_any_folder(spark, tmp_path):
    files = {"a.jpg": b"\xff\xd8\xff" + b"x" * 5000, "b/c.PNG": b"\x89PNG\r\n\x1a\n", "b/c/d/e/deep.webp": b"RIFF1234WEBPVP8 ", "b/empty.bmp": b"",
             "b/.hidden.jpg": b"x", "_skipped/a.jpg": b"x", "notes.txt": b"x", "jpg": b"x", "b/with space+%20.tiff": b"II*\0"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    wanted = {n: c for n, c in files.items() if "." in n and not n.endswith("txt") and "hidden" not in n and "_sk" not in n}
    for levels in (0, 1, 2, 5):
        got = image_files.read_image_heads(spark, str(tmp_path), levels=levels, tasks=3).collect()
        assert sorted(r.path for r in got) == sorted(f"{tmp_path}/{n}" for n in wanted)
        for r in got:
            content = wanted[r.path[len(str(tmp_path)) + 1 :]]
            assert bytes(r.header) == content[:12] and r["size"] == len(content) and f"{r.dir}/{r.name}" == r.path
    (tmp_path / "none").mkdir()
    assert image_files.read_image_heads(spark, f"{tmp_path}/none").count() == 0


def test_broken_documents_do_not_hinder_the_others(spark, tmp_path):
    good = json.dumps({"video_info": {"video_name": "m"}, "segments": [{"segment_index": 1, "transcript": "х\n\"y\""}, {"segment_index": 2}]})
    files = {"good": good, "cut": good[:-9], "none": '{"video_info": {}}', "types": '{"segments": 5}', "text": "no json", "empty_list": '{"segments": []}'}
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_text(content)
    reasons = {"cut": "malformed document", "none": "no segments", "types": "malformed document", "text": "malformed document"}

    def stem(rows):
        return {os.path.basename(r.file)[:-5]: r.reason for r in rows}

    segments, rejects = readers.read_results_and_rejects(spark, str(tmp_path))
    assert sorted((r.media, r.segment_index) for r in segments.collect()) == [("good", 1), ("good", 2)]
    found = rejects.collect()
    assert stem(found) == reasons and {r.document for r in found if "cut" in r.file} == {good[:-9]}
    streams = readers.read_results_and_rejects(spark, str(tmp_path), named=True, stream=True)
    for df, name in zip(streams, ("good_rows", "bad_rows")):
        df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert {(r.media, r.segment_index) for r in spark.table("good_rows").collect()} == {("m", 1), ("m", 2)}
    assert stem(spark.table("bad_rows").collect()) == reasons


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def predict(a, b):
            assert len(a) <= 10
            return a * 2 + b

        return predict

    rows = spark.range(0, 2000, 1, 8).select("id", F.when(F.col("id") % 3 != 0, F.col("id")).alias("a"), (F.col("id") / 2).alias("b"))
    got = hooks.score_with_model(rows, load, ["a", "b"], batch=10).collect()
    assert all(r.score == (None if r.id % 3 == 0 else pytest.approx(r.id * 2.5)) for r in got)
    loads = os.listdir(folder)
    assert 1 <= len(loads) == len({name.split("-")[0] for name in loads})  # one load for every process, of 200 batches
