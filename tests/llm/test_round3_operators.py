"""Ranked search, spelling variants and WARC archives against brute force, with nulls, ties and repeated rows."""

import collections
import gzip
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from test_operators import SCHEMA, awkward, rows_of

from mediaops.llm import lexical_search, warc
from mediaops.llm.fm_index import BidirectionalIndex, one_error, suffix_array
from mediaops.llm.lexical_search import Corpus, Shard, op11_lexical_search, rank_documents
from mediaops.llm.spelling import crc32_after, near_words, op12_spelling_variants, spelling_variants
from mediaops.llm.warc import (
    inflate, mark_revisits, normalise, op13_warc, pages_through_archives, parse_head, read_pages, split_records, write_monolithic,
)
from mediaops.plans.staging import cut_lineage, scratch_folder

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def ranked(docs, items, k=10):
    terms = [collections.Counter(TERM.findall(lower(t or ""))) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for c in terms for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c, n in zip(docs, terms, sizes):
            m = 100 - 90 + (90 * n * n_docs) // max(n_terms, 1)
            wanted = set(TERM.findall(lower(text or ""))) & set(c)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return collections.Counter(out)


def made_docs(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, weight, k=rng.randrange(1, 60)))) for i in range(n)]


def test_ranking(spark, monkeypatch):
    docs = [(i, t) for i, t, _ in awkward()] + made_docs(300)
    items = [(1, "w1 w2 w3 W4, w250"), (2, None), (3, ""), (4, "nothing-known-here"), (5, "the of and the"), (5, "shared1 shared2 x"),
             (None, "same text here"), (6, "id with two texts"), (7, "w1 w2 w3 W4, w250"), (8, "日本 dé ü zz'z"), (9, awkward()[3][1])]
    frame = spark.createDataFrame(rows_of([(i, t, "a") for i, t in docs]), SCHEMA).repartition(7)
    asked = spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id long, text string, doc_id long, score long")
    want = ranked(docs, items)
    got = rank_documents(frame, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == want
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 100)  # read when the plan is made; many shards, many blocks
    assert collections.Counter(map(tuple, rank_documents(frame, asked, block_terms=1500).collect())) == want
    assert rank_documents(frame.limit(0), asked).count() == 0 and rank_documents(frame, asked.limit(0)).count() == 0


def test_pair_bounds_skip_and_change_nothing():
    """Two frequent terms that never stand together: their pair bound is the larger one, not the sum."""
    rng = np.random.default_rng(0)
    n = 2000
    has = {0: np.arange(0, n, 2), 1: np.arange(1, n, 2), 2: np.sort(rng.choice(n, 400, replace=False))}
    row = {"doc_ids": list(range(n)), "lengths": np.full(n, 50, np.int64).tobytes(), "terms": [0, 1, 2], "counts": [len(has[t]) for t in range(3)],
           "docs": np.concatenate([has[t] for t in range(3)]).astype(np.int32).tobytes(),
           "tfs": rng.integers(1, 9, sum(map(len, has.values()))).tobytes()}
    corpus = Corpus.of(n, 50 * n, np.array([len(has[t]) for t in range(3)]), [np.array([0, 1, 2])])
    assert corpus.pairs
    added = Shard(row, corpus, 10).with_pairs()
    full = row | dict(zip(["impacts", "tops", "term_kth", "pair_ids", "joint", "alone", "pair_kth", "members"], added))
    plain, paired, single = (Shard(full, corpus, 10) for _ in range(3))
    docs, scores = plain.best(0, 0)
    theta = int(np.sort(scores)[-10])
    with_pairs, without = paired.best(0, theta), single.best(0, theta, pair_bounds=False)
    assert with_pairs[0].tolist() == without[0].tolist() == docs[scores >= theta].tolist()
    assert paired.scored < single.scored <= plain.scored


def brute_words(docs):
    n = collections.Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            n[word] += len(word) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute_variants(docs):
    n = brute_words(docs)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return collections.Counter(out)


def spelled(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeé", k=rng.randrange(4, 9))) for _ in range(40)] + ["x" * 7_000, "Ünïcode×÷", "aaaaaa", "aaaaaaa", "aaaaa"]
    words = list(base)
    for w in base[:40] + ["aaaaaa"]:
        at = rng.randrange(len(w))
        words += [w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "z" + w[at + 1 :]]
    docs = [(rng.choice([i, None, 7]), " ".join(rng.choices(words[:40] + words[41:], k=rng.randrange(0, 200)))) for i in range(60)]
    docs += [(200 + i, "kettle " * 3 + "kettles " * 7 + "kettlesx " * 20) for i in range(4)]
    return [*docs, (100, "x" * 7_000 + ", " + "x" * 7_000 + " y" + "x" * 6_999), (101, "x" * 7_000), (102, "y" + "x" * 6_999 + " Y" + "x" * 6_999)]


def test_spelling(spark):
    docs = [(i, t) for i, t, _ in awkward()] + spelled()
    frame = spark.createDataFrame(rows_of([(i, t, "a") for i, t in docs]), SCHEMA).repartition(5)
    want = brute_variants(docs)
    assert any(form for _, form, *_ in want) and any(root != form for _, form, root, *_ in want if form)
    got = spelling_variants(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert collections.Counter(map(tuple, got.collect())) == want
    assert collections.Counter(map(tuple, spelling_variants(frame, shard_words=2).collect())) == want  # crowded keys, many deals
    assert spelling_variants(frame.limit(0)).count() == 0


def test_words_that_share_an_end_are_dealt_as_a_grid(spark):
    words = [("prefix" + a + b + c, 1) for a in "abcdef" for b in "abcdef" for c in "abcdef"]
    frame = cut_lineage(spark.createDataFrame(words, "word string, n long"))
    want = {(w, v) for w, _ in words for v, _ in words if one_edit(w, v)}
    got = near_words(frame, shard_words=10).collect()
    assert len(got) == len(want) and {(r.word, r.near) for r in got} == want


def test_fm_index():
    rng = random.Random(0)
    for letters, count in (("ab", 40), ("abcdefgß", 200), ("z", 6)):
        words = sorted({"".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(count)})
        index = BidirectionalIndex(words)
        patterns = words + ["".join(rng.choices(letters + "q", k=rng.randrange(2, 9))) for _ in range(50)]
        for change in (-1, 0, 1):
            met = []
            for left in (True, False):
                q, w = one_error(index, patterns, np.full(len(patterns), change), left)
                pairs = list(zip(q.tolist(), w.tolist()))
                assert len(pairs) == len(set(pairs))
                met += pairs
            want = {(i, j) for i, p in enumerate(patterns) for j, v in enumerate(words) if len(v) - len(p) == change and one_edit(p, v)}
            assert set(met) == want
    text = np.array([1, 2, 3, 1, 2, 3, 1, 2, 1] * 30 + [0])
    suffixes = [text[i:].tolist() for i in range(len(text))]
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: suffixes[i])


def test_checksums():
    data = ("é" * 40 + "abc" + "long" * 50 + "z").encode()
    arr, rng = np.frombuffer(data, np.uint8), random.Random(1)
    spans = [sorted(rng.sample(range(len(data) + 1), 2)) for _ in range(300)] + [[5, 5]]
    prefix = [zlib.crc32(str(i).encode()) for i in range(len(spans))]
    got = crc32_after(np.array(prefix), arr, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert got.tolist() == [zlib.crc32(data[a:b], p) for (a, b), p in zip(spans, prefix)]


def pages():
    big, huge = "<p>é</p>" * 200, "x\r\n\r\ny" * 300_000
    rows = [(1, "http://a/ b\tc", big), (2, None, big), (3, "http://a", big + "!"), (None, "n", big), (4, "s", "small"), (5, "s", "small"), (6, "e", None)]
    rows += [(7, "e", ""), (8, "h", huge), (9, "h", huge), (10, "r", "r" * 1000), (10, "q", "r" * 1000), (11, "l", "l" * 999), (12, "l", "l" * 999)]
    rows += [(None, "m", "m" * 2000), (None, "m", "m" * 2000)] + [(100 + i, f"u{i}", "hot " * 300) for i in range(200)]
    return rows


PAGES = "page_id long, url string, html string, payload string, digest string, same int, salt int, best long"


def brute_pages():
    best = {}
    for i, _, h in pages():
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in pages():
        raw = (h or "").encode()
        again = len(raw) >= 1000 and best[h or ""] != (-1 if i is None else i)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best[h or ""] if again else None))
    return collections.Counter(out)


@pytest.fixture
def page_frame(spark):
    return spark.createDataFrame([(*r, "p", "d", 1, 2, 3) for r in pages()], PAGES).repartition(3)


def test_archives(spark, page_frame):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = pages_through_archives(page_frame, scratch_folder(spark)).select(*cols)
    assert collections.Counter(map(tuple, got.collect())) == brute_pages()
    shuffled = mark_revisits(page_frame, max_broadcast=0).select("page_id", "record_type", "refers_to").collect()
    assert collections.Counter(map(tuple, shuffled)) == collections.Counter((r[0], r[3], r[4]) for r in brute_pages().elements())
    assert pages_through_archives(page_frame.limit(0), scratch_folder(spark)).count() == 0


def test_archives_in_depth(spark, page_frame):
    """Files on disk: one gzip stream before, a member per record after; the sidecar tells where each record stands."""
    folder = scratch_folder(spark)
    written = write_monolithic(mark_revisits(page_frame), f"{folder}/a", archive_bytes=500_000)
    done = normalise(written, f"{folder}/b")
    assert written.count() == done.count() > 3
    local = lambda p: re.sub("^file:/+", "/", p)
    for r in written.collect():
        tool = zlib.decompressobj(31)
        tool.decompress(open(local(r.archive), "rb").read())
        assert tool.eof and not tool.unused_data
    records = 0
    for r in done.collect():
        data = open(local(r.archive), "rb").read()
        lines = [x.split("\t") for x in open(local(r.sidecar)).read().splitlines()]
        assert sum(int(x[1]) for x in lines) == len(data) == r.n_bytes and len(lines) == r.n_records
        for offset, length, kind, name, digest, target in lines:
            member = gzip.decompress(data[int(offset) : int(offset) + int(length)])
            fields = parse_head(member[: member.index(b"\r\n\r\n")])
            assert (fields["warc-type"], fields["warc-record-id"]) == (kind, name)
            records += kind != "warcinfo"
    assert records == len(pages())
    small = read_pages(done, slice_bytes=1000).collect()
    by = collections.Counter((r.page_id, bytes(r.payload)) for r in small if r.record_type == "response")
    assert by == collections.Counter((i, (h or "").encode()) for (i, _, h) in pages() if (i, h or "") in {(r.page_id, r.payload.decode()) for r in small if r.payload is not None})
    names = {r.record_id: r.page_id for r in small if r.record_type == "response"}
    assert all(names[r.refers_to_id] == r.refers_to for r in small if r.record_type == "revisit")
    again = normalise(done, f"{folder}/c")  # an archive that has members already
    assert collections.Counter((r.record_id, r.payload_digest) for r in read_pages(again).collect()) == collections.Counter((r.record_id, r.payload_digest) for r in small)


def test_damaged_archives(spark, tmp_path):
    record = warc.build_record(1, "u", b"p" * 50, hashlib.sha1(b"p" * 50).digest(), "response", None)
    folded = record.replace(b"X-Page: 1", b"X-Page:\r\n  1")
    assert [f["x-page"] for f, _ in split_records(iter([folded[:30], folded[30:] + record]))] == ["1", "1"]
    for damaged in (record[:-3], record[:60], record.replace(b"p\r\n\r\n", b"pp\r\n\r")):
        with pytest.raises(ValueError):
            list(split_records(iter([damaged])))
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(gzip.compress(record * 50)[:-12])
    with pytest.raises(ValueError), open(path, "rb") as f:
        list(inflate(f))
    frame = spark.createDataFrame([(str(path),)], "archive string")
    with pytest.raises(Exception, match="cut.warc.gz"):
        normalise(frame, scratch_folder(spark))
    bad = warc.build_record(1, "u", b"p" * 50, b"0" * 20, "response", None)
    with pytest.raises(ValueError, match="damaged"):
        warc.read_record(gzip.compress(bad))


def test_queries_against_brute_force(spark, tmp_path):
    """The registered queries on a small folder of tables, every column."""
    docs = [(i, t) for i, t, _ in awkward()] + spelled()[:40] + made_docs(100)
    items = [(i, t) for i, t in made_docs(12, seed=9)] + [(20, "shared1 shared2 the"), (21, None)]
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(os.fspath(tmp_path / f"{name}.parquet"))
    save(rows_of([(i, t, "a") for i, t in docs]), SCHEMA, "documents")
    save(items, "item_id long, text string", "benchmark")
    save(pages(), "page_id long, url string, html string", "pages")
    sf = os.fspath(tmp_path)
    assert collections.Counter(map(tuple, op11_lexical_search(spark, sf).collect())) == ranked(docs, items)
    assert collections.Counter(map(tuple, op12_spelling_variants(spark, sf).collect())) == brute_variants(docs)
    assert collections.Counter(map(tuple, op13_warc(spark, sf).collect())) == brute_pages()
