"""The near-duplicate stage by fingerprints, and what workers give back."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mediaops.llm import simhash
from mediaops.llm.common import spread_join, tidy
from mediaops.llm.simhash import near_duplicate_classes, prefix_pairs
from mediaops.plans.staging import cut_lineage


def test_fingerprints_meet_before_minima(spark, monkeypatch):
    """The near-duplicate stage finds near copies by their SimHash fingerprints and Golay keys, without a shared band of minima."""
    rng = random.Random(4)
    rows = []
    for k in range(12):
        w = [f"v{rng.randrange(9000)}" for _ in range(2000)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:-1], "edited"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "band_keys", lambda hashes, sizes, bands: np.arange(len(sizes) * bands).reshape(-1, bands) + int(hashes[0]) % 2**60)
    assert dict(near_duplicate_classes(frame).collect()) == {i: i - i % 2 for i, _ in rows}


def test_fingerprint_keys(spark):
    """Fingerprints that links of 3 bits connect share a key, others do not; equal ones do without a link."""
    rng = random.Random(5)
    prints = [rng.getrandbits(63) for _ in range(40)]
    sets = [(i, p) for i, p in enumerate(prints)] + [(100 + i, p ^ 0b111) for i, p in enumerate(prints[:20])]
    sets += [(200 + i, p ^ 0b111111) for i, p in enumerate(prints[:20])] + [(300 + i, p) for i, p in enumerate(prints[20:])]
    keys = dict(simhash.fingerprint_keys(spark.createDataFrame(sets, "id long, bits long")).select("id", "key").collect())
    assert len({keys[i] for i in range(40)}) == 40
    assert all(keys[i] == keys[100 + i] == keys[200 + i] for i in range(20)) and all(keys[20 + i] == keys[300 + i] for i in range(20))


def test_a_shared_passage_makes_no_square_of_pairs(spark):
    """Sets that share their rarest shingles, but too few to be similar, are not paired; the similar ones among them are."""
    rng = np.random.default_rng(9)
    draw = lambda n: rng.integers(-(2**62), 2**62, n).tolist()
    passages, pool = [draw(30), draw(30)], draw(100)
    sets = {i: passages[i % 2] + rng.permutation(pool)[:70].tolist() for i in range(300)}
    sets |= {1000 + i: sets[i][:-2] + draw(2) for i in range(20)}
    frame = cut_lineage(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, shingles array<long>").repartition(3))
    rest = cut_lineage(spark.createDataFrame([(i, i) for i in sets], "id long, part long"))
    pairs = {tuple(r) for r in prefix_pairs(frame, rest, 0.8).collect()}
    assert {(i, 1000 + i) for i in range(20)} <= pairs and len(pairs) < len(sets)


def test_near_copies_meet_once(spark):
    """Two sets have a row for the first shingle they share, not for each: what is in front says that they have met."""
    rng = np.random.default_rng(11)
    base = rng.integers(-(2**62), 2**62, 200).tolist()
    sets = [(i, sorted([*base, i])) for i in range(30)]
    frame = cut_lineage(spark.createDataFrame([(i, i, s) for i, s in sets], "id long, part long, shingles array<long>"))
    rows = simhash.rare_prefixes(frame, simhash.shingle_counters(frame), 0.8).collect()
    for r in rows:
        front = sorted((x for x in rows if x.id == r.id and x.place < r.place), key=lambda x: x.place)
        assert r.before == [x.shingle for x in front[-simhash.BEFORE :]]
    plan = prefix_pairs(frame.select("id", "shingles"), cut_lineage(frame.select("id", "part")), 0.8)
    assert plan.count() == 30 * 29 // 2
    first = [(r.id, r.shingle) for r in rows if not r.before]
    assert len(first) == 30 and len({s for _, s in first}) == 1


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(10)
    for shared, own in ((0, 5), (200, 3), (3000, 40), (10, 900), (0, 0)):
        common, x, y = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (shared, own, own))
        sets = [np.concatenate([common, x]), np.concatenate([common, y])]
        a, b = simhash.parities(np.concatenate(sets), np.array([len(s) for s in sets]))
        assert sum(int(z).bit_count() for z in (a ^ b).view(np.uint64)) <= 2 * own


def test_workers_give_memory_back():
    batches = [pa.record_batch({"x": [1, 2]}), pa.record_batch({"x": [3]})]
    assert list(tidy(lambda found: (b for b in found))(iter(batches))) == batches


def sent_out(frame):
    return "Broadcast" in frame._jdf.queryExecution().executedPlan().toString()


def test_golay_keys_are_not_sent_out(spark):
    """Few bytes of fingerprints make many of keys: no side of their joins goes through the driver, however small Spark takes it for."""
    prints = cut_lineage(spark.range(200).selectExpr("xxhash64(id) AS id", "array(xxhash64(id)) AS lanes"))
    keys = simhash.golay_keys(prints, simhash.exact_and_near_tables())
    assert not sent_out(simhash.candidate_pairs(keys, lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= 3))
    rows = cut_lineage(spark.range(200).selectExpr("id AS doc_id", "id % 9 AS fp", "id % 2 AS salt"))
    groups = cut_lineage(rows.groupBy("fp").agg(F.collect_set("salt").alias("salts")))
    joined = spread_join(rows, groups, "fp", "salt")
    assert not sent_out(joined) and joined.count() == 200


def test_keys_of_bands_and_sketches_are_not_sent_out(spark):
    groups = cut_lineage(spark.range(100).selectExpr("id AS fp", "array(id % 7, id % 50, 1000 + id) AS keys"))
    shared = simhash.shared_keys(groups.select(F.explode("keys").alias("key"), F.col("fp").alias("id")))
    assert not sent_out(shared) and shared.count() == 200
    sets = cut_lineage(spark.createDataFrame([(i, [7, 8, 9, 10 + i]) for i in range(3)], "id long, shingles array<long>"))
    assert not sent_out(prefix_pairs(sets, cut_lineage(sets.selectExpr("id", "id AS part")), 0.5))
