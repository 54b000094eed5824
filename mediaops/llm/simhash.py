"""SimHash near duplicates through Golay-code keys of fingerprint segments; similar sets of shingles, further apart by minima."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.llm import golay
from mediaops.llm.common import read_table, small_batches, spread_join, texts, tidy
from mediaops.llm.components import smallest_labels
from mediaops.llm.exact_dedup import BROADCAST_HASHES
from mediaops.llm.words import BASES, U64, Words, lower_ascii, mix, single_spaced, text_slices
from mediaops.plans.staging import cut_lineage

SALTS = 64
SEED = 42
COUNTERS = 1 << 18  # of shingles by the last bits of their hash, 2 MB
SKETCH = 8  # longs in the parities of a set, 512 bits
BEFORE = 4  # shingles of a prefix that a later one of its rows has with it
BAND = 5  # minima in a key: sets at a similarity of 0.8 share a band with a chance of 0.33, at 0.3 with 0.002
# Fixed values of XXH64.
P1, P2, P3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
P4, P5 = U64(0x85EBCA77C2B2AE63), U64(0x27D4EB2F165667C5)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED, longest: int = 256) -> np.ndarray:
    """XXH64 of data[start:end] for each pair; runs of one length are computed together."""
    lengths = ends - starts
    out = np.empty(len(starts), U64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    halves = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for which in np.split(order, cuts) if len(order) else []:
        n, at = int(lengths[which[0]]), starts[which]
        if n > longest:
            out[which] = [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), seed) for s in at]
            continue
        done = 0
        if n >= 32:
            with np.errstate(over="ignore"):
                state = [np.full(len(at), v, U64) for v in (U64(seed) + P1 + P2, U64(seed) + P2, U64(seed), U64(seed) - P1)]
            while done + 32 <= n:
                state = [_round(v, lanes[at + done + 8 * i]) for i, v in enumerate(state)]
                done += 32
            h = _rotate(state[0], 1) + _rotate(state[1], 7) + _rotate(state[2], 12) + _rotate(state[3], 18)
            for v in state:
                h = (h ^ _round(np.zeros(len(at), U64), v)) * P1 + P4
        else:
            h = np.full(len(at), U64(seed) + P5, U64)
        h = h + U64(n)
        while done + 8 <= n:
            h = _rotate(h ^ _round(np.zeros(len(at), U64), lanes[at + done]), 27) * P1 + P4
            done += 8
        if done + 4 <= n:
            h = _rotate(h ^ (halves[at + done].astype(U64) * P1), 23) * P2 + P3
            done += 4
        while done < n:
            h = _rotate(h ^ (padded[at + done].astype(U64) * P5), 11) * P1
            done += 1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        out[which] = h ^ (h >> U64(32))
    return out


def shingle_spans(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of all runs of ``shingle`` words and the number of runs per text; a shorter text is one run."""
    counts = words.counts
    runs = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    text = np.repeat(np.arange(len(counts)), runs)
    begin = np.concatenate([[0], np.cumsum(runs)])[:-1]
    head = words.first[:-1][text] + np.arange(len(text)) - begin[text]
    tail = np.minimum(head + shingle, words.first[1:][text]) - 1
    return words.starts[head], words.ends[tail], runs


def majority_bits(hashes: np.ndarray, runs: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Fingerprints (texts x lanes, 64 bits each): a bit is set where over half of the text's hashes have it.

    Lanes after the first use the same hashes, mixed again.
    """
    n = len(runs)
    text = np.repeat(np.arange(n) * 256, runs)
    out = np.zeros((n, lanes), U64)
    for lane in range(lanes):
        h = hashes if not lane else mix(hashes + U64(lane * int(BASES[0]) % 2**64))
        for byte in range(8):
            values = text + ((h >> U64(8 * byte)) & U64(255)).astype(np.int64)
            counts = np.bincount(values, minlength=256 * n).reshape(n, 256) @ _BITS
            bits = (2 * counts > runs[:, None]).astype(U64)
            out[:, lane] |= (bits << (np.arange(8, dtype=U64) + U64(8 * byte))).sum(axis=1, dtype=U64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, lanes): the 64-bit fingerprint of each whole text, and it with further lanes as an array.

    A-Z are lowered; words are runs without ASCII white space; runs of ``shingle`` words joined by blanks are hashed
    with XXH64, repeats included.  A text of fewer words is one run; a text without words has fingerprint zero.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("lanes", pa.list_(pa.int64()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                words = single_spaced(lower_ascii(data), offsets)
                starts, ends, runs = shingle_spans(words, shingle)
                out = majority_bits(xxh64(words.data, starts, ends), runs, lanes)
                signed = out.astype(np.int64)
                ends = pa.array(np.arange(0, signed.size + 1, lanes), pa.int32())
                columns = [rows.column(0), pa.array(signed[:, 0].copy()), pa.ListArray.from_arrays(ends, pa.array(signed.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return texts(docs, id_col, text_col).mapInArrow(tidy(compute), "doc_id long, fp long, lanes array<long>")


def exact_and_near_tables(width: int = 64, segments: int = 4) -> list[tuple[list[int], list[int]]]:
    """For links of at most ``segments - 1`` bits: (bits that must be equal, bits that may differ by one) per table.

    With 3 errors in 4 segments one segment has none, and another one has at most one error.
    """
    size = width // segments
    part = [list(range(i * size, (i + 1) * size)) for i in range(segments)]
    return [(part[i], part[j]) for i in range(segments) for j in range(segments) if i != j]


def _take(bits: np.ndarray, places: list[int]) -> np.ndarray:
    return (bits[:, places].astype(np.int64) << np.arange(len(places))).sum(axis=1)


def golay_keys(prints: DataFrame, tables: list[tuple[list[int], list[int]]]) -> DataFrame:
    """(key, id, probe) for rows (id, lanes): one row per table and nearby codeword, ``probe`` marks the nearest one."""
    fields = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("probe", pa.bool_())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                raw = batch.column(1).flatten().to_numpy().astype("<i8").view(np.uint8).reshape(batch.num_rows, -1)
                bits = np.unpackbits(raw, axis=1, bitorder="little")
                ids = batch.column(0).to_numpy()
                for number, (equal, near) in enumerate(tables):
                    index, count = golay.nearby(_take(bits, near))
                    place = np.arange(golay.KEYS)[None, :] < count[:, None]
                    prefix = (np.int64(number) << np.int64(50)) | (_take(bits, equal) << np.int64(12))
                    keys = (prefix[:, None] | index)[place]
                    probe = np.broadcast_to(np.arange(golay.KEYS) == 0, place.shape)[place]
                    columns = [pa.array(keys), pa.array(np.repeat(ids, count)), pa.array(probe)]
                    yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return prints.select("id", "lanes").mapInArrow(tidy(compute), "key long, id long, probe boolean")


def candidate_pairs(keys: DataFrame, check) -> DataFrame:
    """Pairs (a, b) whose nearest codeword in some table is a nearby one of the other, and for which ``check`` holds.

    Spark takes the keys, dozens of rows per fingerprint, for a table as small as the fingerprints and would send them out.
    """
    left = keys.filter("probe").select("key", F.col("id").alias("x"))
    right = keys.select("key", F.col("id").alias("y")).hint("merge")
    met = left.join(right, "key").filter((F.col("x") != F.col("y")) & check(F.col("x"), F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def fingerprint_links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` that differ in at most ``max_bits`` (up to 3) bits, a written table."""
    keys = golay_keys(prints.select(F.col("fp").alias("id"), F.array("fp").alias("lanes")), exact_and_near_tables())
    return cut_lineage(candidate_pairs(keys, lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_bits))


def fingerprint_classes(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id.

    Fingerprints link when at most ``max_bits`` (up to 3) bits differ; component_id is the smallest id in reach.  Equal
    fingerprints collapse to one before any link is sought, so a group of copies costs one row.  Keys carry the
    fingerprint itself: candidates are verified inside the join, and no other column is moved.

    A null text counts as empty; texts without words have fingerprint zero and link like any other.  Null ids never
    name a component unless it has no other.  Repeated rows share their class.  An empty table gives an empty result.
    """
    if max_bits > 3:
        raise ValueError("four segments guarantee links of 3 bits")
    prints = cut_lineage(
        fingerprints(docs, shingle, 1, id_col, text_col)
        .select("doc_id", "fp")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    )
    parts = prints.groupBy("fp", "salt").agg(F.min("doc_id").alias("label"))
    groups = cut_lineage(parts.groupBy("fp").agg(F.min("label").alias("label"), F.collect_set("salt").alias("salts")))
    found = smallest_labels(groups.select(F.col("fp").alias("node"), "label"), fingerprint_links(groups.select("fp"), max_bits))
    named = groups.join(found.select(F.col("node").alias("fp"), F.col("label").alias("reached")), "fp", "left")
    named = named.select("fp", "salts", F.coalesce("reached", "label").alias("component_id"))
    return spread_join(prints, named, "fp", "salt").select("doc_id", "fp", "component_id")


def bands_needed(similarity: float, size: int = BAND, missed: float = 1e-5) -> int:
    """Bands of ``size`` minima each that two sets of this Jaccard similarity have none of in common with a chance of ``missed``."""
    return math.ceil(math.log(missed) / math.log1p(-min(similarity, 0.99) ** size))


def band_keys(hashes: np.ndarray, sizes: np.ndarray, bands: int, size: int = BAND, seed: int = 11) -> np.ndarray:
    """Keys (sets x bands) of sets of hashes, none of them empty: a band combines the least hash under ``size`` orders each."""
    orders = np.random.default_rng(seed).integers(0, 2**63, (bands, size), dtype=np.uint64) * U64(2) + U64(1)
    begin = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), bands), U64)
    for band in range(bands if len(sizes) else 0):
        out[:, band] = U64(band)
        for order in orders[band]:
            out[:, band] = mix(out[:, band] * BASES[2] + np.minimum.reduceat(hashes * order, begin))
    return out


def shared_keys(keys: DataFrame) -> DataFrame:
    """Those of the rows (key, id) whose key another id has too; keys out of arrays are more than Spark takes them for."""
    sizes = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    return keys.join(sizes.filter("low < high").select("key").hint("merge"), "key")


def distinct_shingles(hashes: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text sorted, each once, and their number per text."""
    text = np.repeat(np.arange(len(runs)), runs)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(runs))


def set_names(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits that name the set of each text; zero for an empty one."""
    out = np.zeros(len(sizes), U64)
    some = sizes > 0
    if some.any():
        begin = (np.cumsum(sizes) - sizes)[some]
        out[some] = mix(np.add.reduceat(mix(hashes + BASES[1]), begin) + sizes[some].astype(U64))
    return out


def hashed_shingles(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the hashes of the distinct shingles of each text and their number."""
    for rows, data, offsets in text_slices(batch):
        words = single_spaced(lower_ascii(data), offsets)
        starts, ends, runs = shingle_spans(words, shingle)
        yield rows, *distinct_shingles(xxh64(words.data, starts, ends), runs)


def set_prints(docs: DataFrame, shingle: int, bands: int) -> DataFrame:
    """(doc_id, sha, fp, bits, keys) for rows (doc_id, text, sha): ``fp`` names the set of shingles, ``bits`` is its SimHash
    fingerprint, ``keys`` are those of its bands."""
    fields = pa.schema(
        [("doc_id", pa.int64()), ("sha", pa.binary()), ("fp", pa.int64()), ("bits", pa.int64()), ("keys", pa.list_(pa.int64()))]
    )

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, hashes, sizes in hashed_shingles(batch, shingle):
                keys = band_keys(hashes, sizes[sizes > 0], bands).astype(np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes > 0)]) * bands, pa.int32())
                names = pa.array(set_names(hashes, sizes).astype(np.int64))
                bits = pa.array(majority_bits(hashes, sizes)[:, 0].astype(np.int64))
                columns = [rows.column(0), rows.column(2), names, bits, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return docs.select("doc_id", "text", "sha").mapInArrow(tidy(compute), "doc_id long, sha binary, fp long, bits long, keys array<long>")


def fingerprint_keys(sets: DataFrame, max_bits: int = 3) -> DataFrame:
    """(key, id) for rows (id, bits): ids whose SimHash fingerprints are connected by links of ``max_bits`` share a key."""
    prints = cut_lineage(sets.select(F.col("bits").alias("fp")).distinct())
    classes = smallest_labels(prints.select(F.col("fp").alias("node"), F.col("fp").alias("label")), fingerprint_links(prints, max_bits))
    named = sets.join(classes.select(F.col("node").alias("bits"), F.col("label").alias("key")), "bits", "left")
    return named.select(F.coalesce("key", "bits").alias("key"), "id")


def shingle_sets(docs: DataFrame, chosen: DataFrame, shingle: int, max_broadcast: int = BROADCAST_HASHES) -> DataFrame:
    """(id, shingles): the distinct hashed shingles of the texts whose ``sha`` is in ``chosen`` (id, sha), a written table."""
    fields = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, hashes, sizes in hashed_shingles(batch, shingle):
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                sets = pa.ListArray.from_arrays(ends, pa.array(hashes.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column(0), sets], schema=fields)

    few = chosen.count() <= max_broadcast
    found = docs.join(F.broadcast(chosen) if few else chosen, "sha").groupBy("id").agg(F.first("text").alias("text"))
    return found.select("id", "text").mapInArrow(tidy(compute), "id long, shingles array<long>")


def similar_pairs(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have at least this Jaccard similarity; ``sets`` has (id, shingles)."""
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    few, many = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    met = met.join(right, "b").filter(few >= many * similarity - 1e-6)
    both = F.size(F.array_intersect("sa", "sb"))
    return met.filter(both * (1 + similarity) >= (F.size("sa") + F.size("sb")) * similarity - 1e-6).select("a", "b")


def shingle_counters(sets: DataFrame) -> np.ndarray:
    """How often the shingles of ``sets`` (id, shingles) fall into each of ``COUNTERS`` numbers; bounded whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False) & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["at", "n"])

    total = np.zeros(COUNTERS, np.int64)
    counted = sets.select("shingles").mapInArrow(tidy(count), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total[counted["at"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return total


def parities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parities (sets x SKETCH longs) of sets of hashes: each hash turns one of the bits over.

    Hashes that two sets share turn the same bits in both, so sets of which d hashes stand in one only differ in at most
    d bits, whatever their size.
    """
    width = SKETCH * 64
    bit = (mix(hashes.view(U64)) >> U64(32)).astype(np.int64) % width
    turned = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * width + bit, minlength=len(sizes) * width) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").view("<i8").reshape(-1, SKETCH)


def rare_prefixes(sets: DataFrame, counters: np.ndarray, similarity: float) -> DataFrame:
    """(id, part, size, shingle, place, sketch, before): of each set as many of its rarest shingles that similar sets share
    one of them; ``sketch`` has the parities of the whole set, ``before`` up to BEFORE shingles of the rows next in front.

    All sets follow one order, by counter and then by hash.  Two sets of which the smaller one has n shingles share at
    least ``similarity * n`` if they are similar, so they share one of the first ``n - ceil(similarity * n) + 1`` of
    either.  A shingle whose counter is one stands in no other set and is left out.
    """
    names = ("id", "part", "size", "shingle", "place")
    fields = pa.schema([*[(n, pa.int64()) for n in names], ("sketch", pa.list_(pa.int64())), ("before", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = (batch.column(i).to_numpy() for i in (0, 1))
            for begin in range(0, batch.num_rows, 256):
                column = batch.column(2).slice(begin, 256)
                shingles = column.flatten().to_numpy(zero_copy_only=False)
                sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                text = np.repeat(np.arange(len(sizes)), sizes)
                times = counters[shingles & (COUNTERS - 1)]
                order = np.lexsort((shingles, times, text))
                place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1
                kept = (place < first[text]) & (times[order] > 1)
                keep = order[kept]
                who = text[keep]
                arrays = [ids[begin : begin + 256][who], parts[begin : begin + 256][who], sizes[who], shingles[keep], place[kept]]
                sketch = pa.array(parities(shingles, sizes)[who].ravel(), pa.int64())
                ends = pa.array(np.arange(len(who) + 1) * SKETCH, pa.int32())
                row = np.arange(len(who))
                held = np.minimum(row - np.searchsorted(who, who), BEFORE)
                cuts = np.concatenate([[0], np.cumsum(held)])
                front = shingles[keep][np.repeat(row - held, held) + np.arange(cuts[-1]) - np.repeat(cuts[:-1], held)]
                columns = [pa.array(x, pa.int64()) for x in arrays]
                columns += [pa.ListArray.from_arrays(ends, sketch), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(front, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)

    types = "id long, part long, size long, shingle long, place long, sketch array<long>, before array<long>"
    return sets.select("id", "part", "shingles").mapInArrow(tidy(cut), types)


def prefix_pairs(sets: DataFrame, rest: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the ids of ``rest`` (id, part) in different parts that may be similar: they share a rare shingle.

    Shingles of a template that many texts share are the commonest and stay out of the prefixes, so such texts do not
    meet unless the template is most of them.  Behind the first shingle that two sets share, both must have enough left
    for the similarity; rows of later shared ones may fail that, the first one's does not.  Inside the join the parities
    of the sets are compared too: sets that differ in more bits than similar ones have shingles apart are no pair, so a
    passage that many texts share does not make a row for each two of them.  Two sets that share a shingle in front of
    this one have met there, so near copies come once and not with every shingle of their prefixes.
    """
    few = rest.count() <= BROADCAST_HASHES
    chosen = cut_lineage(sets.join(F.broadcast(rest) if few else rest, "id"))
    prefixes = cut_lineage(rare_prefixes(chosen, shingle_counters(chosen), similarity))
    x, y = (prefixes.select("shingle", *[F.col(c).alias(c + n) for c in ("id", "part", "size", "place", "sketch", "before")]) for n in ("x", "y"))
    near = F.least("sizex", "sizey") >= F.greatest("sizex", "sizey") * similarity - 1e-6
    left = F.least(F.col("sizex") - F.col("placex"), F.col("sizey") - F.col("placey"))
    near = near & (left * (1 + similarity) >= (F.col("sizex") + F.col("sizey")) * similarity - 1e-6)
    bits = sum(F.bit_count(x["sketchx"][i].bitwiseXOR(y["sketchy"][i])) for i in range(SKETCH))
    near = near & (bits * (1 + similarity) <= (F.col("sizex") + F.col("sizey")) * (1 - similarity) + 1e-6) & ~F.arrays_overlap("beforex", "beforey")
    # Rows repeat their sketches, which files hold once, so neither side is sent out by the size of its file.
    met = x.join(y.hint("merge"), (x["shingle"] == y["shingle"]) & (F.col("idx") < F.col("idy")) & (F.col("partx") != F.col("party")) & near)
    return met.select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct()


def links_within_keys(
    shared: DataFrame, judge: Callable[[DataFrame], DataFrame], candidates: Callable[[DataFrame], DataFrame], crowd: int, rounds: int,
    start: DataFrame | None = None,
) -> DataFrame:
    """(id, part) for the ids of ``shared`` (key, id): equal parts for all that links inside a key connect.

    ``start`` (id, part), if given, are parts that links found before connect; its ids are in the result too.

    ``judge`` keeps those of the pairs (a, b) that link.  Each id is first compared with a leader, the one that leads
    most of its keys, which connects a group of near copies with a pair per row.  While a key has more than ``crowd`` ids
    outside its largest part, further leaders follow: of each key the id with most links that has not led yet.  What is
    still apart in some key goes to ``candidates`` (rows id, part), which must name every pair in different parts that
    may link.  Links join parts, not ids, so a round works on what it found.  Neither ``crowd`` nor ``rounds`` decides
    what is found.  The table of ids is all that is kept from round to round.
    """
    ids = shared.select("id").distinct().withColumn("part", F.col("id"))
    if start is not None:
        ids = start.unionByName(ids.join(start, "id", "left_anti"))
    state = cut_lineage(ids.select("id", F.lit(0).cast("long").alias("degree"), F.lit(False).alias("led"), "part"))
    for turn in range(max(rounds, 1) + 1):
        now = shared.join(state, "id")
        sizes = now.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
        sizes = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter("n > most")
        sizes = cut_lineage(sizes)
        if sizes.isEmpty():
            return state.select("id", "part")
        if turn and (stuck or turn == max(rounds, 1) or sizes.filter(F.col("n") - F.col("most") > crowd).isEmpty()):
            break
        open_ = now.join(sizes.select("key"), "key")
        best = F.max(F.when(~F.col("led"), F.struct("degree", "id", "part"))).alias("leader")
        leaders = cut_lineage(open_.groupBy("key").agg(best).filter("leader IS NOT NULL").select("key", F.col("leader.id").alias("a"), F.col("leader.part").alias("pa")))
        met = open_.join(leaders, "key").filter("part <> pa").groupBy("id", "a").agg(F.count(F.lit(1)).alias("keys"))
        picked = met.groupBy("id").agg(F.max_by("a", F.struct("keys", "a")).alias("a"))
        found = cut_lineage(judge(picked.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()))
        stuck = found.isEmpty()
        ends = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id")))
        links = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"))
        led = leaders.select(F.col("a").alias("id")).distinct().withColumn("leads", F.lit(True))
        state = _joined_parts(state, found).join(links, "id", "left").join(led, "id", "left")
        state = cut_lineage(
            state.select("id", (F.col("degree") + F.coalesce("links", F.lit(0))).alias("degree"), F.coalesce("leads", "led").alias("led"), "part")
        )
    rest = cut_lineage(now.join(sizes.select("key"), "key").select("id", "part").distinct())
    if rest.isEmpty():
        return state.select("id", "part")
    return _joined_parts(state, cut_lineage(judge(candidates(rest)))).select("id", "part")


def _joined_parts(state: DataFrame, links: DataFrame) -> DataFrame:
    """``state`` (id, part, ...) after the parts that ``links`` (a, b) connect have become one."""
    own = state.select(F.col("id").alias("a"), F.col("part").alias("x"))
    other = state.select(F.col("id").alias("b"), F.col("part").alias("y"))
    edges = links.join(own, "a").join(other, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    labels = smallest_labels(*_with_nodes(cut_lineage(edges))).withColumnRenamed("node", "part")
    return state.join(labels, "part", "left").withColumn("part", F.coalesce("label", "part")).drop("label")


def _with_nodes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ends of ``links`` labelled by themselves, and ``links``, as ``smallest_labels`` takes them."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    return ends.withColumn("label", F.col("node")), links


def near_duplicate_rows(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, crowd: int = 256, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """As ``near_duplicate_classes``, with the text's sha256 as ``sha`` and whether the row is ``kept``.

    A class keeps the smallest id, of equal ids (or without any) the least hash; rows that repeat both are all ``kept``.
    """
    rows = texts(docs, id_col, text_col).withColumn("sha", F.unhex(F.sha2("text", 256)))
    with small_batches(docs.sparkSession):
        prints = set_prints(rows, shingle, bands_needed(similarity)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        prints = cut_lineage(prints)
        best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "sha")).alias("best")
        parts = prints.groupBy("fp", "salt").agg(best, F.min("bits").alias("bits"), F.min("keys").alias("keys"))
        least = [F.min(c).alias(c) for c in ("best", "bits", "keys")]
        groups = cut_lineage(parts.groupBy("fp").agg(*least, F.collect_set("salt").alias("salts")))
        near = fingerprint_keys(groups.filter(F.size("keys") > 0).select(F.col("fp").alias("id"), "bits"))
        near = cut_lineage(shared_keys(cut_lineage(near)))
        shared = cut_lineage(shared_keys(groups.select(F.explode("keys").alias("key"), F.col("fp").alias("id"))))
        met = shared.select("id").unionByName(near.select("id")).distinct()
        chosen = groups.select(F.col("fp").alias("id"), F.col("best.sha").alias("sha")).join(met, "id")
        sets = cut_lineage(shingle_sets(rows, cut_lineage(chosen), shingle))
        judge = lambda pairs: similar_pairs(sets, pairs, similarity)
        exact = lambda rest: prefix_pairs(sets, rest, similarity)
        found = links_within_keys(near, judge, exact, crowd, rounds)
        found = links_within_keys(shared, judge, exact, crowd, rounds, cut_lineage(found))
    # Classes are named by a fingerprint: ids may be null or stand for several texts.
    found = found.select(F.col("id").alias("fp"), F.col("part").alias("label"))
    named = groups.drop("bits", "keys").join(found, "fp", "left").withColumn("class", F.coalesce("label", "fp"))
    first = named.filter("label IS NOT NULL").groupBy("class").agg(F.min("best").alias("first"))
    named = named.join(first, "class", "left").select("fp", "salts", F.coalesce("first", "best").alias("best"))
    out = spread_join(prints.select("doc_id", "sha", "fp", "salt"), named, "fp", "salt")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("sha") == F.col("best.sha"))
    return out.select("doc_id", "sha", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))


def near_duplicate_classes(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, crowd: int = 256, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id; texts link when their shingles are similar enough.

    Shingles of a text count once.  First come the texts whose SimHash fingerprints are connected by links of 3 bits, found
    by Golay keys as in ``fingerprint_classes``.  What three bits do not reach has further candidates, which share a band
    of minima (``band_keys``); as many bands are made that a pair at ``similarity`` shares none with a chance of 1e-5, and
    nearer pairs with less.  Either kind links when the Jaccard similarity of the sets themselves is at least ``similarity``.

    Keys (classes of fingerprints, bands) that one id has alone are dropped first; the others are compared by ``links_within_keys``, and what leaders do
    not connect by a join on the rarest shingles of each set (``prefix_pairs``), which loses no pair.

    Texts with the same set of shingles are one class from the start, so copies cost one row.  Nulls, empty texts, repeated
    rows and an empty table are treated as in ``fingerprint_classes``.
    """
    found = near_duplicate_rows(docs, shingle, similarity, crowd, rounds, id_col, text_col)
    return found.select("doc_id", "component_id")


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = fingerprint_classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
