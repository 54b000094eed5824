"""Removing passages that occur elsewhere: windows of words, found level by level at doubled lengths."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaops.llm.common import partitions, read_table, texts
from mediaops.llm.words import BASES, Words, run_hashes, single_spaced, utf8

BLOCK_CHARS = 2_000_000


def _windows(words: Words, length: int) -> np.ndarray:
    """First words of all runs of ``length`` words that lie inside one text."""
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    at = np.arange(len(text))
    return at[at + length <= words.first[1:][text]]


def _joined(table: pa.Table) -> Words:
    column = table.column("text").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return single_spaced(*utf8(column))


def _seed_minima(words: Words, seed: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows, position and hash of the least seed inside each): equal windows have equal least seeds."""
    starts = _windows(words, window)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    values = words.hashes(BASES[0])
    at = np.arange(len(values) - seed + 1)
    seeds = run_hashes(values, at, at + seed, BASES[1])
    reach = window - seed + 1
    rolled = np.lib.stride_tricks.sliding_window_view(seeds, reach)
    least = np.empty(len(starts), np.int64)
    for i in range(0, len(starts), 65536):
        part = starts[i : i + 65536]
        least[i : i + 65536] = part + rolled[part].argmin(axis=1)
    return starts, least, seeds[least]


def _window_hashes(words: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits per window, 64 and 32, from two independent hashes of words and of word sequences."""
    one = run_hashes(words.hashes(BASES[0]), starts, starts + window, BASES[1])
    two = run_hashes(words.hashes(BASES[2]), starts, starts + window, BASES[3])
    return one, (two >> np.uint64(32)).astype(np.uint32)


def _counted(block: int, *keys: np.ndarray) -> tuple[pa.Array, ...]:
    """Distinct keys of a block with their numbers."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(order)))
    columns = [pa.array(k[first].view(np.int64 if k.itemsize == 8 else np.int32)) for k in keys]
    return (pa.array(np.full(len(first), block), pa.int32()), *columns, pa.array(counts, pa.int32()))


def _repeated(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of (block, keys) whose key occurs twice or more in the corpus; a key has at most one row per block."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counted.withColumn("total", total).filter("total > 1").select("block", *keys)


def remove_repeated_windows(
    docs: DataFrame, window: int = 35, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, text (kept words joined by one blank).

    A word goes when a window of ``window`` words covers it whose words also start anywhere else, in any text.

    Level 1 looks at seeds of half a window.  Of the seeds inside a window only the one with the least hash counts, so
    about one word in ten starts a seed, and equal windows agree on it.  Level 2 extends seeds that occur twice, and
    only those, to twice their length, the whole window; windows that occur twice survive.  At either level a lone
    candidate is dropped, and a level without survivors leaves nothing to the next one.

    Texts are dealt once into blocks of about ``block_chars`` characters; the three passes read the same exchange.  A
    block tells each seed or window once with its number, so what is counted for a passage that a third of all texts
    share is one row per block, and what comes back to a block is at most what it told.

    Blocks are dealt by id and text, so rows without an id, or with one id and different texts, are spread.

    Null and empty texts have no words.  A text shorter than a window keeps its words.  Repeated rows are separate
    texts, so both lose what they share.  Null ids are kept; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    plain = texts(docs, id_col, text_col)
    total = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    dealt = plain.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(partitions(spark), "block")
    seed = (window + 1) // 2
    seed_fields = pa.schema([("block", pa.int32()), ("s", pa.int64()), ("n", pa.int32())])
    window_fields = pa.schema([("block", pa.int32()), ("a", pa.int64()), ("b", pa.int32()), ("n", pa.int32())])
    kept_fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def seeds(table: pa.Table) -> pa.Table:
        _, least, hashes = _seed_minima(_joined(table), seed, window)
        _, first = np.unique(least, return_index=True)
        return pa.Table.from_arrays(list(_counted(table.column("block")[0].as_py(), hashes[first])), schema=seed_fields)

    def extend(table: pa.Table, repeated: pa.Table) -> pa.Table:
        if not table.num_rows or not repeated.num_rows:
            return window_fields.empty_table()
        words = _joined(table)
        starts, _, hashes = _seed_minima(words, seed, window)
        starts = starts[np.isin(hashes, repeated.column("s").to_numpy().astype(np.uint64))]
        found = _counted(table.column("block")[0].as_py(), *_window_hashes(words, starts, window))
        return pa.Table.from_arrays(list(found), schema=window_fields)

    def keep(table: pa.Table, repeated: pa.Table) -> pa.Table:
        if not table.num_rows:
            return kept_fields.empty_table()
        words = _joined(table)
        covered = np.zeros(len(words.starts) + 1, np.int64)
        if repeated.num_rows:
            starts = _windows(words, window)
            one, two = _window_hashes(words, starts, window)
            known = repeated.column("a").to_numpy().astype(np.uint64)
            other = repeated.column("b").to_numpy().astype(np.uint32)
            order = np.lexsort((other, known))
            known, other = known[order], other[order]
            low, high = np.searchsorted(known, one, "left"), np.searchsorted(known, one, "right")
            hit = np.zeros(len(starts), bool)
            while (open_ := low < high).any():  # once, unless two windows share 64 bits
                hit[open_] |= other[low[open_]] == two[open_]
                low = low + 1
            np.add.at(covered, starts[hit], 1)
            np.add.at(covered, starts[hit] + window, -1)
        gone = np.cumsum(covered)[:-1] > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) if len(words.first) > 1 else np.zeros(0, int)
        removed[words.counts == 0] = 0
        out = []
        for i, (begin, end) in enumerate(zip(words.first[:-1], words.first[1:])):
            if begin == end or removed[i] == end - begin:
                out.append("")
                continue
            if not removed[i]:
                out.append(words.data[words.starts[begin] : words.ends[end - 1]].tobytes().decode("utf-8", "replace"))
                continue
            stay = np.flatnonzero(~gone[begin:end]) + begin
            heads = stay[np.append(True, np.diff(stay) > 1)]
            tails = stay[np.append(np.diff(stay) > 1, True)]
            runs = [words.data[words.starts[a] : words.ends[b]].tobytes() for a, b in zip(heads, tails)]
            out.append(b" ".join(runs).decode("utf-8", "replace"))
        columns = [table.column("doc_id").combine_chunks(), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())]
        return pa.Table.from_arrays(columns, schema=kept_fields)

    by_block = dealt.groupBy("block")
    level1 = _repeated(by_block.applyInArrow(seeds, "block int, s long, n int"), ["s"])
    level2 = by_block.cogroup(level1.groupBy("block")).applyInArrow(extend, "block int, a long, b int, n int")
    windows = _repeated(level2, ["a", "b"])
    return by_block.cogroup(windows.groupBy("block")).applyInArrow(keep, "doc_id long, n_words long, n_removed long, text string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated_windows(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
