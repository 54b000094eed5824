"""Packing documents into fixed windows by non-negative least squares over length combinations."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaops.llm.common import read_table, texts, tidy
from mediaops.llm.tokens import encoder
from mediaops.llm.words import text_slices
from mediaops.plans.staging import cut_lineage

Combination = tuple[tuple[int, ...], int]  # lengths in a window, number of such windows


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        active[best] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min() > 0:
                x = s
                break
            down = active & (s <= 0)
            step = (x[down] / (x[down] - s[down])).min()
            x = np.maximum(x + step * (s - x), 0)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


def shallow_combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most ``depth`` positive numbers with the sum ``total``."""
    found: list[tuple[int, ...]] = []

    def grow(left: int, most: int, chosen: tuple[int, ...]) -> None:
        if not left:
            found.append(chosen)
        elif len(chosen) < depth:
            for k in range(min(left, most), 0, -1):
                if k * (depth - len(chosen)) < left:
                    break
                grow(left - k, k, (*chosen, k))

    grow(total, total, ())
    return found


def plan_windows(histogram: np.ndarray, window: int, classes: int = 64, depth: int = 4) -> list[Combination]:
    """How many windows of which lengths to make, so that every piece of the histogram is used once.

    ``histogram[l]`` is the number of pieces of l ids.  Lengths fall into ``classes`` rounded up; all combinations of
    at most ``depth`` classes that fill a window are the columns of a least-squares problem whose solution, rounded
    down, says how often each is used.  A combination is then realised with the largest exact lengths of its classes
    and closed with the largest piece that fits.  What rounding leaves over is packed greedily, largest piece first.
    Work and result depend on the number of different lengths only.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan: list[Combination] = []
    if left[window]:
        plan.append(((window,), int(left[window])))
        left[window] = 0
    width = max(1, math.ceil(window / classes))
    classes = math.ceil(window / width)
    kind = np.ceil(np.arange(window + 1) / width).astype(int)

    def largest(most: int, least: int, taken: list[int]) -> int:
        """The largest length in [least, most] of which a piece is left besides ``taken``."""
        for length in np.flatnonzero(left[max(least, 1) : most + 1])[::-1] + max(least, 1):
            if left[length] > taken.count(length):
                return int(length)
        return 0

    def use(lengths: list[int], times: int) -> int:
        times = min([times, *(int(left[x]) // lengths.count(x) for x in set(lengths))])
        for x in lengths:
            left[x] -= times
        plan.append((tuple(lengths), times))
        return times

    if left.any():
        columns = shallow_combinations(classes, depth)
        matrix = np.zeros((classes + 1, len(columns)))
        for j, c in enumerate(columns):
            for k in c:
                matrix[k, j] += 1
        wanted = np.bincount(kind, weights=left, minlength=classes + 1)
        repeats = np.floor(nnls(matrix, wanted) + 1e-9).astype(int)
        for j in np.argsort(-repeats, kind="stable"):
            times = int(repeats[j])
            while times > 0:
                lengths: list[int] = []
                for at, k in enumerate(columns[j]):
                    room = window - sum(lengths)
                    rest = sum((x - 1) * width + 1 for x in columns[j][at + 1 :])
                    last = at == len(columns[j]) - 1
                    lengths.append(largest(room if last else min(room - rest, k * width), 1 if last else (k - 1) * width + 1, lengths))
                    if not lengths[-1]:
                        break
                if not lengths[-1] or sum(lengths) < window - 2 * width:
                    break
                times -= use(lengths, times)
    while left.any():
        lengths = []
        while (room := window - sum(lengths)) and (x := largest(room, 1, lengths)):
            lengths.append(x)
        use(lengths, int(left.sum()))
    return plan


def _slots(plan: list[Combination]) -> dict[str, np.ndarray]:
    """Per length, which ranks of its pieces go to which windows; sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens; documents are cut at whole windows."""
    end = int(end_id).to_bytes(4, "little")
    fields = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                found, at = tool.encode(data, offsets)
                raw, out = found.astype("<u4").tobytes(), []
                for name, a, b in zip(rows.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    ids = raw[4 * a : 4 * b] + end
                    n = len(ids) // 4
                    out += [
                        (name, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)
                    ]
                columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return docs.mapInArrow(tidy(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(
    docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, classes: int = 64, depth: int = 4,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts are encoded once, where they are read.  Documents longer than a window are cut at whole windows only.  The
    driver sees the number of pieces per length (at most ``window`` numbers) and returns as small a table of slots;
    which piece takes which slot follows from its rank among pieces of its length, counted per bucket of hashed ids, so
    that a length which most documents share is spread over tasks.

    A null text counts as empty: its only id is the end id.  Null ids are kept.  Repeated rows are packed each.  An
    empty table gives an empty result; other columns are ignored.
    """
    pieces = cut_lineage(cut_pieces(texts(docs, id_col, text_col), tokenizer, end_id, window))
    histogram = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # one row per length, at most ``window``
        histogram[r["length"]] = r["count"]
    slots = _slots(plan_windows(histogram, window, classes, depth))
    buckets = max(1, math.ceil(math.sqrt(int(histogram.max()))))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    bases = bases.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = rows.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"]
    fields = pa.schema([(n, pa.int64()) for n in (*names[:5], "sequence_id", "offset")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1) << np.int64(48)
        keys = slots["length"] * shift + slots["first"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 5))
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            sequence = slots["sequence"][at] + rank - slots["first"][at]
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(slots["offset"][at])]
            yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], schema=fields)

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select(*names).mapInArrow(tidy(place), kind)


def sequences(
    docs: DataFrame, pieces: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, pad_id: int = 0
) -> DataFrame:
    """The packed windows themselves: sequence_id, used, ids (array, padded to ``window`` unless ``used`` is a power of two).

    Ids of documents must be unique.
    """
    end = np.uint32(end_id)
    fields = pa.schema([("doc_id", pa.int64()), ("all", pa.list_(pa.int32()))])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                found, at = tool.encode(data, offsets)
                values = [np.append(found[a:b], end).astype(np.int32) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(values, fields[1].type)], schema=fields)

    encoded = texts(docs).mapInArrow(tidy(ids), "doc_id long, all array<int>")
    parts = pieces.join(encoded, "doc_id").select(
        "sequence_id", "offset", F.expr("slice(all, int(start + 1), int(length))").alias("ids")
    )
    whole = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    flat = whole.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids")).withColumn("used", F.size("ids"))
    power = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.col("used")))
    return flat.select("sequence_id", "used", F.when(power, F.col("ids")).otherwise(padded).alias("ids"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
