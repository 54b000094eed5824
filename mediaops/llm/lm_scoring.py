"""Log-likelihood of whole documents under word counts and under a gated recurrent language model."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm import gru
from mediaops.llm.common import id_remainder, read_table, texts
from mediaops.llm.words import find_words, lower_ascii, text_slices
from mediaops.plans.staging import cut_lineage

FOLDS, HELD_OUT = 7, 2
SEGMENT = 1_200_000  # tokens that a task works on at once; a longer text is alone
TIERS = (1024, 4096, 1 << 62)  # words; texts of a tier come together
PIECE = 2048  # words after which training begins anew inside a text, so that many lanes go side by side
LN10 = math.log(10)


@dataclass
class Vocabulary:
    """Counts of training tokens.  ``head`` has the hashes of the model's own words, most frequent first; ``known`` the
    counts of many more, sorted by hash; both are bounded by parameters.  All other counts stay in a table."""

    head: np.ndarray
    head_counts: np.ndarray
    known: np.ndarray
    known_counts: np.ndarray
    tokens: int
    distinct: int
    ends: int

    def __post_init__(self) -> None:
        self.order = np.argsort(self.head)
        self.sorted = self.head[self.order]
        self.begins = np.searchsorted(self.sorted >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.int32)
        self.tail_symbol, self.end_symbol = len(self.head), len(self.head) + 1
        self.tail_tokens = max(0, self.tokens - self.ends - int(self.head_counts.sum()))
        tail_types = max(0, self.distinct - len(self.head) - (self.ends > 0))
        self.tail_mass = self.tail_tokens + tail_types + 1
        self.base_mass = self.tokens + self.distinct + 1

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.tail_symbol, np.int32)
        # Hashes with the same first 16 bits stand together, mostly one or none.
        at, end = self.begins[hashes >> np.uint64(48)], self.begins[(hashes >> np.uint64(48)) + np.uint64(1)]
        left = np.flatnonzero(at < end)
        while len(left):
            place = at[left]
            hit = self.sorted[place] == hashes[left]
            out[left[hit]] = self.order[place[hit]]
            at[left] += 1
            left = left[~hit & (place + 1 < end[left])]
        return out

    def known_count(self, hashes: np.ndarray) -> np.ndarray:
        """Counts, or -1 for hashes that ``known`` does not have."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            hit = self.known[at] == hashes
            out[hit] = self.known_counts[at[hit]]
        return out

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.head_counts, [self.tail_tokens, self.ends]]).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n): 64-bit hashes of lowered words of ``docs`` (doc_id, text) with their counts, combined per task first."""
    fields = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        distinct, inverse = np.unique(h, return_inverse=True)
        return distinct, np.bincount(inverse, weights=n, minlength=len(distinct)).astype(np.int64)

    def batch_of(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n)], schema=fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, data, offsets in text_slices(batch):
                parts.append(np.unique(find_words(lower_ascii(data), offsets).hashes(), return_counts=True))
                if sum(len(p[0]) for p in parts) > 1_000_000:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > 500_000:
                        yield batch_of(*parts[0])
                        parts = []
        if parts:
            yield batch_of(*merged(parts))

    return docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def learn_vocabulary(counts: DataFrame, training_texts: int, head: int, known: int) -> Vocabulary:
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy(F.desc("n"), "h").limit(known).toArrow()  # at most ``known`` rows of 16 bytes
    h, n = (top.column(i).to_numpy().copy() for i in (0, 1))
    h = h.astype(np.uint64)
    order = np.argsort(h)
    tokens, distinct = (total["n"] or 0) + training_texts, total["v"] + (training_texts > 0)
    return Vocabulary(h[:head], n[:head], h[order], n[order], tokens, distinct, training_texts)


class _Segment:
    """Texts that a task works on at once."""

    def __init__(self) -> None:
        self.names, self.symbols, self.hashes, self.counts, self.size = [], [], [], [], 0

    def add(self, names: list, symbols: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.names += names
        self.symbols.append(symbols)
        self.hashes.append(hashes)
        self.counts.append(counts)
        self.size += len(symbols) + len(names)

    def whole(self, end: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, symbols with ends, offsets in them, hashes of words)"""
        lengths = np.concatenate(self.counts)
        offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
        found = np.insert(np.concatenate(self.symbols), np.cumsum(lengths), end).astype(np.int32)
        return self.names, found, offsets, np.concatenate(self.hashes)


def _segments(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of about SEGMENT tokens, by tiers of length, as a segment takes as many steps as its longest text."""
    tiers = [_Segment() for _ in TIERS]
    for batch in batches:
        for rows, data, offsets in text_slices(batch):
            words = find_words(lower_ascii(data), offsets)
            hashes, counts, names = words.hashes(), words.counts, np.arange(rows.num_rows)
            symbols, ids = vocabulary.symbols(hashes), rows.column(0).to_pylist()
            tier = np.searchsorted(TIERS, counts)
            for number, segment in enumerate(tiers):
                chosen = tier == number
                if not chosen.any():
                    continue
                which = np.repeat(chosen, counts)
                if segment.size and segment.size + which.sum() > SEGMENT:
                    yield segment.whole(vocabulary.end_symbol)
                    segment.__init__()
                segment.add([ids[i] for i in names[chosen]], symbols[which], hashes[which], counts[chosen])
    for segment in tiers:
        if segment.size:
            yield segment.whole(vocabulary.end_symbol)


def _live(targets: np.ndarray, window: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Windows of steps with the lanes that still have text in them."""
    for at in range(0, len(targets), window):
        part = slice(at, at + window)
        yield part, np.flatnonzero((targets[part] >= 0).any(axis=0))


def train_round(
    docs: DataFrame, vocabulary: Vocabulary, classes: gru.Classes, flat: np.ndarray, hidden: int, lanes: int, window: int, rate: float
) -> DataFrame:
    """(part, weight, model): each task trains its own copy of the model on all its texts."""
    fields = pa.schema([("part", pa.int64()), ("weight", pa.float64()), ("model", pa.binary())])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = gru.start_parameters(vocabulary.symbol_counts(), classes, hidden)
        p = gru.unpack(flat, like)
        descent, trained = gru.Adagrad(p, rate), 0
        for _, found, offsets, _ in _segments(batches, vocabulary):
            offsets = gru.pieces_of(offsets, PIECE)
            fit = int(min(lanes, max(1, len(found) // int(np.diff(offsets).max()))))
            inputs, targets, fresh, _ = gru.lanes_of(found, offsets, fit, vocabulary.end_symbol)
            state = np.zeros((inputs.shape[1], hidden), gru.F32)
            for part, live in _live(targets, window):
                y = targets[part, live]
                g, read, state[live], _ = gru.gradients(p, classes, state[live], inputs[part, live], y, fresh[part, live])
                # A window of few lanes moves the model as little as it has tokens.
                descent.update(p, g, read, 1 / max(int((y >= 0).sum()), lanes * window))
            trained += len(found)
        if trained:
            columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(trained)]), pa.array([gru.pack(p).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return docs.mapInArrow(train, "part long, weight double, model binary")


def average_models(models: DataFrame, fan_in: int = 32) -> np.ndarray | None:
    """Weighted mean of models numbered by ``part``; no task and not the driver sees more than ``fan_in`` at once."""

    def mean(table: pa.Table) -> pa.Table:
        weight = table.column("weight").to_numpy()
        total = np.zeros(len(table.column("model")[0].as_py()) // 4)
        for w, m in zip(weight, table.column("model")):
            total += w * np.frombuffer(m.as_py(), np.float32)
        model = (total / weight.sum()).astype(np.float32).tobytes()
        return pa.table([table.column("g").slice(0, 1).combine_chunks(), pa.array([float(weight.sum())]), pa.array([model], pa.binary())], names=["part", "weight", "model"])

    models = cut_lineage(models)
    while (n := models.count()) > 1:
        numbered = models.withColumn("g", F.floor(F.col("part") / fan_in))
        models = cut_lineage(numbered.groupBy("g").applyInArrow(mean, "part long, weight double, model binary"))
    row = models.first()
    return np.frombuffer(row["model"], np.float32) if row else None


def score_texts(docs: DataFrame, vocabulary: Vocabulary, classes: gru.Classes, flat: np.ndarray, hidden: int, lanes: int, window: int) -> DataFrame:
    """Per row: row, doc_id, n_tokens, n_known, base, model, and ``rest``, the words whose counts the vocabulary lacks.

    ``base`` and ``model`` are sums of log10 that still lack log10(c + 1) of the words in ``rest``.
    """
    kind = "row long, doc_id long, n_tokens long, n_known long, base double, model double, rest array<long>"
    fields = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
         ("model", pa.float64()), ("rest", pa.list_(pa.int64()))]
    )
    end_log = math.log10(vocabulary.ends + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = gru.unpack(flat, gru.start_parameters(vocabulary.symbol_counts(), classes, hidden))
        row = TaskContext.get().partitionId() << 33
        head_logs = np.log10(vocabulary.head_counts + 1.0)
        for names, found, offsets, all_hashes in _segments(batches, vocabulary):
            n = len(names)
            text_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
            fit = int(min(lanes, max(1, len(found) // int(np.diff(offsets).max()))))
            inputs, targets, fresh, which = gru.lanes_of(found, offsets, fit, vocabulary.end_symbol)
            state = np.zeros((inputs.shape[1], hidden), gru.F32)
            model = np.zeros(n)
            states, wanted, places, held = [], [], [], 0

            def flush() -> None:
                logs = gru.log_probabilities(p, classes, np.concatenate(states), np.concatenate(wanted))
                model[:] += np.bincount(text_of[np.concatenate(places)], weights=logs, minlength=n)

            for part, live in _live(targets, window):
                y = targets[part, live]
                use = y >= 0
                run = gru.run_window(p, state[live], inputs[part, live], fresh[part, live])[0]
                states.append(run[use])
                wanted.append(y[use])
                places.append(which[part, live][use])
                held += len(wanted[-1])
                state[live] = run[-1]
                if held > 20_000:
                    flush()
                    states, wanted, places, held = [], [], [], 0
            if held:
                flush()
            lengths = np.diff(offsets) - 1
            words = np.delete(found, offsets[1:] - 1)
            text_of_word = np.repeat(np.arange(n, dtype=np.int32), lengths)
            tail = np.flatnonzero(words == vocabulary.tail_symbol)
            c = vocabulary.known_count(all_hashes[tail])
            logs = np.zeros(len(words))
            own = words < vocabulary.tail_symbol
            logs[own] = head_logs[words[own]]
            logs[tail[c >= 0]] = np.log10(c[c >= 0] + 1.0)
            base = np.bincount(text_of_word, weights=logs, minlength=n) + end_log - (lengths + 1) * math.log10(vocabulary.base_mass)
            tail_logs = np.bincount(text_of_word[tail], weights=logs[tail], minlength=n)
            tail_number = np.bincount(text_of_word[tail], minlength=n)
            score_ = model / LN10 + tail_logs - tail_number * math.log10(vocabulary.tail_mass)
            lacking = tail[c < 0]
            missing = np.bincount(text_of_word[lacking], minlength=n)
            known = lengths - missing + (vocabulary.ends > 0)
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(missing)]), pa.int32()), pa.array(all_hashes[lacking].astype(np.int64)))
            columns = [np.arange(row, row + n), pa.array(names, pa.int64()), lengths + 1, known, base, score_]
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays([*arrays, rest], schema=fields)
            row += n

    return docs.mapInArrow(score, kind)


def language_model_scores(
    docs: DataFrame, held_out: int = HELD_OUT, folds: int = FOLDS, head: int = 4096, known: int = 262_144, hidden: int = 16,
    classes: int = 48, rounds: int = 3, lanes: int = 512, window: int = 32, rate: float = 0.15,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lowered words and one end per text.  Texts whose crc32 of the id leaves ``held_out`` modulo ``folds`` are
    scored but not learned from.  Counts cover all other texts.

    The model reads word by word with a gated recurrent state; the output is a class, then a word of the class.  The
    ``head`` most frequent words are its own; any other word is the tail symbol times its share of the counts outside the
    head, one of which is left for unseen words.  It starts as the unigram model.  In each round every task trains a copy
    on its share of the training texts by truncated backpropagation over windows of ``window`` steps, with the state
    carried from window to window, and the copies are averaged; after ``rounds`` rounds every training text was used
    once.  Whole texts are scored with the state carried from the first word to the end.

    Counts of rare words are joined by their 64-bit hash in a table; only ``head`` and ``known`` of them are sent out.

    Null and empty texts are an end alone.  Null ids count as the text ``null`` for the folds.  Repeated rows are scored
    each and counted each.  An empty table gives an empty result; other columns are ignored.
    """
    plain = texts(docs, id_col, text_col)
    training = plain.filter(id_remainder("doc_id", folds) != held_out)
    counts = cut_lineage(count_words(training))
    vocabulary = learn_vocabulary(counts, training.count(), head, known)
    kinds = gru.Classes.by_mass(vocabulary.symbol_counts(), classes, 2)
    flat = gru.pack(gru.start_parameters(vocabulary.symbol_counts(), kinds, hidden))
    for r in range(rounds):
        share = training.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r)
        mean = average_models(train_round(share, vocabulary, kinds, flat, hidden, lanes, window, rate))
        flat = flat if mean is None else mean
    scored = cut_lineage(score_texts(plain, vocabulary, kinds, flat, hidden, 4 * lanes, window))
    rest = scored.select("row", F.explode("rest").alias("h")).join(counts, "h")
    more = rest.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("logs"), F.count(F.lit(1)).alias("found"))
    logs, found = F.coalesce("logs", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return scored.drop("rest").join(more, "row", "left").select(
        "doc_id",
        (id_remainder("doc_id", folds) == held_out).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + found).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return language_model_scores(read_table(spark, sf_dir, "documents"))
