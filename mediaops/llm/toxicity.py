"""Toxic texts: a learned lexicon, matched through Levenshtein automata, with the context of every hit weighed."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import id_remainder, read_table, small_batches, texts, tidy
from mediaops.llm.words import Words, find_words, lower_ascii, text_slices
from mediaops.plans.staging import cut_lineage

HELD_OUT = 5
SAMPLE = 3000  # labelled rows per class that the lexicon and the weights are fitted on
REACH = 8  # words of context on either side of a hit
FEATURES = 5
# Marks and words around a quotation, and characters written for letters.
QUOTES = "\"'«»“”„‘’‹›"
REPORTING = frozenset(
    "said says say saying called calls quote quoted quotes wrote writes term word words phrase so-called "
    "sagte schrieb nannte wort dit écrit appelé mot dijo escribió llamó palabra".split()
)
WRITTEN_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})
_EDGE = re.compile(r"[\W\d_]+")


@dataclass(eq=False)
class Node:
    """A node of the trie; ``edits`` is the most that any term below allows, ``term`` one that ends here."""

    children: dict[str, Node] = field(default_factory=dict)
    term: str | None = None
    stem: bool = False
    allowed: int = 0
    edits: int = 0


def edits_allowed(length: int) -> int:
    """Short terms have too many ordinary neighbours."""
    return 0 if length < 5 else 1 if length < 9 else 2


class LexiconAutomaton:
    """All Levenshtein automata of a lexicon at once, run along its trie.

    A state is the set of (trie node, edits so far) that what was read can stand for; states and their transitions are
    made when first needed and kept.  Terms with a trailing ``*`` are stems that match words beginning with them.  The
    first letter of a word must be right.
    """

    def __init__(self, terms: list[str], most_states: int = 5_000):
        self.root, self.most_states = Node(), most_states
        for term in terms:
            stem = term.endswith("*")
            letters = term.rstrip("*")
            allowed = edits_allowed(len(letters) - 2 * stem)
            node = self.root
            node.edits = max(node.edits, allowed)
            for c in letters:
                node = node.children.setdefault(c, Node())
                node.edits = max(node.edits, allowed)
            node.term, node.stem, node.allowed = term, stem or node.stem, max(node.allowed, allowed)
        self.moves: dict[frozenset, dict[str, frozenset]] = {}
        self.start = frozenset({(self.root, 0)})

    @staticmethod
    def _closed(states: dict[Node, int]) -> frozenset:
        """With letters of terms skipped; per node the fewest edits."""
        todo = list(states.items())
        while todo:
            node, e = todo.pop()
            for child in node.children.values():
                if e + 1 <= child.edits and e + 1 < states.get(child, 99):
                    states[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(states.items())

    def _step(self, state: frozenset, c: str, first: bool) -> frozenset:
        after: dict[Node, int] = {}

        def reach(node: Node, e: int) -> None:
            if e <= node.edits and e < after.get(node, 99):
                after[node] = e

        for node, e in state:
            if c in node.children:
                reach(node.children[c], e)
            if not first:
                reach(node, e + 1)
                for child in node.children.values():
                    reach(child, e + 1)
        return self._closed(after)

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the best match of a lower-case word."""
        state, best = self.start, None
        for i, c in enumerate(word):
            moves = self.moves.get(state)
            if moves is None:
                if len(self.moves) > self.most_states:
                    self.moves = {}
                moves = self.moves[state] = {}
            if c not in moves:
                moves[c] = self._step(state, c, i == 0)
            state = moves[c]
            if not state:
                break
            for node, e in state:
                if node.stem and e <= node.allowed and (best is None or e < best[1]):
                    best = (node.term, e)
        for node, e in state:
            if node.term and e <= node.allowed and (best is None or e < best[1]):
                best = (node.term, e)
        return best


def _without_edge(word: str) -> str:
    edge = _EDGE.match(word)
    return word[edge.end() :] if edge else word


def plain(word: str) -> str:
    """Lower case, without marks and digits at the edges; linear in the length of the word."""
    low = word.lower()
    return low if low.isalpha() else _without_edge(_without_edge(low)[::-1])[::-1]


class Matcher:
    """Which words count as hits: exact ones, and misspelled ones that are not ordinary words themselves."""

    def __init__(self, terms: list[str], ordinary: frozenset[str] = frozenset()):
        self.automaton, self.ordinary = LexiconAutomaton(terms), ordinary

    def look(self, word: str) -> int:
        """0: no hit, 1: exact, 2: misspelled."""
        base = plain(word)
        if len(base) < 3:
            return 0
        found = self.automaton.match(base)
        if found and (found[1] == 0 or base not in self.ordinary):
            return 1 if found[1] == 0 else 2
        low = word.lower()
        written = plain(low.translate(WRITTEN_FOR))
        if written != base and any(c.isalpha() for c in low) and len(written) >= 4:
            found = self.automaton.match(written)
            if found and found[1] == 0:
                return 2
        return 0


def features(words: Words, matcher: Matcher) -> np.ndarray:
    """Per text: 1, and logarithms of direct, misspelled and quoted hits and of hits per hundred words.

    A hit between quotation marks, or with a reporting word in reach, is quoted.  A direct hit with another one in reach
    counts one and a half: abuse comes in runs.
    """
    n = len(words.first) - 1
    out = np.zeros((n, 4))
    if len(words.starts):
        _, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        raw = words.data.tobytes()
        kinds = np.array([matcher.look(raw[a:b].decode("utf-8", "replace")) for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())])
        kind = kinds[inverse]
        hits = np.flatnonzero(kind)
        text = np.searchsorted(words.first, hits, side="right") - 1
        for at, t in zip(hits.tolist(), text.tolist()):
            low, high = max(words.first[t], at - REACH), min(words.first[t + 1], at + REACH + 1)
            before = [words.text(i).decode("utf-8", "replace") for i in range(low, at)]
            itself = words.text(at).decode("utf-8", "replace")
            after = [words.text(i).decode("utf-8", "replace") for i in range(at + 1, high)]
            opened = any(w[0] in QUOTES for w in [*before, itself])
            closed = any(w.rstrip(".,;:!?")[-1:] in QUOTES and w.rstrip(".,;:!?")[-1:] for w in [itself, *after])
            reported = any(plain(w) in REPORTING for w in before + after)
            if (opened and closed) or reported:
                out[t, 2] += 1
            elif kind[at] == 2:
                out[t, 1] += 1
            else:
                out[t, 0] += 1.5 if kind[low:high].astype(bool).sum() > 1 else 1
    counts = np.maximum(words.counts, 1)
    out[:, 3] = 100 * (out[:, 0] + out[:, 1]) / counts
    return np.hstack([np.ones((n, 1)), np.log1p(out)])


def lexicon_features(text: str) -> set[str]:
    """Words of four letters or more of a text, and their stems (four to eight letters, ``*``)."""
    words = {w for w in map(plain, text.split()) if len(w) >= 4}
    return words | {w[:k] + "*" for k in range(4, 9) for w in words if len(w) > k}


def count_features(sample: DataFrame) -> DataFrame:
    """(feature, yes, no): in how many toxic and other texts of ``sample`` (text, toxic) a feature comes.

    Texts of a class that are equal count once.  Tasks add up their texts first and give what they have whenever it is
    much, so that one holds the features of one text and a bounded table.
    """
    fields = pa.schema([("feature", pa.string()), ("yes", pa.int64()), ("no", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, no = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            names = list(yes.keys() | no.keys())
            columns = [pa.array(names, pa.string()), pa.array([yes[f] for f in names], pa.int64()), pa.array([no[f] for f in names], pa.int64())]
            yes.clear()
            no.clear()
            return pa.RecordBatch.from_arrays(columns, schema=fields)

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                (yes if toxic.as_py() else no).update(lexicon_features(text.as_py()))
                if len(yes) + len(no) > 50_000:
                    yield counted()
        if yes or no:
            yield counted()

    distinct = sample.select("text", (F.col("toxic") == 1).alias("toxic")).distinct()
    return distinct.mapInArrow(tidy(count), "feature string, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def learn_lexicon(sample: DataFrame, most: int = 300, support: float = 0.01, purity: float = 0.97) -> list[str]:
    """Words and stems that toxic texts of ``sample`` (text, toxic) contain and other texts do not.

    A feature needs a share ``support`` of the distinct toxic texts, three at least, and a share ``purity`` of its weight
    on them, both classes taken as equally large.  Counts are added up by Spark; only features that pass come to the
    driver.  A longer feature that a stem covers is dropped.  The lexicon has ``most`` terms at most, those that come in
    most toxic texts.
    """
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.countDistinct("text").alias("n")).collect()}
    n_yes, n_no = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    weight = F.col("yes") / n_yes
    against = (F.col("no") + F.when(F.col("no") > 0, 0.5).otherwise(0.0)) / n_no
    passing = count_features(sample).filter((F.col("yes") >= max(3, support * n_yes)) & (weight / (weight + against) >= purity))
    good = {r["feature"]: r["yes"] for r in passing.select("feature", "yes").collect()}
    # A word is the better term than a stem that hardly covers more.
    for f in [f for f in good if f.endswith("*")]:
        inside = [w for w in good if not w.endswith("*") and w.startswith(f[:-1])]
        if inside and max(good[w] for w in inside) >= 0.9 * good[f]:
            del good[f]
    kept: list[str] = []
    for f in sorted(good, key=lambda x: (len(x.rstrip("*")), not x.endswith("*"), x)):
        if not any(s.endswith("*") and f.rstrip("*").startswith(s[:-1]) for s in kept):
            kept.append(f)
    return sorted(sorted(kept, key=lambda f: (-good[f], f))[:most])


def ordinary_words(sample: DataFrame, terms: list[str]) -> frozenset[str]:
    """Words of other texts of ``sample`` that look like misspelled terms; tasks look them up, only those found return."""
    fields = pa.schema([("word", pa.string())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, found = LexiconAutomaton(terms), set()
        for batch in batches:
            for text in batch.column(0):
                words = {plain(w) for w in set(text.as_py().split())}
                found.update(w for w in words if len(w) >= 3 and w not in found and (m := automaton.match(w)) and m[1] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], schema=fields)

    others = sample.filter("toxic = 0").select("text").mapInArrow(tidy(look), "word string")
    return frozenset(r["word"] for r in others.distinct().collect())


def sample_features(sample: DataFrame, terms: list[str], ordinary: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the rows of ``sample`` (doc_id, text, toxic), in the order of their ids: a few numbers a row."""
    fields = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int64()), ("x", pa.list_(pa.float64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, ordinary)
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                x = features(find_words(lower_ascii(data), offsets), matcher)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("toxic"), pa.array(list(x), fields.field("x").type)], schema=fields)

    measured = sample.mapInArrow(tidy(measure), "doc_id long, toxic long, x array<double>").collect()
    measured.sort(key=lambda r: r["doc_id"])
    return np.array([r["x"] for r in measured]), np.array([float(r["toxic"]) for r in measured])


def fit_weights(x: np.ndarray, y: np.ndarray, share: float, penalty: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method; the intercept is moved from the sample's to the given share of ones."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[penalty] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[0] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return w


@dataclass
class ToxicityModel:
    terms: list[str]
    ordinary: frozenset[str]
    weights: list[float]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = HELD_OUT) -> ToxicityModel | None:
    """Fit on at most ``sample`` labelled rows per class, those with the least hash of the id, none of them held out.

    An id that comes with several texts counts with one, that of the least hash; an id with several labels is toxic if
    one of them is.  Null ids, null labels and labels other than 0 and 1 are left out; null texts count as empty.  The
    sampled texts stay in a table, whatever their length: the driver gets terms, words that look like them, and five
    numbers a row.  None without both classes, as for empty tables.
    """
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long"), F.col("toxic").cast("long"))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(id_remainder("doc_id", held_out) != 0)
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    chosen = [marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    few = chosen[0].unionByName(chosen[1])  # two samples at most, so it may be broadcast
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"]
    rows = cut_lineage(texts(docs).join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(least.alias("text")).select("doc_id", "text", "toxic"))
    if rows.select("toxic").distinct().count() < 2:
        return None
    with small_batches(docs.sparkSession):
        terms = learn_lexicon(rows)
        ordinary = ordinary_words(rows, terms)
        x, y = sample_features(rows, terms, ordinary)
    return ToxicityModel(terms, ordinary, fit_weights(x, y, totals[1] / (totals[0] + totals[1])).tolist())


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and score (0 to 1, higher: more likely toxic).

    Whole texts are scored where they are read; every distinct word of a slice of texts runs through the automaton once.
    Null and empty texts get the score of a text without hits.  Without a model every score is 0.  Null ids and repeated
    rows are kept; an empty table gives an empty result; other columns are ignored.
    """
    plain_docs = texts(docs, id_col, text_col)
    if model is None:
        return plain_docs.select("doc_id", F.lit(0.0).alias("score"))
    fields = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, weights = Matcher(model.terms, model.ordinary), np.array(model.weights)
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                x = features(find_words(lower_ascii(data), offsets), matcher)
                values = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(values)], schema=fields)

    return plain_docs.mapInArrow(tidy(score), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``.  Nothing is shuffled.

    Null and empty texts score as texts without hits.  Rows that repeat, null ids and any other columns are kept as they
    are; an empty table stays empty; without a model all rows stay.
    """
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, weights = Matcher(model.terms, model.ordinary), np.array(model.weights)
        for batch in batches:
            only = pa.RecordBatch.from_arrays([pc.fill_null(batch.column(at), "")], ["text"])
            begin = 0
            for rows, data, offsets in text_slices(only):
                x = features(find_words(lower_ascii(data), offsets), matcher)
                clean = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) < threshold
                yield batch.slice(begin, rows.num_rows).filter(pa.array(clean))
                begin += rows.num_rows

    return docs.mapInArrow(tidy(keep), docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (id_remainder("doc_id", HELD_OUT) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
