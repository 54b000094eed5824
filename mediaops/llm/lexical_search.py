"""Ranked lexical search: MaxScore over shards of documents, with bounds of term pairs.

The index is dealt by documents.  A shard is one row with the postings of some thousand documents, made where their
texts are read; postings are not shuffled.  Once the counts of the whole corpus are known, every shard gets the
intersection lists of term pairs: which of its documents hold both terms, the highest joint impact among them, and the
highest impact of a document that holds only one.  A query walks its terms from the commonest to the rarest.  The bound
of a prefix of terms is the least sum of single and pair bounds; terms whose prefix cannot reach the ten best found so
far give no candidates, and a candidate is dropped as soon as its score so far and the pair bounds of the rest, taken
by whether the document stands in the intersection list, stay below them.  All results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaops.llm.common import read_table, texts
from mediaops.llm.runs import find_runs, term_bytes
from mediaops.llm.words import BASES, Words, lower_ascii, text_slices
from mediaops.plans.staging import cut_lineage

SHARD_DOCS = 4096
SHARD_BYTES = 16_000_000  # of text; a longer text is a shard of its own
BLOCK_TERMS = 500_000  # terms of the items that are searched together, which bounds what tasks are sent
PAIR_SHARE = 64  # a pair is stored if both terms are in at least one of so many documents
SHARD_SCHEMA = (
    "n_docs long, n_terms long, doc_ids array<long>, lengths binary, terms array<int>, counts array<int>, docs binary, tfs binary"
)
PAIR_SCHEMA = (
    SHARD_SCHEMA + ", impacts binary, tops binary, term_kth binary, pair_ids binary, joint binary, alone binary, "
    "pair_kth binary, members binary"
)
_ARROW = {
    "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "int": pa.int32(),
}


def _fields(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _row(schema: pa.Schema, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def _terms(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = lower_ascii(data)
    return find_runs(data, term_bytes(data), offsets)


def item_terms(items: DataFrame) -> DataFrame:
    """(key, first array<long>, second array<long>): two hashes of each distinct term of the distinct texts ``text``."""
    keyed = items.select("text").distinct().select(F.sha2("text", 256).alias("key"), "text")
    fields = pa.schema([("key", pa.string()), ("first", pa.list_(pa.int64())), ("second", pa.list_(pa.int64()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                words = _terms(data, offsets)
                a, b = (words.hashes(base).view(np.int64) for base in BASES[:2])
                first, second = [], []
                for begin, end in zip(words.first[:-1], words.first[1:]):
                    distinct, at = np.unique(a[begin:end], return_index=True)
                    first.append(distinct)
                    second.append(b[begin:end][at])
                keys = rows.column(rows.schema.get_field_index("key")).cast(pa.string())
                arrays = [keys, pa.array(first, fields[1].type), pa.array(second, fields[2].type)]
                yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return keyed.mapInArrow(split, "key string, first array<long>, second array<long>")


def index_shards(docs: DataFrame, first: np.ndarray, second: np.ndarray) -> DataFrame:
    """Shards of ``docs`` (doc_id, text) with the postings of the terms that have these hashes, ``first`` ascending.

    A term is known by two 64-bit hashes.  Its number is its place in ``first``.
    """
    fields = _fields(SHARD_SCHEMA)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, found, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            term, doc, tf = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(term, kind="stable")
            terms, counts = np.unique(term, return_counts=True)
            values = [int((n > 0).sum()), int(n.sum()), ids, n.tobytes(), terms, counts, doc[order].tobytes(), tf[order].tobytes()]
            return _row(fields, values)

        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                words = _terms(data, offsets)
                a, b = (words.hashes(base).view(np.int64) for base in BASES[:2])
                at = np.minimum(np.searchsorted(first, a), max(len(first) - 1, 0))
                hit = np.flatnonzero((first[at] == a) & (second[at] == b)) if len(first) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(rows.num_rows), words.counts)[hit] + len(ids)
                pair, tf = np.unique(at[hit] << 32 | doc, return_counts=True)
                found.append(((pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int64)))
                ids += rows.column(0).to_pylist()
                lengths.append(words.counts.astype(np.int64))
                size += len(data)
                if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield row()
                    ids, lengths, found, size = [], [], [], 0
        if ids:
            yield row()

    return docs.mapInArrow(build, SHARD_SCHEMA)


@dataclass
class Corpus:
    """Counts of the whole corpus and the queries of one block; term numbers are places in the block's vocabulary."""

    n_docs: int
    n_terms: int
    weights: np.ndarray
    queries: list[np.ndarray]  # terms from the least weight to the largest
    pairs: dict[tuple[int, int], int]
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def of(n_docs: int, n_terms: int, df: np.ndarray, queries: list[np.ndarray]) -> Corpus:
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        common = df * PAIR_SHARE >= max(n_docs, 1)
        ordered = [q[np.lexsort((q, weights[q]))] for q in queries]
        pairs = {p for q in ordered for p in zip(q[:-1].tolist(), q[1:].tolist()) if common[p[0]] and common[p[1]]}
        return Corpus(n_docs, n_terms, weights, ordered, {p: i for i, p in enumerate(sorted(pairs))})


class Shard:
    """One shard at work: postings with impacts, and the lists of term pairs."""

    def __init__(self, row: dict, corpus: Corpus, k: int):
        self.corpus, self.k, self.scored = corpus, k, 0
        self.ids = row["doc_ids"]
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.terms = np.asarray(row["terms"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.asarray(row["counts"], np.int64))])
        self.docs = np.frombuffer(row["docs"], np.int32)
        self.tfs = np.frombuffer(row["tfs"], np.int64)
        self.place = np.full(len(corpus.weights), -1, np.int64)
        self.place[self.terms] = np.arange(len(self.terms))
        if "impacts" in row:
            self.impacts, self.tops = (np.frombuffer(row[c], np.int64) for c in ("impacts", "tops"))
            joint, alone = (np.frombuffer(row[c], np.int64) for c in ("joint", "alone"))
            bits = np.frombuffer(row["members"], np.uint8).reshape(len(joint), -1) if len(joint) else []
            self.pairs = dict(zip(np.frombuffer(row["pair_ids"], np.int32).tolist(), zip(joint.tolist(), alone.tolist(), bits)))

    def slice(self, term: int) -> slice:
        at = self.place[term]
        return slice(self.starts[at], self.starts[at + 1]) if at >= 0 else slice(0, 0)

    def _kth(self, scores: np.ndarray) -> int:
        return int(np.partition(scores, len(scores) - self.k)[len(scores) - self.k]) if len(scores) >= self.k else 0

    def with_pairs(self) -> list:
        """The columns that ``PAIR_SCHEMA`` adds: weighted impacts, their maxima and k-th values, and the pair lists."""
        c = self.corpus
        m = 10 + (90 * self.lengths * c.n_docs) // max(c.n_terms, 1)
        weight = np.repeat(c.weights[self.terms], np.diff(self.starts))
        self.impacts = weight * ((1_000_000_000 * self.tfs) // (1000 * self.tfs + 8 * m[self.docs]))
        each = [self.impacts[a:b] for a, b in zip(self.starts[:-1], self.starts[1:])]
        tops, kth = (np.array([f(x) for x in each], np.int64) for f in (np.max, self._kth))
        ids, joint, alone, pair_kth, members = [], [], [], [], []
        for (a, b), number in c.pairs.items():
            x, y = self.slice(a), self.slice(b)
            if x.stop == x.start or y.stop == y.start:
                continue
            both, i, j = np.intersect1d(self.docs[x], self.docs[y], assume_unique=True, return_indices=True)
            together = self.impacts[x][i] + self.impacts[y][j]
            single = max((int(np.delete(self.impacts[s], at).max(initial=0)) for s, at in ((x, i), (y, j))), default=0)
            inside = np.zeros(len(self.lengths), bool)
            inside[both] = True
            ids.append(number)
            joint.append(int(together.max(initial=0)))
            alone.append(single)
            pair_kth.append(self._kth(together))
            members.append(np.packbits(inside).tobytes())
        numbers = [np.array(x, t).tobytes() for x, t in ((ids, np.int32), (joint, np.int64), (alone, np.int64), (pair_kth, np.int64))]
        return [self.impacts.tobytes(), tops.tobytes(), kth.tobytes(), *numbers, b"".join(members)]

    def best(self, query: int, theta: int, pair_bounds: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of those that may be among the k best, given that k documents score at least ``theta``."""
        all_terms = self.corpus.queries[query].tolist()
        here = [(i, t) for i, t in enumerate(all_terms) if self.place[t] >= 0]
        bounds, steps = [0], [1]  # of the first terms; whether the last is bounded alone or with the one before
        lists: list[tuple | None] = [None]
        for at, (i, t) in enumerate(here):
            alone, step, stored = bounds[-1] + int(self.tops[self.place[t]]), 1, None
            if pair_bounds and at and here[at - 1][0] == i - 1:
                number = self.corpus.pairs.get((here[at - 1][1], t))
                stored = self.pairs.get(number) if number is not None else None
            if stored is not None and (paired := bounds[-2] + max(stored[0], stored[1])) < alone:
                alone, step = paired, 2
            bounds.append(alone)
            steps.append(step)
            lists.append(stored)
        first = max(p for p, b in enumerate(bounds) if p == 0 or b < theta)
        score = np.zeros(len(self.lengths), np.int64)
        for _, t in here[first:]:
            s = self.slice(t)
            score[self.docs[s]] += self.impacts[s]
            self.scored += s.stop - s.start
        found = np.flatnonzero(score)
        if first:
            found = found[score[found] + self._rest(first, found, here, steps, lists) >= theta]
        for p in range(first, 0, -1):
            if not len(found):
                break
            s = self.slice(here[p - 1][1])
            docs = self.docs[s]
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            score[found] += np.where(docs[at] == found, self.impacts[s][at], 0)
            self.scored += len(found)
            found = found[score[found] + bounds[p - 1] >= theta]
        found = found[score[found] >= max(theta, 1)]
        return found, score[found]

    def _rest(self, first: int, found: np.ndarray, here: list, steps: list, lists: list) -> np.ndarray:
        """What the first terms can add to each document: pair bounds by membership in the intersection list."""
        rest = np.zeros(len(found), np.int64)
        while first:
            if steps[first] == 2:
                joint, alone, bits = lists[first]
                member = bits[found >> 3] >> (7 - (found & 7)).astype(np.uint8) & 1
                rest += np.where(member == 1, joint, alone)
            else:
                rest += int(self.tops[self.place[here[first - 1][1]]])
            first -= steps[first]
        return rest


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, keys: list[str], first: list, second: list, k: int) -> DataFrame:
    """(key, rank, doc_id, score) of the queries ``keys``, whose terms have the hashes ``first`` and ``second``."""
    spark = docs.sparkSession
    known, at = np.unique(np.concatenate(first), return_index=True)
    other = np.concatenate(second)[at]
    plain = cut_lineage(index_shards(docs, known, other))
    total = plain.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = np.zeros(len(known), np.int64)
    counted = plain.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    for term, n in counted.collect():  # at most BLOCK_TERMS and one item's
        df[term] = n
    corpus = Corpus.of(total[0], total[1], df, [np.searchsorted(known, np.asarray(x, np.int64)) for x in first])
    fields = _fields(PAIR_SCHEMA)

    def add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _row(fields, [*row.values(), *Shard(row, corpus, k).with_pairs()])

    index = cut_lineage(plain.mapInArrow(add_pairs, PAIR_SCHEMA))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores that k documents of one shard are known to reach, by single terms and by pairs."""
        theta = np.zeros(len(keys), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                term, pair = np.zeros(len(known), np.int64), np.zeros(len(corpus.pairs), np.int64)
                term[row["terms"]] = np.frombuffer(row["term_kth"], np.int64)
                pair[np.frombuffer(row["pair_ids"], np.int32)] = np.frombuffer(row["pair_kth"], np.int64)
                for q, terms in enumerate(corpus.queries):
                    theta[q] = max(theta[q], term[terms].max(initial=0))
                    numbers = [n for p in zip(terms[:-1].tolist(), terms[1:].tolist()) if (n := corpus.pairs.get(p)) is not None]
                    theta[q] = max(theta[q], pair[numbers].max(initial=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys)), pa.int32()), pa.array(theta)], ["query", "theta"])

    seeds = index.select("terms", "term_kth", "pair_ids", "pair_kth").mapInArrow(reached, "query int, theta long")
    corpus.theta = np.zeros(len(keys), np.int64)
    for q, theta in seeds.groupBy("query").agg(F.max("theta")).collect():
        corpus.theta[q] = theta

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = corpus.theta.copy()
        best: list[list[tuple[int, bool, int]]] = [[] for _ in keys]  # (-score, id is null, id)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, corpus, k)
                for q in range(len(keys)):
                    found, scores = shard.best(q, int(theta[q]))
                    if len(found) > k:  # ties stay until ids are compared
                        stays = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                        found, scores = found[stays], scores[stays]
                    named = [(-s, shard.ids[d] is None, shard.ids[d] or 0) for d, s in zip(found.tolist(), scores.tolist())]
                    best[q] = sorted(best[q] + named)[:k]
                    if len(best[q]) == k:
                        theta[q] = max(theta[q], -best[q][-1][0])
        rows = [(q, None if none else i, -s) for q, x in enumerate(best) for s, none, i in x]
        columns = list(zip(*rows)) or [[], [], []]
        arrays = [pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["query", "doc_id", "score"])

    found = index.mapInArrow(search, "query int, doc_id long, score long")
    found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    ranked = _top(_top(found, ["query", "part"], k).drop("part", "rank"), ["query"], k)
    names = spark.createDataFrame(list(enumerate(keys)), "query int, key string")
    return cut_lineage(ranked.join(names, "query").select("key", "rank", "doc_id", "score"))


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The k documents that score highest for each row of ``items``: item_id, rank, doc_id, score.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case.  Items are searched in blocks of
    about ``block_terms`` distinct terms (an item with more is searched whole), each block against all documents.  Work
    is integer arithmetic of 64 bits but for the weights.

    A null or empty text has no terms: such a document is not counted and such an item has no rows.  Equal scores go by
    ascending doc_id, a null id last; rows that repeat an id or a text are documents of their own.  Rows that repeat an
    item_id are searched each by its own text and each give a ranking.  Items that no document matches have no rows; an
    empty table gives an empty result.  Texts are one unit of work each, of any length; other columns are ignored.
    """
    rows = texts(docs, id_col, text_col)
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    terms = cut_lineage(item_terms(asked).filter(F.size("first") > 0))
    blocks = -(-(terms.agg(F.sum(F.size("first"))).first()[0] or 0) // block_terms)
    found = None
    for b in range(blocks):
        block = terms.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).orderBy("key").collect()
        if block:
            part = _search_block(rows, *(list(x) for x in zip(*block)), k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    keyed = asked.select("item_id", F.sha2("text", 256).alias("key"))
    return keyed.join(found, "key").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_SPLIT = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
OP11_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_SPLIT} AS ts FROM documents),
sizes AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM postings, total GROUP BY term, n_docs),
items AS (SELECT i, item_id, term FROM (SELECT i, item_id, unnest(ts) AS term
          FROM (SELECT item_id, row_number() OVER () AS i, {_SPLIT} AS ts FROM benchmark)) GROUP BY ALL),
scored AS (
  SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (r), total GROUP BY i, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
