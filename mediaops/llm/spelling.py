"""Spelling variants: words of a corpus that differ by one code point, found with a bidirectional FM index.

A word at one edit from another keeps its left or its right half.  Words are dealt by what both halves must share: their
length and as many first (or last) letters as the half of any word beside it has at least.  Each deal is indexed as a
delimited vocabulary; a word asks the deals of its own prefix and suffix for words of its length and of one more and one
less, matches the half exactly and lets the other half differ once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import read_table, texts
from mediaops.llm.fm_index import BidirectionalIndex, one_error
from mediaops.llm.runs import find_runs, latin_letters
from mediaops.llm.words import BASES, Words, lower_ascii, text_slices
from mediaops.plans.staging import cut_lineage

SHARD_WORDS = 20_000
HELD_WORDS = 200_000  # distinct words that a task counts before it passes them on
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def crc32_after(prefix: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = 64) -> np.ndarray:
    """crc32 of data[start:end] that follow bytes whose crc32 is ``prefix``; runs over ``long`` bytes one by one."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, long + 1), kind="stable")
    ordered, place = np.minimum(lengths, long + 1)[order], starts[order]
    state = ~prefix[order].astype(np.uint32)
    many = int(np.searchsorted(-ordered, -long, side="left"))  # the longer ones come first
    for p in range(int(ordered[many]) if many < len(order) else 0):
        n = int(np.searchsorted(-ordered, -p, side="left"))
        s = state[many:n]
        state[many:n] = _CRC[(s ^ data[place[many:n] + p]) & 0xFF] ^ s >> np.uint32(8)
    result = np.empty(len(order), np.int64)
    result[order] = ~state
    for i in order[:many].tolist():
        result[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(prefix[i]))
    return result


def _count_slice(ids: list, data: np.ndarray, offsets: np.ndarray, least: int, damage: int) -> Counter:
    """Words of one slice of texts with their counts; a run whose checksum ``damage`` divides loses one code point."""
    runs = find_runs(data, latin_letters(data), offsets)
    data = lower_ascii(data)
    pairs = np.concatenate([[0], np.cumsum(data == 0xC3)])  # letters of two bytes
    points = runs.ends - runs.starts - (pairs[runs.ends] - pairs[runs.starts])
    keep = np.flatnonzero(points >= least)
    starts, ends = runs.starts[keep], runs.ends[keep]
    doc = np.repeat(np.arange(len(ids)), runs.counts)[keep]
    prefix = np.array([zlib.crc32(f"{'null' if i is None else i}:".encode()) for i in ids], np.int64)
    h = crc32_after(prefix[doc], data, starts, ends)
    hurt = h % damage == 0 if damage else np.zeros(len(h), bool)
    found: Counter = Counter()
    for at in np.flatnonzero(hurt).tolist():
        word = data[starts[at] : ends[at]].tobytes().decode()
        gone = int(h[at]) % len(word)
        if len(word) > least:
            found[word[:gone] + word[gone + 1 :]] += 1
    whole = Words(data, starts[~hurt], ends[~hurt], np.zeros(0, np.int64))
    a, b = (whole.hashes(base) for base in BASES[:2])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    for at, n in zip(order[new].tolist(), np.diff(np.append(new, len(a))).tolist()):
        found[whole.text(at).decode()] += n
    return found


def count_words(docs: DataFrame, least: int = 5, damage: int = 97) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) of at least ``least`` code points and how often they occur."""
    fields = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=fields)
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                held.update(_count_slice(rows.column(0).to_pylist(), data, offsets, least, damage))
                if len(held) > HELD_WORDS:
                    yield out()
                    held = Counter()
        yield out()

    return docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _share(length: Column) -> Column:
    """Letters at either end that a word of this length has in common with a neighbour that keeps that half."""
    return F.floor((length - 1) / 2).cast("int")


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near, near_n) for every ordered pair of ``words`` (word, n; distinct, a written table) at one edit.

    Deals by (end, length, letters at that end) have an expected size of ``shard_words``.  Letters that more words share
    are dealt as a grid of blocks of words and blocks of those that ask, so no task holds more.
    """
    length = F.length("word")
    ends = lambda n: (F.struct(F.lit(True).alias("left"), F.left("word", n).alias("key")), F.struct(F.lit(False).alias("left"), F.right("word", n).alias("key")))
    size = words.count()
    shards = max(1, -(-2 * size // shard_words))
    stored = words.select("word", "n", length.alias("length"), F.explode(F.array(*ends(_share(length)))).alias("e"))
    stored = stored.select("word", "n", "length", "e.*", F.lit(None).cast("int").alias("change"))
    asks = words.select("word", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("change"))
    asks = asks.withColumn("length", length + F.col("change")).filter("length >= 2")
    asks = asks.select("word", F.lit(None).cast("long").alias("n"), "length", F.explode(F.array(*ends(_share(F.col("length"))))).alias("e"), "change")
    asks = asks.select("word", "n", "length", "e.*", "change")
    crowded = stored.groupBy("left", "length", "key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > shard_words)
    crowded = cut_lineage(crowded.withColumn("grid", F.ceil(F.col("size") / shard_words).cast("int")).drop("size"))
    rows = stored.unionByName(asks).withColumn("block", F.lit(0)).withColumn("asker", F.lit(0))
    if not crowded.isEmpty():  # at most one row per ``shard_words`` entries
        rows = rows.drop("block", "asker").join(F.broadcast(crowded), ["left", "length", "key"], "left")
        own, every = F.pmod(F.xxhash64("word"), F.coalesce("grid", F.lit(1))), F.sequence(F.lit(0).cast("long"), F.coalesce("grid", F.lit(1)).cast("long") - 1)
        asking = F.col("change").isNotNull()
        rows = rows.withColumn("block", F.explode(F.when(asking, every).otherwise(F.array(own))))
        rows = rows.withColumn("asker", F.explode(F.when(asking, F.array(own)).otherwise(every))).drop("grid")
    shard = F.pmod(F.xxhash64("length", "key", "block", "asker"), F.lit(shards))
    dealt = rows.select("left", shard.alias("shard"), "block", "asker", "word", "n", "change")
    fields = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def search(table: pa.Table) -> pa.Table:
        asking = table.column("change").is_valid()
        entries = dict(zip(*(table.filter(pc.invert(asking)).column(c).to_pylist() for c in ("word", "n"))))
        wanted = table.filter(asking)
        asked = sorted(set(zip(wanted.column("word").to_pylist(), wanted.column("change").to_pylist())))
        if not entries or not asked:
            return fields.empty_table()
        left, known = table.column("left")[0].as_py(), sorted(entries)
        patterns = [w for w, _ in asked]
        who, met = one_error(BidirectionalIndex(known), patterns, np.array([c for _, c in asked], np.int64), left)
        pairs = [(patterns[q], known[m]) for q, m in zip(who.tolist(), met.tolist())]
        if not left:  # a pair that keeps both halves is met from the left
            pairs = [(w, v) for w, v in pairs if v[: len(w) // 2] != w[: len(w) // 2]]
        columns = [[w for w, _ in pairs], [v for _, v in pairs], [entries[v] for _, v in pairs]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    # A word has one block and one asker a deal, so with these in the key each pair meets once.
    return dealt.groupBy("left", "shard", "block", "asker").applyInArrow(search, "word string, near string, near_n long")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): where the links ``forms`` (word, form) end; each round doubles the steps, links have no cycle."""
    state = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("far"))
        state = cut_lineage(state.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.select("word", "root")
        state = state.drop("moved")


def spelling_variants(
    docs: DataFrame, least_points: int = 5, least_count: int = 3, ratio: int = 2, damage: int = 97,
    shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per frequent word: word, form, root, n, n_near, form_n.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case, of at least ``least_points`` code points and
    ``least_count`` occurrences.  ``form`` is the most frequent word at one inserted, deleted or replaced code point
    (ties: the first in code-point order) if it is ``ratio`` times as frequent; ``root`` is where forms lead.
    ``damage`` makes known misspellings: a run loses one code point where the checksum of ``<doc_id>:<run>`` is a
    multiple of it (0: never).

    A null text has no words, a null id reads ``null`` in the checksum.  Rows that repeat an id or a text are all
    counted.  Texts are one unit of work each, of any length; a word may
    have any length too, its search takes a step per letter.  An empty table gives an empty
    result; other columns are ignored.
    """
    counted = count_words(texts(docs, id_col, text_col), least_points, damage)
    words = cut_lineage(counted.filter(F.col("n") >= least_count))
    best = near_words(words, shard_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    taken = -F.col("best.less") >= ratio * F.col("n")
    judged = cut_lineage(
        words.join(best, "word", "left").select(
            "word",
            F.when(taken, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(taken, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = follow(judged.filter(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
OP12_SQL = f"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, CAST(i AS BIGINT), 0 FROM range(256) r(i) UNION ALL SELECT i, {_STEP}, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS times FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
coded AS (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(
    list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))) AS h FROM coded, crc),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
            FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cuts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut
         FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT c.word, c.n, w.word AS near, w.n AS near_n FROM cuts c JOIN words w ON c.cut = w.word),
pairs AS (SELECT * FROM shorter UNION ALL SELECT near, near_n, word, n FROM shorter
          UNION ALL SELECT DISTINCT a.word, a.n, b.word, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
                row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
                  CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
           FROM words w LEFT JOIN best b ON w.word = b.word AND place = 1),
walk(word, root, depth) AS (SELECT word, word, 0 FROM judged UNION ALL
  SELECT walk.word, form, depth + 1 FROM walk JOIN judged ON root = judged.word WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(root, depth) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN roots USING (word)
"""
