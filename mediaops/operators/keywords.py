"""First keyword of a list that a text contains, for keyword tables of any length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.plans.staging import cut_lineage

MAX_BYTES, TEXT_ROWS = 16 << 20, 50_000


def automaton(words: list[str], places: list[int]):
    """All words as one automaton, which tells (place, word) of each that occurs."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, place in zip(words, places):
        found.add_word(word, (place, word))
    found.make_automaton()
    return found


def first_hits(numbers: pa.Array, texts: list[str | None], words: list[str], machine) -> dict[str, list]:
    """Number, place and word of the least (place, word) in each text that contains any."""
    out: dict[str, list] = {"number": [], "p": [], "w": []}
    for number, text in zip(numbers.to_pylist(), texts):
        least = min((hit for _, hit in machine.iter(text)), default=None) if text and words else None
        if least:
            out["number"].append(number), out["p"].append(least[0]), out["w"].append(least[1])
    return out


def first_listed(
    texts: DataFrame, keywords: DataFrame, text: str = "text", word: str = "keyword", place: str = "place",
    out: str = "keyword_found", max_bytes: int = MAX_BYTES, text_rows: int = TEXT_ROWS,
) -> DataFrame:
    """``texts`` with the keyword of the least place that the text contains, null where there is none.

    A text is read once, whatever the number of keywords: tasks run an automaton of them all.  Keywords of at most
    ``max_bytes`` go to every task.  A longer list is cut into slices of that size by hash; slices meet texts in groups
    of about ``text_rows``, and the least place of all slices counts.

    Null and empty keywords and places take no part; a word listed twice has its least place, of
    equal places the word smallest by code point counts.  Null texts
    contain nothing.  Repeated rows are kept.
    """
    listed = keywords.select(F.col(word).alias("w"), F.col(place).cast("long").alias("p")).filter("w <> '' and p is not null")
    listed = listed.groupBy("w").agg(F.min("p").alias("p"))
    size = listed.agg(F.coalesce(F.sum(F.octet_length("w") + 8), F.lit(0))).first()[0]
    rows = cut_lineage(texts.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text")).withColumn("number", F.monotonically_increasing_id()))
    fields = pa.schema([("number", pa.int64()), ("p", pa.int64()), ("w", pa.string())])
    if size <= max_bytes:
        known = listed.toArrow()
        words, places = known.column("w").to_pylist(), known.column("p").to_pylist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(words, places)
            for batch in batches:
                found = first_hits(batch.column(0), batch.column(1).to_pylist(), words, machine)
                yield from pa.table(found, fields).to_batches()

        best = rows.select("number", "text").mapInArrow(run, "number long, p long, w string")
    else:
        slices, shares = math.ceil(size / max_bytes), max(1, math.ceil(rows.count() / text_rows))

        def each(n: int):
            return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

        left = rows.select("number", "text", each(slices).alias("slice")).withColumn("share", F.pmod(F.xxhash64("number"), F.lit(shares)))
        right = listed.withColumn("slice", F.pmod(F.xxhash64("w"), F.lit(slices))).select("*", each(shares).alias("share"))

        def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
            if not theirs.num_rows or not ours.num_rows:
                return fields.empty_table()
            words = theirs.column("w").to_pylist()
            machine = automaton(words, theirs.column("p").to_pylist())
            return pa.table(first_hits(ours.column("number"), ours.column("text").to_pylist(), words, machine), fields)

        met = left.groupBy("slice", "share").cogroup(right.groupBy("slice", "share")).applyInArrow(meet, "number long, p long, w string")
        best = met.groupBy("number").agg(F.min(F.struct("p", "w")).alias("b")).select("number", "b.w")
    return rows.join(best.select("number", F.col("w").alias(out)), "number", "left").select("row.*", out)
