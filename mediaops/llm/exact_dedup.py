"""Exact duplicates by a 128-bit content hash, with the bytes compared inside every group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import fresh, read_table, spread_join, texts, without
from mediaops.plans.staging import cut_lineage

SALTS = 64
BROADCAST_HASHES = 500_000  # at 16 bytes each; beyond it the filter is a shuffled join


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hashed: Callable[[Column], Column] = content_hash,
    max_broadcast: int = BROADCAST_HASHES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a 128-bit hash of the text.  Texts are moved only for hashes that occur more than once: there
    (hash, text) is grouped again, so equal hashes of different texts become separate groups.  ``keep`` names the id
    that stays, ``smallest`` or ``largest``.  A hot group is counted per salt before its hash is gathered.

    A null text counts as empty, empty texts are equal to each other.  A null id stays only in a group without other
    ids.  Rows that repeat an id with the same text are all counted, and all get the verdict of that id.  An empty
    table gives an empty result; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.min if keep == "smallest" else F.max
    rows = texts(docs, id_col, text_col).withColumn("h", hashed(F.col("text")))
    digests = cut_lineage(rows.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("sha")))
    repeated = digests.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    repeated = cut_lineage(repeated)
    few = repeated.count() <= max_broadcast
    copies = rows.join(F.broadcast(repeated) if few else repeated, "h", "left_semi")
    # Grouping by the text itself compares the bytes; copies collapse before the shuffle.
    classes = copies.groupBy("h", "text").agg(F.count(F.lit(1)).alias("n"))
    collided = cut_lineage(classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    keyed = digests.withColumn("g", F.col("h"))
    if not collided.isEmpty():
        mixed = rows.join(collided, "h", "left_semi")
        named = mixed.withColumn("g", F.concat("h", F.col("text").cast("binary")))
        apart = named.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("sha"), "g")
        keyed = keyed.join(collided, "h", "left_anti").select("doc_id", "h", "sha", "g").unionByName(apart)
    keyed = keyed.select("doc_id", "sha", "g").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = keyed.groupBy("g", "salt").agg(F.count(F.lit(1)).alias("n"), best("doc_id").alias("best"))
    groups = parts.groupBy("g").agg(
        F.sum("n").alias("group_size"), best("best").alias("keep_id"), F.collect_set("salt").alias("salts")
    )
    return spread_join(keyed, groups, "g", "salt").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which no equal text with a better id exists.

    Rows that repeat the id and the text of a row that stays are dropped too: one of them stays.
    """
    found = cut_lineage(exact_duplicates(docs, id_col, text_col, keep).withColumn("_sha", F.unhex("text_sha256")))
    return rows_that_stay(docs, found.select(F.col("doc_id").alias("_id"), "_sha", "kept"), id_col, text_col)


def rows_that_stay(docs: DataFrame, named: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``named`` (_id, _sha, kept), a written table, keeps, and one of rows that repeat both."""
    key, sha, other_key, other_sha = fresh(docs, "_id", "_sha", "_i", "_s")
    rows = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)))
    rows = rows.withColumn(key, F.col(f"`{id_col}`").cast("long"))
    named = named.select(F.col("_id").alias(key), F.col("_sha").alias(sha), "kept")
    left = without(rows, cut_lineage(named.filter("not kept").select(key, sha).distinct()), [key, sha])
    twice = named.filter("kept").groupBy(key, sha).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, sha)
    twice = cut_lineage(twice)
    if not twice.isEmpty():
        same = F.col(key).eqNullSafe(F.col(other_key)) & (F.col(sha) == F.col(other_sha))
        again = left.join(twice.select(F.col(key).alias(other_key), F.col(sha).alias(other_sha)), same)
        left = without(left, twice, [key, sha]).unionByName(again.drop(other_key, other_sha).dropDuplicates([key, sha]))
    return left.drop(sha, key).select(*docs.columns)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"), keep="largest")


OP7_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""
