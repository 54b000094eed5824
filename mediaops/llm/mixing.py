"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.llm.common import WORD, read_table
from mediaops.plans.staging import cut_lineage

MAX_EPOCHS = 3
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}  # by labels.quality; documents without a label weigh 1


def sampling_key(id_col: str, weight: Column, seed: str) -> Column:
    """Exponential variate with rate ``weight``: the smallest keys are the weighted sample without replacement.

    The uniform number is the first 13 hex digits of md5(seed:id), so that reruns and other engines agree; a null id
    reads as the hash of the text in ``text_md5``.
    """
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.col("text_md5")))
    uniform = (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1.0) / float(2**52 + 1)
    return -F.log(uniform) / weight


def source_targets(totals: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Targets of sources (rows: src, source_size, n): cyclic weights in code-point order, null last, shared totals.

    A target stops at ``max_epochs`` times its source; what is over is shared again by weight until none is above.
    The fixed point in closed form: order sources by cap over weight; the first k of them are full, where k is the
    smallest number for which the level (what is left over the weights that are left) is below the next ratio.  The
    windows run over one row per source.
    """
    order = Window.orderBy(F.col("src").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    cyclic = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("pos", F.row_number().over(order)).withColumn(
        "w", F.element_at(cyclic, ((F.col("pos") - 1) % len(weights) + 1).cast("int"))
    )
    t = t.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, -1)
    t = (
        t.withColumn("full", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("weights", F.sum("w").over(every))
        .withColumn("level", (F.col("total") - F.col("full")) / (F.col("weights") - F.col("used")))
        .withColumn("open", F.col("level") <= F.col("ratio"))
        .withColumn("last", F.min(F.when(F.col("open"), F.struct("ratio", "pos", "level"))).over(every))
    )
    target = F.when(F.struct("ratio", "pos") < F.struct("last.ratio", "last.pos"), F.col("cap")).otherwise(
        F.col("last.level") * F.col("w")
    )
    return t.select("src", "source_size", "n", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: int = MAX_EPOCHS,
    quality_weights: dict[int, float] | None = None,
    seed: str = "mix",
) -> DataFrame:
    """How many words of each document a mix takes: doc_id, source, size, source_size, target, taken, times, text_md5.

    A target of e whole source sizes and a rest takes every document e times (complete epochs), then documents in
    the order of exponential keys scaled by quality weight until the rest is reached; the document on the border is
    taken when that comes nearer to the target.  Documents are taken whole, so ``taken`` is ``times * size``.

    ``quality`` (doc_id, quality) gives the weights.  Keys fall into about sqrt(n) order-preserving buckets per source;
    sums run over buckets, then inside a bucket, so that no task sees a whole source.

    A null text has size 0 and is taken in the order of its key like any other.  A null source is a source, the last
    one.  A null id has a key by its text.  Ties are ordered by id, size and hash of the text (``text_md5``), so the same
    rows give the same result in any order.  Repeated rows are separate documents.  An empty table gives an empty
    result; other columns are ignored.
    """
    quality_weights = quality_weights or QUALITY_WEIGHTS
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )
    weight = F.lit(1.0)
    if quality is not None:
        marks = quality.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
        rows = rows.join(marks, "doc_id", "left")
        for value, w in quality_weights.items():
            weight = F.when(F.col("q") == value, F.lit(float(w))).otherwise(weight)
    rows = cut_lineage(rows.select("doc_id", "src", "size", "text_md5", sampling_key("doc_id", weight, seed).alias("key")))
    totals = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = cut_lineage(source_targets(totals, weights, max_epochs)).withColumnRenamed("src", "tsrc")
    buckets = F.ceil(F.sqrt(F.col("n")))
    placed = rows.join(targets, F.col("src").eqNullSafe(F.col("tsrc"))).drop("tsrc")
    placed = placed.withColumn("bucket", F.floor(buckets * (1 - F.exp(-F.col("key")))))
    sums = placed.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("src").alias("bsrc"), F.col("bucket").alias("bbucket"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")
    )
    joined = placed.join(starts, F.col("src").eqNullSafe(F.col("bsrc")) & (F.col("bucket") == F.col("bbucket")))
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size", "text_md5").rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ranked = joined.withColumn("prior", F.col("base") + F.sum("size").over(inside) - F.col("size")).withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    times = F.col("epochs") + F.when((F.col("prior") + F.col("size") / 2.0) < rest, 1).otherwise(0)
    times = F.least(times, F.lit(max_epochs)).cast("long")
    return ranked.withColumn("times", times).select(
        "doc_id", F.col("src").alias("source"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times", "text_md5"
    )


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH marks AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source AS src, md5(coalesce(d.text, '')) AS text_md5,
         CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, '')))), 1, 13) AS BIGINT) AS DOUBLE) + 1.0)
             / 4503599627370497.0) / CASE m.q WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id),
s AS (SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src NULLS LAST) AS pos FROM d GROUP BY src),
w AS (SELECT *, ((pos - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER o, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0::DOUBLE)) AS level
      FROM r WINDOW o AS (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT ratio, pos, level FROM l WHERE level <= ratio ORDER BY ratio, pos LIMIT 1),
t AS (SELECT l.src, l.source_size,
             CASE WHEN l.ratio < k.ratio OR (l.ratio = k.ratio AND l.pos < k.pos) THEN l.cap ELSE k.level * l.w END AS target FROM l, k),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
             sum(d.size) OVER (PARTITION BY d.src ORDER BY d.key, d.doc_id NULLS FIRST, d.size, d.text_md5 ROWS UNBOUNDED PRECEDING) - d.size AS prior
      FROM d JOIN t ON d.src IS NOT DISTINCT FROM t.src)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, epochs + CASE WHEN prior + size / 2.0 < target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
