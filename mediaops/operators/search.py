"""Vector search over segments, entities and detections, top-k and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaops.functions.vectors import cosine_to
from mediaops.plans.matching import SCORE_DIGITS, nearest


def hybrid_search(
    segments: DataFrame,
    query: Sequence[float] | None,
    limit: int = 10,
    media: str | None = None,
    confidence: str | None = None,
    id_col: str = "id",
) -> DataFrame:
    """Top ``limit`` segments by the mean of two similarities (one when the second vector is missing).

    ``query`` is the embedded text, None for a blank text, which finds nothing.  Filters come
    before the scores, so they reach the scan; the ranking is a take-ordered, which sends
    ``limit`` rows per partition to the driver side merge.
    """
    hits = segments
    if media is not None:
        hits = hits.filter(F.col("media") == media)
    if confidence is not None:
        hits = hits.filter(F.col("confidence") == confidence)
    if query is None:
        hits, query = hits.limit(0), [0.0]
    scored = hits.select(
        *[c for c in hits.columns if c not in ("embedding", "search_terms_embedding")],
        F.round(cosine_to("embedding", query), SCORE_DIGITS).alias("desc_score"),
        F.round(cosine_to("search_terms_embedding", query), SCORE_DIGITS).alias("_second"),
    )
    ranked = scored.select(
        "*",
        F.coalesce("_second", F.lit(0.0)).alias("search_score"),
        F.round(
            F.when(F.col("_second").isNotNull(), 0.5 * F.col("desc_score") + 0.5 * F.col("_second")).otherwise(
                F.col("desc_score")
            ),
            SCORE_DIGITS,
        ).alias("relevance_score"),
    ).drop("_second")
    return ranked.orderBy(F.desc("relevance_score"), id_col).limit(limit)


def nearest_to(
    table: DataFrame, query: Sequence[float], limit: int, vec: str = "embedding", id_col: str = "id"
) -> DataFrame:
    """Top ``limit`` rows by similarity to one vector, with the cosine distance."""
    score = F.round(cosine_to(vec, query), SCORE_DIGITS)
    scored = table.withColumn("similarity", score).drop(vec)
    return (
        scored.withColumn("distance", F.round(1 - F.col("similarity"), SCORE_DIGITS))
        .orderBy(F.desc("similarity"), id_col)
        .limit(limit)
    )


def similar_above(
    table: DataFrame,
    query: Sequence[float],
    threshold: float,
    limit: int,
    vec: str = "embedding",
    id_col: str = "id",
) -> DataFrame:
    """Rows with similarity of at least ``threshold``, best ``limit`` of them."""
    scored = table.withColumn("similarity", F.round(cosine_to(vec, query), SCORE_DIGITS)).drop(vec)
    return scored.filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), id_col).limit(limit)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "id", vec: str = "embedding", **kw) -> DataFrame:
    """Exact ``k`` nearest corpus rows for every query row; ``inverted_lists.knn_join_lists`` is the approximate form."""
    return nearest(queries, corpus, k, id_col, id_col, vec, vec, **kw)


def page(table: DataFrame, order: Sequence[str], limit: int, offset: int) -> tuple[DataFrame, DataFrame]:
    """One page in a fixed order, and the one-row total for the pager."""
    rows = table.orderBy(*order).offset(offset).limit(limit)
    return rows, table.agg(F.count(F.lit(1)).alias("total"))


def first_per_key(table: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First ``n`` rows of each key; the rank limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def first_minutes(frames: DataFrame, minutes: float, fps: str = "fps") -> DataFrame:
    """Frames of the first minutes of each media: row number up to int(minutes * 60 * fps).

    Frame indexes count from 0 per media, so the row number needs no window.
    """
    return frames.filter(F.col("frame_no") < F.floor(F.lit(minutes * 60) * F.col(fps)))
