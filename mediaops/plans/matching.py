"""Exact nearest vectors for many queries at once, without forming all pairs as rows.

Scores are matrix products inside tasks; a task only emits its best ``k`` per query, and
the final choice is a ranked window over those partial lists.  Scores are rounded to
``SCORE_DIGITS`` before they are compared, so that copies of one vector tie exactly in
every batch layout, and ties go to the smaller id.

Two layouts.  When the query side is small (checked with a count) it is broadcast and the
corpus is never shuffled.  Otherwise both sides are cut into even blocks by a hash of the
id and every pair of blocks is matched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.functions.vectors import batch_matrix, unit_rows

SCORE_DIGITS = 6
BROADCAST_QUERIES = 10_000
BLOCK_ROWS = 20_000
TILE_BYTES = 16 << 20  # of scores held at once in a task; choosing the best takes three times as much


def score_tiles(queries: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Rounded scores of some queries at a time against all vectors, at most ``TILE_BYTES`` of them."""
    step = max(1, TILE_BYTES // (8 * max(1, len(vectors))))
    for at in range(0, len(queries), step):
        part = slice(at, min(at + step, len(queries)))
        scores = queries[part] @ vectors.T
        yield part, np.round(scores, SCORE_DIGITS, out=scores)


def best_of_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, other_only: bool
) -> pd.DataFrame:
    """Best ``k`` of ``ids`` for each query, ordered by (score desc, id)."""
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    found: list[pd.DataFrame] = []
    for part, scores in score_tiles(queries, vectors):
        if other_only:
            scores[query_ids[part][:, None] == ids[None, :]] = -np.inf
        least = np.full(len(scores), -np.inf)
        if k < len(ids):
            least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        row, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        value = scores[row, col]
        order = np.lexsort((col, -value, row))
        row, col, value = row[order], col[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        found.append(pd.DataFrame({"query_id": query_ids[part][row[keep]], "match_id": ids[col[keep]], "score": value[keep]}))
    return pd.concat(found, ignore_index=True)


_best = best_of_block


def vector_matrix(column: pd.Series) -> np.ndarray:
    return unit_rows(np.vstack(column.to_numpy()).astype(np.float64))


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str,
    corpus_id: str,
    query_vec: str,
    corpus_vec: str,
    other_only: bool = False,
    broadcast_queries: int = BROADCAST_QUERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows (query_id, match_id, score, rank) with the ``k`` most similar corpus vectors per query.

    Ids are whole numbers.  ``other_only`` leaves out a corpus row with the id of the query.
    """
    schema = T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            T.StructField("match_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    q = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vec).alias("vec")).filter("vec is not null")
    c = corpus.select(F.col(corpus_id).cast("long").alias("id"), F.col(corpus_vec).alias("vec")).filter("vec is not null")

    few = q.limit(broadcast_queries + 1).toPandas()
    if len(few) <= broadcast_queries:
        if few.empty:
            return q.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
        shared = q.sparkSession.sparkContext.broadcast(
            (few["id"].to_numpy(np.int64), vector_matrix(few["vec"]))
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            held: list[pd.DataFrame] = []
            for batch in batches:
                vectors, _ = batch_matrix(batch.column("vec"))
                found = best_of_block(ids, matrix, batch.column("id").to_numpy(), unit_rows(vectors), k, other_only)
                held.append(found)
                if len(held) >= 8:
                    held = [_reduce(held, k)]
            if held:
                yield pa.RecordBatch.from_pandas(_reduce(held, k), preserve_index=False)

        partial = c.mapInArrow(scan, schema)
    else:
        q_blocks = max(1, math.ceil(q.count() / block_rows))
        c_blocks = max(1, math.ceil(c.count() / block_rows))

        def spread(df: DataFrame, side: str, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
            return df.select(
                F.col("id").alias(side + "id"),
                F.col("vec").alias(side + "vec"),
                F.pmod(F.xxhash64("id"), F.lit(own_n)).cast("int").alias(side + own),
                F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(side + other),
            )

        def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({f.name: [] for f in schema.fields})
            return best_of_block(
                left["q_id"].to_numpy(np.int64), vector_matrix(left["q_vec"]),
                right["c_id"].to_numpy(np.int64), vector_matrix(right["c_vec"]), k, other_only,
            )

        left = spread(q, "q_", "qb", q_blocks, "cb", c_blocks)
        right = spread(c, "c_", "cb", c_blocks, "qb", q_blocks)
        pairs = left.groupBy("q_qb", "q_cb").cogroup(right.groupBy("c_qb", "c_cb"))
        partial = pairs.applyInPandas(match, schema)

    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    return partial.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)


def _reduce(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """Best ``k`` per query over several partial lists."""
    joined = pd.concat(parts, ignore_index=True).sort_values(
        ["query_id", "score", "match_id"], ascending=[True, False, True], kind="stable"
    )
    return joined.groupby("query_id", sort=False).head(k).reset_index(drop=True)
