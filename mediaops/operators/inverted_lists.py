"""Approximate vector search by inverted lists: every vector is stored with its nearest centre, a query looks into a few.

Stored lists are an ordinary table with a column ``list_no``, written in its order, so a filter on a few lists reads a
few row groups.  The searches of ``search`` run on what ``probe`` leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.functions.vectors import batch_matrix, unit_rows
from mediaops.plans.matching import best_of_block, nearest, vector_matrix
from mediaops.plans.staging import cut_lineage

SAMPLE_ROWS = 50_000  # vectors that the centres are fitted on
BLOCK_ROWS = 20_000


@dataclass
class Centres:
    """Unit vectors of the lists (lists x dimensions): at most the square root of ``SAMPLE_ROWS`` of them."""

    matrix: np.ndarray

    def nearest(self, units: np.ndarray, probes: int) -> np.ndarray:
        """Numbers of the ``probes`` nearest lists of each vector, nearest first."""
        scores = np.round(units @ self.matrix.T, 9)
        return np.argsort(-scores, axis=1, kind="stable")[:, :probes]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(self.matrix)]
        spark.createDataFrame(rows, "list_no int, centre array<double>").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Centres:
        return Centres(np.array([r.centre for r in spark.read.parquet(path).orderBy("list_no").collect()]))


def fit_centres(vectors: DataFrame, lists: int | None = None, id_col: str = "id", vec: str = "embedding", sample: int = SAMPLE_ROWS, rounds: int = 15) -> Centres:
    """Centres by k-means on directions, over the ``sample`` vectors with the least hash of the id.

    ``lists`` defaults to the square root of the number of sampled vectors.  Zero and null vectors have no direction
    and take no part.
    """
    usable = vectors.filter(F.col(vec).isNotNull() & F.exists(vec, lambda x: x != 0))
    picked = usable.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    picked = cut_lineage(picked)
    count = picked.count()
    if not count:
        return Centres(np.zeros((1, 1)))
    model = KMeans(k=min(count, lists or max(1, math.isqrt(count))), maxIter=rounds, seed=7, distanceMeasure="cosine").fit(picked)
    return Centres(unit_rows(np.array(model.clusterCenters())))


def to_lists(vectors: DataFrame, centres: Centres, vec: str = "embedding") -> DataFrame:
    """``vectors`` with the number of their list; a null or zero vector is in list 0."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("list_no", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vec))
            number = np.zeros(batch.num_rows, np.int32)
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            if len(there):
                units = unit_rows(batch_matrix(column.take(pa.array(there)))[0])
                number[there] = np.where((units != 0).any(axis=1), centres.nearest(units, 1)[:, 0], 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=[*batch.schema.names, "list_no"])

    return vectors.mapInArrow(assign, schema)


def save_lists(vectors: DataFrame, centres: Centres, path: str, vec: str = "embedding") -> None:
    """Store vectors by their list: files hold ranges of lists and are sorted by them."""
    to_lists(vectors, centres, vec).repartitionByRange("list_no").sortWithinPartitions("list_no").write.parquet(f"{path}/vectors")
    centres.save(vectors.sparkSession, f"{path}/centres")


def load_lists(spark: SparkSession, path: str) -> tuple[DataFrame, Centres]:
    return spark.read.parquet(f"{path}/vectors"), Centres.load(spark, f"{path}/centres")


def tune_probes(
    stored: DataFrame, centres: Centres, k: int, recall: float = 0.92, queries: int = 200, id_col: str = "id", vec: str = "embedding"
) -> int:
    """The fewest lists to look into that hold ``recall`` of the true ``k`` nearest of some sampled rows.

    The ``queries`` rows with the least hash of the id are searched exactly; what is collected is ``k`` list numbers for
    each.  Vectors in clear groups need few lists; the less structure they have, the more.
    """
    usable = stored.filter(F.col(vec).isNotNull() & F.exists(vec, lambda x: x != 0))
    picked = cut_lineage(usable.orderBy(F.xxhash64(id_col, F.lit(1)), id_col).limit(queries).select(F.col(id_col).cast("long").alias("query_id"), vec))
    found = nearest(picked, usable, k, "query_id", id_col, vec, vec, other_only=True)
    lists = usable.select(F.col(id_col).cast("long").alias("match_id"), "list_no")
    hits = found.join(lists, "match_id").groupBy("query_id").agg(F.collect_list("list_no").alias("lists")).join(picked, "query_id").collect()
    if not hits:
        return 1
    order = centres.nearest(vector_matrix(pd.Series([h[vec] for h in hits])), len(centres.matrix))
    places = np.sort([int(np.flatnonzero(row == n)[0]) for row, h in zip(order, hits) for n in h["lists"]])
    return int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) + 1


def probe(stored: DataFrame, centres: Centres, query: Sequence[float], probes: int) -> DataFrame:
    """The rows of the lists nearest to one vector, as a filter that the scan applies."""
    numbers = centres.nearest(unit_rows(np.asarray([query], np.float64)), probes)[0]
    return stored.filter(F.col("list_no").isin([int(n) for n in numbers]))


def knn_join_lists(
    queries: DataFrame, stored: DataFrame, centres: Centres, k: int, probes: int, id_col: str = "id", vec: str = "embedding",
    other_only: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows (query_id, match_id, score, rank): the ``k`` most similar vectors in the ``probes`` nearest lists of each query.

    Queries meet the lists by an equi-join on the list number, as blocks: a task multiplies a block of queries with a
    block of one list and emits its best ``k`` per query, never pairs.  A long list is cut into blocks of ``block_rows``,
    its queries likewise.
    """
    schema = "query_id long, match_id long, score double"
    fields = "id long, vec array<double>, list_no int"
    plain = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter("vec is not null")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = centres.nearest(vector_matrix(pdf["vec"]), probes)
                for place in range(near.shape[1]):  # a list at a time: a batch is never repeated in memory
                    yield pdf.assign(list_no=near[:, place])

    asked = cut_lineage(plain.mapInPandas(ask, fields))
    held = stored.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"), "list_no").filter("vec is not null")
    sides = []
    for rows in (asked, held):
        counts = rows.groupBy("list_no").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
        sides.append((rows, cut_lineage(counts)))  # one row per list

    def spread(own: int, mine: str, theirs: str) -> DataFrame:
        rows, counts = sides[own]
        other = sides[1 - own][1].withColumnRenamed("blocks", "others")
        joined = rows.join(F.broadcast(counts), "list_no").join(F.broadcast(other), "list_no")
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias(mine)
        return joined.select("id", "vec", "list_no", block, F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias(theirs))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["query_id", "match_id", "score"])
        return best_of_block(left["id"].to_numpy(np.int64), vector_matrix(left["vec"]), right["id"].to_numpy(np.int64), vector_matrix(right["vec"]), k, other_only)

    keys = ["list_no", "q", "c"]
    partial = spread(0, "q", "c").groupBy(*keys).cogroup(spread(1, "c", "q").groupBy(*keys)).applyInPandas(match, schema)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    return partial.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
