"""Approximate nearest neighbours by collision counting over sorted projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.llm.common import read_table
from mediaops.plans.staging import cut_lineage

BLOCK_ROWS, QUERY_ROWS = 4096, 4096
PROJECTIONS = 160
WIDTH = 2.0  # of a window for radius 1: a vector at the radius falls into it with probability 0.68
DEVIATIONS = 1.4  # a candidate may collide so many standard deviations less often than a vector at the radius does
GROWTH = 1.1  # of the radius from one virtual rehashing to the next
SAMPLE_ROWS, SAMPLE_VALUES = 8192, 1 << 22  # rows that place the cells, and numbers in them
MOST_CELLS = 1024
CELL_RECALL = 0.98  # share of the sample's neighbours that the cells of a query must hold


def usable(vector: Column) -> Column:
    """No null, no infinite or missing component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class CollisionIndex:
    """Sorted arrays of single projections of some vectors, searched around a query.

    ``verified`` counts the vectors whose distance was computed.
    """

    def __init__(self, vectors: np.ndarray, k: int = 10, projections: int = PROJECTIONS, seed: int = 5):
        n, m = len(vectors), projections
        self.vectors, self.verified = vectors, 0
        self.lines = np.random.default_rng(seed).normal(size=(vectors.shape[1], m))
        placed = (vectors @ self.lines).T
        order = np.argsort(placed, axis=1, kind="stable")
        spread = float(placed.max() - placed.min()) if n else 0.0
        # the arrays lie one behind the other, so that one search finds a window's ends in all of them
        self.shift = np.arange(m) * (2 * spread + 1)
        self.order = np.ascontiguousarray(order).ravel()
        self.sorted = (np.take_along_axis(placed, order, axis=1) + self.shift[:, None]).ravel()
        self.first, self.last = np.arange(m) * n, np.arange(1, m + 1) * n
        self.slack = 1e-9 * (float(np.abs(placed).max()) if n else 0.0)
        self.first_radius = self.start(k)
        share = math.erf(WIDTH / 2 / math.sqrt(2))
        self.least = math.ceil(m * share - DEVIATIONS * math.sqrt(m * share * (1 - share)))

    def start(self, k: int) -> float:
        """A radius below the k-th distances of a few rows, from which windows begin to grow."""
        rows = self.vectors[:: max(1, len(self.vectors) // 8)]
        if len(self.vectors) <= k:
            return 1.0
        kth = [np.partition(((self.vectors - row) ** 2).sum(axis=1), k)[k] for row in rows]
        return max(0.8 * math.sqrt(min(kth)), 0.05 * math.sqrt(max(kth)), 1e-9)

    def search(self, query: np.ndarray, k: int, skip: np.ndarray, bound: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and Euclidean distances of about the k nearest; rows in ``skip`` take no part.

        Windows around the query's own projections grow by a factor; only what a window gains is counted.  A row in
        enough of the windows is verified by its true distance.  The search ends when k verified rows are within the
        radius, or when the windows hold everything.  With ``bound``, the distance of k rows already known elsewhere,
        that radius is the only one.
        """
        n = len(self.vectors)
        at = query @ self.lines + self.shift
        low = high = np.clip(np.searchsorted(self.sorted, at), self.first, self.last)
        counts = np.zeros(n, np.int64)
        done = np.zeros(n, bool)
        done[skip] = True
        rows, distances, near = [np.zeros(0, np.int64)], [np.zeros(0)], 0
        radius = self.first_radius if bound is None else bound
        while True:
            half = WIDTH * radius / 2 + self.slack
            new_low = np.minimum(np.clip(np.searchsorted(self.sorted, at - half, "left"), self.first, self.last), low)
            new_high = np.maximum(np.clip(np.searchsorted(self.sorted, at + half, "right"), self.first, self.last), high)
            ends = [*zip(new_low.tolist(), low.tolist()), *zip(high.tolist(), new_high.tolist())]
            gained = [self.order[a:b] for a, b in ends if a < b]
            low, high = new_low, new_high
            if gained:
                counts += np.bincount(np.concatenate(gained), minlength=n)
                fresh = np.flatnonzero((counts >= self.least) & ~done)
                done[fresh] = True
                rows.append(fresh)
                distances.append(np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1)))
                self.verified += len(fresh)
                near = sum(int((d <= radius).sum()) for d in distances)
            if bound is not None or near >= k or (low == self.first).all() and (high == self.last).all():
                return np.concatenate(rows), np.concatenate(distances)
            radius *= GROWTH


def nearest_cells(points: np.ndarray, centres: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the ``depth`` nearest centres of each point, nearest first."""
    away = (centres**2).sum(axis=1) - 2 * points @ centres.T
    return np.argsort(away, axis=1, kind="stable")[:, :depth]


def place_cells(sample: np.ndarray, cells: int, k: int, recall: float, rounds: int = 8) -> tuple[np.ndarray, int]:
    """Centres of cells by k-means, and how many cells of a query hold a share ``recall`` of its k neighbours.

    The second is measured among the sample, for its first 256 rows.
    """
    centres = sample[:cells].copy()
    for _ in range(rounds):
        own = nearest_cells(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        sizes = np.bincount(own, minlength=len(centres))
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    own = nearest_cells(sample, centres, 1)[:, 0]
    asked = sample[:256]
    away = (sample**2).sum(axis=1) - 2 * asked @ sample.T
    away[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(away, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    if not near.size:
        return centres, len(centres)
    turn = np.argsort(nearest_cells(asked, centres, len(centres)), axis=1)
    needed = np.sort(np.take_along_axis(turn, own[near], axis=1).ravel())
    return centres, int(needed[math.ceil(recall * len(needed)) - 1]) + 1


def nearest_vectors(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, cell_recall: float = CELL_RECALL,
) -> DataFrame:
    """The k nearest of ``vectors`` for each row of ``queries``: query_id, rank (from 1), vec_id, score (distance), query_key.

    Every vector belongs to its nearest cell.  The cells, about one per ``block_rows`` vectors and at most MOST_CELLS,
    are placed by a sample of at most SAMPLE_ROWS rows and SAMPLE_VALUES numbers; a cell is cut into blocks of about
    ``block_rows``, so a hot cell is many tasks.  A block is indexed by its sorted projections.  A query first searches
    one block of its own cell, then, with the k-th distance found there as radius, the other blocks of as many nearest
    cells as held a share ``cell_recall`` of the neighbours in the sample.  Queries that found fewer than k rows there
    search all other cells as well.  A task holds a block and at most about ``query_rows`` queries, and tells k rows
    per query; the best of them are ranked by distance, ties by the smaller id.

    Rows without an id and vectors that are null, zero, or hold null, NaN or infinite components take no part on
    either side.  A query never finds rows with its own id.  Vectors of another length than the query's are never found.
    Other repeated rows are found each.  Query rows with one id and one vector are one query; those with one id and
    several vectors are a ranking each, told apart by query_key, a hash of the vector.  Fewer than k candidates give
    fewer rows; an empty table gives an empty result.  Other columns are ignored.
    """

    def chosen(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        return rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))

    size = chosen(vectors).agg(F.count("*").alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    taken = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // size["dim"]))
    sample = chosen(vectors).orderBy(F.xxhash64("id", "v"), "id").limit(taken).select("dim", "v").toArrow()
    places: dict[int, tuple[np.ndarray, int]] = {}
    for dim in sorted(set(sample.column("dim").to_pylist())):
        rows = np.array([v for v in sample.column("v").to_pylist() if len(v) == dim])
        wanted = math.ceil(size["n"] * len(rows) / sample.num_rows / block_rows)
        places[dim] = place_cells(rows, max(1, min(wanted, MOST_CELLS, len(rows) // 16)), k, cell_recall)

    def placed(df: DataFrame, all_cells: bool) -> DataFrame:
        """With ``cells``, the nearest cells (one, or as many as a query searches), and the row's number in its task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = 0
            for batch in batches:
                table = pa.Table.from_batches([batch])
                dims = table.column("dim").to_numpy()
                cells = [[0]] * len(dims)
                for dim in set(dims.tolist()) & set(places):
                    at = np.flatnonzero(dims == dim)
                    centres, probes = places[dim]
                    points = flat(table.take(pa.array(at)).column("v"), dim)
                    for row, found in zip(at, nearest_cells(points, centres, probes if all_cells else 1).tolist()):
                        cells[row] = found
                numbers = np.arange(number, number + len(dims))
                number += len(dims)
                table = table.append_column("cells", pa.array(cells, pa.list_(pa.int32())))
                yield from table.append_column("number", pa.array(numbers, pa.int64())).to_batches()

        return df.mapInArrow(run, "id long, v array<double>, dim int, cells array<int>, number long")

    here = ["dim", "cell", "part"]
    data = cut_lineage(placed(chosen(vectors), False).select("id", "v", "dim", F.col("cells")[0].alias("cell"), "number"))
    cells = data.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("parts"))
    data = data.join(cells, ["dim", "cell"]).withColumn("part", F.pmod("number", "parts")).drop("number", "parts")
    once = chosen(queries).dropDuplicates(["id", "v"])
    asked = cut_lineage(placed(once, True).withColumn("key", F.xxhash64("v")).drop("number"))

    def visits(rows: DataFrame) -> DataFrame:
        """Queries with the ``parts`` of a cell, at each of its blocks."""
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        return rows.select("id", "key", "v", "bound", *here[:2], every)

    def searched(rows: DataFrame) -> DataFrame:
        """The best k rows of every visited block: query_id, key, vec_id, score."""
        blocks = rows.groupBy(*here).agg(F.ceil(F.count("*") / F.lit(query_rows)).alias("blocks"))
        turn = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("turn")
        left = data.join(blocks, here).select("id", "v", *here, turn)
        right = rows.join(blocks, here).withColumn("turn", F.pmod(F.xxhash64("id", "key"), "blocks")).drop("blocks")
        groups = [df.groupBy(*here, "turn") for df in (left, right)]
        return groups[0].cogroup(groups[1]).applyInArrow(search, "query_id long, key long, vec_id long, score double")

    fields = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows:
            return fields.empty_table()
        dim = ours.column("dim")[0].as_py()
        ids, names = ours.column("id").to_numpy(), theirs.column("id").to_numpy()
        index, points = CollisionIndex(flat(ours.column("v"), dim), k), flat(theirs.column("v"), dim)
        by_id = np.argsort(ids, kind="stable")
        own = [np.searchsorted(ids, names, side, sorter=by_id) for side in ("left", "right")]
        out: list[list[np.ndarray]] = [[], [], [], []]
        rows = zip(names, theirs.column("key").to_numpy(), points, theirs.column("bound").to_pylist(), *own)
        for name, key, point, bound, a, b in rows:
            found, score = index.search(point, k, by_id[a:b], bound)
            best = np.lexsort((ids[found], score))[:k]
            values = (np.full(len(best), name), np.full(len(best), key), ids[found[best]], score[best])
            for column, part in zip(out, values):
                column.append(part)
        return pa.Table.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(out, fields)], schema=fields)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    unbound = F.lit(None).cast("double")
    queried = asked.withColumn("bound", unbound)
    home = queried.withColumn("cell", F.col("cells")[0]).join(cells, ["dim", "cell"], "left_semi")
    first = cut_lineage(searched(home.select("id", "key", "v", "bound", *here[:2], F.lit(0).cast("long").alias("part"))))
    bounds = first.groupBy("query_id", "key").agg(F.when(F.count("*") >= k, F.max("score")).alias("bound"))
    bounds = bounds.withColumnsRenamed({"query_id": "id"})
    turns = queried.drop("bound").join(bounds, ["id", "key"], "left").select("*", F.posexplode("cells").alias("turn", "cell"))
    others = visits(turns.join(cells, ["dim", "cell"])).join(
        home.select("id", "key", "cell", F.lit(0).cast("long").alias("part")), ["id", "key", "cell", "part"], "left_anti"
    )
    found = cut_lineage(best(first.union(searched(others))).drop("rank"))
    full = found.groupBy("query_id", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    short = queried.join(full.withColumnRenamed("query_id", "id"), ["id", "key"], "left_anti")
    rest = visits(short.join(cells, "dim").filter(~F.array_contains("cells", F.col("cell"))))
    if any(probes < len(centres) for centres, probes in places.values()):
        found = found.union(searched(cut_lineage(rest)))
    return best(found).select("query_id", "rank", "vec_id", "score", F.col("key").alias("query_key"))


def flat(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A matrix of vectors of one length."""
    values = [c.flatten() for c in vectors.chunks]
    return (pa.concat_arrays(values).to_numpy(zero_copy_only=False) if values else np.zeros(0)).reshape(-1, dim)


def op4_ann_search(spark, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest_vectors(vectors, vectors.filter("vec_id % 100 = 0"))
