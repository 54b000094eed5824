"""Entity clustering of embedding vectors: online per media, and average linkage.

Both operators give exactly the result of the sequential definition.  A media whose rows
fit a bounded group is clustered in one grouped call.  A larger media is never gathered:
see ``_online_large`` and ``_linkage_large``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.functions.vectors import unit_rows
from mediaops.plans.components import connected
from mediaops.plans.matching import SCORE_DIGITS, TILE_BYTES, score_tiles
from mediaops.plans.staging import cut_lineage

ONLINE_ROWS = 50_000
LINKAGE_ROWS = 3_000
LEADERS_PER_ROUND = 2_000
MERGE_TABLES = 16  # of pairs that rounds merged, before they become one
SLOW = 50  # a round is slow for a media if it merges fewer pairs than one in so many clusters


def _units(column: pd.Series) -> np.ndarray:
    return unit_rows(np.vstack(column.to_numpy()).astype(np.float64))


def _assign(units: np.ndarray, threshold: float, policy: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequential rule on ordered unit vectors: (entity number per row, row of each leader)."""
    labels = np.empty(len(units), np.int64)
    leaders: list[int] = []
    known = np.empty((16, units.shape[1]))
    for i, u in enumerate(units):
        k = len(leaders)
        sims = np.round(known[:k] @ u, 12)
        if k and sims.max() >= threshold:
            labels[i] = int(sims.argmax() if policy == "best" else np.argmax(sims >= threshold))
            continue
        if k == len(known):
            known = np.vstack([known, np.empty_like(known)])
        known[k] = u
        labels[i] = k
        leaders.append(i)
    return labels, np.asarray(leaders, np.int64)


def online_clusters(
    detections: DataFrame,
    threshold: float,
    policy: str = "best",
    media: str = "media",
    order: Sequence[str] = ("t", "id"),
    id_col: str = "id",
    vec: str = "embedding",
    group_rows: int = ONLINE_ROWS,
    leaders_per_round: int = LEADERS_PER_ROUND,
) -> DataFrame:
    """Rows (media, id, entity_no) by the one-pass rule, entities numbered from 1 in order of creation.

    Each detection, in time order, joins the most similar existing entity with similarity of
    at least ``threshold`` (``policy="first"``: the earliest such entity) or opens a new one,
    whose representative stays its first vector.
    """
    rows = detections.filter(F.col(vec).isNotNull()).select(
        F.col(media).alias("media"),
        F.col(id_col).alias("id"),
        F.struct(*order).alias("at"),
        F.col(vec).alias("vec"),
    )
    large = rows.groupBy("media").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows)
    schema = T.StructType(
        [rows.schema["media"], rows.schema["id"], T.StructField("entity_no", T.LongType())]
    )

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _by_time(pdf)
        labels, _ = _assign(_units(pdf["vec"]), threshold, policy)
        return pd.DataFrame({"media": pdf["media"], "id": pdf["id"], "entity_no": labels + 1})

    if large.isEmpty():
        return rows.groupBy("media").applyInPandas(whole, schema)
    large = cut_lineage(large)
    small = rows.join(large.select("media"), "media", "left_anti").groupBy("media").applyInPandas(whole, schema)
    hot = rows.join(large.select("media", "n"), "media")
    return small.unionByName(_online_large(hot, threshold, policy, group_rows, leaders_per_round))


def _by_time(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = pd.DataFrame(pdf["at"].tolist())
    return pdf.iloc[keys.sort_values(list(keys.columns), kind="stable").index].reset_index(drop=True)


def _online_large(rows: DataFrame, threshold: float, policy: str, group_rows: int, per_round: int) -> DataFrame:
    """The same rule for media too large for one group.

    A row opens an entity exactly when no earlier entity is similar enough.  So the earliest
    undecided rows of a media (at most ``per_round``, taken with a rank limit) can be settled
    locally; the entities they open are then compared with all later rows in parallel, in
    salted groups of bounded size.  Rows similar to one of them can no longer open an entity.
    Rounds go forward in time until no row is undecided.
    """
    salts = F.ceil(F.col("n") / group_rows).cast("int")
    state = rows.select(
        "media", "id", "at", "vec", salts.alias("salts"),
        F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"),
        F.lit(False).alias("settled"),
        F.lit(-2.0).alias("best"),
        F.lit(0).cast("long").alias("entity_no"),
    )
    state = cut_lineage(state)
    leader_schema = T.StructType(
        [
            state.schema["media"], state.schema["id"], state.schema["at"], state.schema["vec"],
            state.schema["salts"], T.StructField("entity_no", T.LongType()),
        ]
    )
    opened = cut_lineage(state.groupBy("media").agg(F.lit(0).cast("long").alias("opened")))
    by_time = Window.partitionBy("media").orderBy("at")
    keep = [f.name for f in state.schema.fields]

    while True:
        head = (
            state.filter(~F.col("settled"))
            .withColumn("_rank", F.row_number().over(by_time))
            .filter(F.col("_rank") <= per_round)
            .join(opened, "media")
        )

        def lead(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = _by_time(pdf)
            _, at = _assign(_units(pdf["vec"]), threshold, policy)
            out = pdf.iloc[at][["media", "id", "at", "vec", "salts", "opened"]].reset_index(drop=True)
            out["entity_no"] = out.pop("opened") + np.arange(1, len(out) + 1)
            return out

        leaders = cut_lineage(head.groupBy("media").applyInPandas(lead, leader_schema))
        if leaders.isEmpty():
            break
        sent = leaders.select(
            "media", F.col("id").alias("l_id"), F.col("at").alias("l_at"), F.col("vec").alias("l_vec"),
            F.col("entity_no").alias("l_no"),
            F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        )

        def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return left[keep]
            right = right.sort_values("l_no", ignore_index=True)
            sims = np.round(_units(left["vec"]) @ _units(right["l_vec"]).T, 12)
            own = pd.DataFrame(left["at"].tolist()).apply(tuple, axis=1).tolist()
            theirs = pd.DataFrame(right["l_at"].tolist()).apply(tuple, axis=1).tolist()
            moments = {m: r for r, m in enumerate(sorted(set(own) | set(theirs)))}
            later = np.array([moments[m] for m in own])[:, None] > np.array([moments[m] for m in theirs])[None, :]
            sims = np.where(later & (sims >= threshold), sims, -2.0)
            numbers = right["l_no"].to_numpy(np.int64)
            out = left[keep].copy()
            if policy == "best":
                pick = sims.argmax(axis=1)
                top = sims[np.arange(len(sims)), pick]
                better = top > out["best"].to_numpy()
            else:
                pick = (sims > -2.0).argmax(axis=1)
                top = sims[np.arange(len(sims)), pick]
                better = (top > -2.0) & (out["entity_no"].to_numpy() == 0)
            out.loc[better, "best"] = top[better]
            out.loc[better, "entity_no"] = numbers[pick][better]
            leads = dict(zip(right["l_id"], numbers))
            own_no = out["id"].map(leads)
            is_leader = own_no.notna().to_numpy()
            out.loc[is_leader, "entity_no"] = own_no[is_leader].astype(np.int64)
            out.loc[is_leader, "best"] = 3.0
            out["settled"] = out["settled"].to_numpy() | better | is_leader
            return out

        state = cut_lineage(
            state.groupBy("media", "salt").cogroup(sent.groupBy("media", "salt")).applyInPandas(compare, state.schema)
        )
        counts = leaders.groupBy("media").agg(F.max("entity_no").alias("now"))
        opened = cut_lineage(
            opened.join(counts, "media", "left").select("media", F.coalesce("now", "opened").alias("opened"))
        )
    return state.select("media", "id", "entity_no")


def entity_name(number: str, digits: int = 3):
    """``person_001`` style names; wider numbers keep all their digits."""
    text = F.col(number).cast("string")
    return F.concat(F.lit("person_"), F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text))


def entity_table(
    detections: DataFrame, media: str = "media", entity: str = "entity_id", t: str = "t", id_col: str = "id",
    vec: str = "embedding",
) -> DataFrame:
    """One row per (media, entity): first time, number of detections, vector of the first detection."""
    return detections.filter(F.col(entity).isNotNull()).groupBy(media, entity).agg(
        F.min(t).alias("first_seen"),
        F.count(F.lit(1)).alias("appearances"),
        F.min_by(id_col, F.struct(t, id_col)).alias("first_id"),
        F.min_by(vec, F.struct(t, id_col)).alias("representative"),
    )


# --- average linkage ---------------------------------------------------------------------


def _linkage(sums: np.ndarray, sizes: np.ndarray, cut: float, merges: list | None = None) -> np.ndarray:
    """Average linkage on clusters given as sums of unit vectors; merges while distance < cut.

    The mean cosine between two clusters is the product of their mean vectors, so only sums
    and sizes are needed.  Returns the root (smallest position) of each cluster; ``merges`` gets
    (kept root, other root, distance, size) of each step.
    """
    n = len(sums)
    root = np.arange(n)
    if n < 2:
        return root
    sums, sizes = sums.astype(np.float64).copy(), sizes.astype(np.float64).copy()
    means = sums / sizes[:, None]
    dist = np.round(1.0 - means @ means.T, 12)
    np.fill_diagonal(dist, np.inf)
    near = dist.argmin(axis=1)
    gap = dist[np.arange(n), near]
    while True:
        i = int(gap.argmin())
        if not gap[i] < cut:
            return root
        height, j = float(gap[i]), int(near[i])
        i, j = min(i, j), max(i, j)
        total = sizes[i] + sizes[j]
        if merges is not None:
            merges.append((i, j, height, total))
        merged = (sizes[i] * dist[i] + sizes[j] * dist[j]) / total
        sums[i] += sums[j]
        sizes[i] = total
        merged[[i, j]] = np.inf
        dist[i], dist[:, i] = merged, merged
        dist[j], dist[:, j] = np.inf, np.inf
        root[root == root[j]] = root[i]
        stale = np.nonzero((near == i) | (near == j))[0]
        for s in {*stale.tolist(), i}:
            near[s] = dist[s].argmin()
            gap[s] = dist[s, near[s]]
        closer = dist[:, i] < gap
        near[closer], gap[closer] = i, dist[closer, i]
        gap[j] = np.inf


def _linkage_by_means(sums: np.ndarray, sizes: np.ndarray, cut: float, merges: list | None = None) -> np.ndarray:
    """As ``_linkage`` without a matrix of distances: memory follows the clusters, a merge compares one of them with all.

    A cluster whose nearest merged keeps its gap as a lower bound and looks again only when that is the least of all.
    """
    n = len(sums)
    root = np.arange(n)
    if n < 2:
        return root
    sums, sizes = sums.astype(np.float64).copy(), sizes.astype(np.float64).copy()
    means = sums / sizes[:, None]
    gone = np.zeros(n, bool)
    near, gap, stale = np.zeros(n, np.int64), np.empty(n), np.zeros(n, bool)
    step = max(1, TILE_BYTES // (8 * n))
    for at in range(0, n, step):
        dist = np.round(1.0 - means[at : at + step] @ means.T, 12)
        rows = np.arange(len(dist))
        dist[rows, rows + at] = np.inf
        near[at : at + step] = dist.argmin(axis=1)
        gap[at : at + step] = dist[rows, near[at : at + step]]

    def look(i: int) -> np.ndarray:
        dist = np.round(1.0 - means @ means[i], 12)
        dist[gone] = np.inf
        dist[i] = np.inf
        near[i] = dist.argmin()
        gap[i], stale[i] = dist[near[i]], False
        return dist

    while True:
        i = int(gap.argmin())
        if not gap[i] < cut:
            return root
        if stale[i]:
            look(i)
            continue
        height, j = float(gap[i]), int(near[i])
        i, j = min(i, j), max(i, j)
        sums[i] += sums[j]
        sizes[i] += sizes[j]
        means[i] = sums[i] / sizes[i]
        if merges is not None:
            merges.append((i, j, height, sizes[i]))
        gone[j], gap[j] = True, np.inf
        root[root == root[j]] = root[i]
        stale |= ((near == i) | (near == j)) & ~gone
        dist = look(i)
        closer = dist < gap
        near[closer], gap[closer], stale[closer] = i, dist[closer], False


def _keyed_points(detections: DataFrame, media: str, id_col: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Detections with a vector, and their distinct vectors per media as weighted points named by the smallest id.

    Copies of one vector lie at distance 0 and would merge first.  A zero vector is at distance 1 from everything, so
    zero vectors stay separate.
    """
    rows = detections.filter(F.col(vec).isNotNull()).select(
        F.col(media).alias("media"), F.col(id_col).cast("long").alias("id"), F.col(vec).alias("vec")
    )
    zero = ~F.exists("vec", lambda x: x != 0)
    keyed = rows.select("media", "id", "vec", F.when(zero, F.col("id")).alias("zero_id"))
    points = keyed.groupBy("media", "vec", "zero_id").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("cid"))
    return keyed, cut_lineage(points)


def _of_points(keyed: DataFrame, points: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of ``found`` (media, cid, ...) for every detection: copies find their point again through the vector."""
    named = points.select("media", "vec", "zero_id", "cid").join(found, ["media", "cid"])
    cond = (
        keyed["media"].eqNullSafe(named["media"])
        & (keyed["vec"] == named["vec"])
        & keyed["zero_id"].eqNullSafe(named["zero_id"])
    )
    return keyed.join(named, cond).select(keyed["media"], keyed["id"], *[named[c] for c in columns])


def _tree_schema(field: T.StructField) -> T.StructType:
    numbers = [T.StructField(c, T.LongType()) for c in ("cid", "root", "parent")]
    return T.StructType([field, *numbers, T.StructField("height", T.DoubleType()), T.StructField("size", T.LongType())])


def _tree_of(pdf: pd.DataFrame, cut: float, most: float = math.inf) -> pd.DataFrame:
    """Linkage of one group: per point its root at ``cut``, the root it was merged into, how far that was, what came out.

    More than ``most`` rows make no matrix of distances.
    """
    pdf = pdf.sort_values("cid", ignore_index=True)
    sizes, cid = pdf["size"].to_numpy(np.float64), pdf["cid"].to_numpy(np.int64)
    sums = np.vstack(pdf["total"].to_numpy()) if "total" in pdf else _units(pdf["vec"]) * sizes[:, None]
    merges: list[tuple[int, int, float, float]] = []
    root = (_linkage if len(pdf) <= most else _linkage_by_means)(sums, sizes, cut, merges)
    out = pd.DataFrame({"media": pdf["media"], "cid": cid, "root": cid[root]})
    parent, height, size = [None] * len(cid), [None] * len(cid), [None] * len(cid)
    for i, j, gap, total in merges:
        parent[j], height[j], size[j] = int(cid[i]), gap, int(total)
    return out.assign(parent=pd.array(parent, "Int64"), height=pd.array(height, "Float64"), size=pd.array(size, "Int64"))


def _linkage_points(points: DataFrame, cut: float, group_rows: int) -> DataFrame:
    """(media, cid, root, parent, height, size) of weighted points; see ``_tree_of`` and ``_linkage_large``."""
    schema = _tree_schema(points.schema["media"])
    grouped = lambda df: df.groupBy("media").applyInPandas(lambda pdf: _tree_of(pdf, cut), schema)
    large = points.groupBy("media").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows)
    if large.isEmpty():
        return cut_lineage(grouped(points))
    large = cut_lineage(large)
    hot = _linkage_large(points.join(large, "media"), cut, group_rows)
    return cut_lineage(grouped(points.join(large, "media", "left_anti")).unionByName(hot))


def _linkage_large(points: DataFrame, cut: float, group_rows: int) -> DataFrame:
    """Average linkage of media (with their number of points ``n``) too large for one group.

    Clusters merge only if some pair of their points is closer than ``cut``, so a cluster never leaves a connected
    component of the graph of such pairs.  Block products find the components once: a task compares two blocks of
    points and emits the edges of a spanning forest, at most as many as it has points.  Components that fit a group are
    clustered in one; a larger one goes on in rounds, ``_merge_rounds``.
    """
    field = points.schema["media"]
    blocks = F.ceil(F.col("n") / group_rows).cast("int")
    placed = points.select("media", "cid", "vec", blocks.alias("blocks"), F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least("block", b).alias("lo"), F.greatest("block", b).alias("hi")))
    spread = placed.withColumn("pair", F.explode(pairs))
    edge_schema = T.StructType([field, T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["pair"].iloc[0]["lo"], pdf["pair"].iloc[0]["hi"]
        x, y = pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]
        if x.empty or y.empty:
            return pd.DataFrame(columns=["media", "a", "b"])
        names = np.concatenate([x["cid"].to_numpy(np.int64), y["cid"].to_numpy(np.int64)])
        i, j = [], []
        right = _units(y["vec"])
        for part, scores in score_tiles(_units(x["vec"]), right):
            row, col = np.nonzero(np.round(1.0 - scores, SCORE_DIGITS) <= cut + 10.0**-SCORE_DIGITS)  # scores are rounded
            i.append(row + part.start)
            j.append(col + len(x))
        i, j = np.concatenate(i), np.concatenate(j)
        label = np.arange(len(names))
        keep = np.zeros(len(i), bool)
        left = np.arange(len(i))
        while len(left):  # every node takes one edge to a smaller label; an edge inside a tree is dropped
            a, b = label[i[left]], label[j[left]]
            left, a, b = left[a != b], a[a != b], b[a != b]
            _, first = np.unique(np.maximum(a, b), return_index=True)
            keep[left[first]] = True
            label[np.maximum(a, b)[first]] = np.minimum(a, b)[first]
            while (label[label] != label).any():
                label = label[label]
        return pd.DataFrame({"media": pdf["media"].iloc[0], "a": names[i[keep]], "b": names[j[keep]]})

    edges = cut_lineage(spread.groupBy("media", "pair").applyInPandas(forest, edge_schema))
    parts = connected(edges.filter("a <> b"), ["media"]).withColumnRenamed("node", "cid")
    named = points.drop("n").join(parts, ["media", "cid"], "left").withColumn("component", F.coalesce("component", "cid"))
    named = cut_lineage(named)
    sizes = cut_lineage(named.groupBy("media", "component").agg(F.count(F.lit(1)).alias("n")))
    none = lambda kind: F.lit(None).cast(kind)
    alone = named.join(sizes.filter("n = 1"), ["media", "component"], "left_semi").select(
        "media", "cid", F.col("cid").alias("root"), none("long").alias("parent"), none("double").alias("height"), none("long").alias("size")
    )
    few = named.join(sizes.filter(F.col("n").between(2, group_rows)), ["media", "component"], "left_semi")
    schema = _tree_schema(field)
    out = alone.unionByName(few.groupBy("media", "component").applyInPandas(lambda pdf: _tree_of(pdf, cut), schema))
    many = sizes.filter(F.col("n") > group_rows).select("media", "component", F.to_json(F.struct("media", "component")).alias("key"))
    many = cut_lineage(many)
    if many.isEmpty():
        return out
    rest = named.join(many, ["media", "component"]).select(F.col("key").alias("media"), "cid", "vec", "size")
    found = _merge_rounds(rest, cut, group_rows).withColumnRenamed("media", "key").join(many.select("key", "media"), "key")
    return out.unionByName(found.drop("key"))


def linkage_clusters(
    detections: DataFrame,
    cut: float = 0.3,
    media: str = "media",
    id_col: str = "id",
    vec: str = "embedding",
    group_rows: int = LINKAGE_ROWS,
) -> DataFrame:
    """Rows (media, id, cluster_no): average linkage per media on cosine distance, cut at ``cut``.

    Clusters of a media are numbered from 0 by their smallest member id.  Rows without a
    vector are left out; a single row forms one cluster.
    """
    keyed, points = _keyed_points(detections, media, id_col, vec)
    roots = _linkage_points(points, cut, group_rows)
    numbers = _number_roots(roots.groupBy("media", "root").agg(F.count(F.lit(1)).alias("points")))
    named = roots.join(numbers, ["media", "root"]).select("media", "cid", "cluster_no")
    return _of_points(keyed, points, named, ["cluster_no"])


def linkage_tree(
    detections: DataFrame,
    cut: float = 1.0,
    media: str = "media",
    id_col: str = "id",
    vec: str = "embedding",
    group_rows: int = LINKAGE_ROWS,
) -> DataFrame:
    """The merges of average linkage up to ``cut``: one row (media, id, parent, height, size) per detection.

    A cluster is named by its smallest id.  The row of an id tells when the cluster of that name was merged into the
    one named ``parent``, at which distance and how many detections came together; parent is null for what no merge
    below ``cut`` took.  A copy of another vector is merged into it at height 0.  Heights never fall from child to
    parent, so the clusters at any smaller cut are the components of the rows below it (``cut_tree``).
    """
    keyed, points = _keyed_points(detections, media, id_col, vec)
    tree = _linkage_points(points, cut, group_rows).withColumnRenamed("size", "merged")
    counted = tree.join(points.select("media", "cid", F.col("size").alias("copies")), ["media", "cid"])
    rows = _of_points(keyed, points, counted, ["cid", "parent", "height", "merged", "copies"])
    copy = F.col("id") != F.col("cid")
    return rows.select(
        "media", "id", F.when(copy, F.col("cid")).otherwise(F.col("parent")).alias("parent"),
        F.when(copy, 0.0).otherwise(F.col("height")).alias("height"), F.when(copy, F.col("copies")).otherwise(F.col("merged")).alias("size"),
    )


def cut_tree(tree: DataFrame, cut: float) -> DataFrame:
    """(media, id, cluster_no) at ``cut``, at most that of ``linkage_tree``; pointers to parents double each round."""
    up = F.when(F.col("height") < cut, F.col("parent"))
    state = cut_lineage(tree.select("media", "id", F.coalesce(up, "id").alias("root")))
    while True:
        above = state.select("media", F.col("id").alias("root"), F.col("root").alias("far"))
        state = cut_lineage(state.join(above, ["media", "root"]).select("media", "id", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
    numbers = _number_roots(state.groupBy("media", "root").agg(F.count(F.lit(1)).alias("points")))
    return state.join(numbers, ["media", "root"]).select("media", "id", "cluster_no")


def _number_roots(roots: DataFrame) -> DataFrame:
    from mediaops.plans.slices import running_sum

    counted = running_sum(roots, ["media"], ["root"], F.lit(1), "_no")
    return counted.select("media", "root", (F.col("_no") - 1).cast("long").alias("cluster_no"))


def _merge_rounds(points: DataFrame, cut: float, group_rows: int) -> DataFrame:
    """Average linkage for a media too large for one group.

    Average linkage is reducible: two clusters that are each other's nearest stay so until
    they merge, so all such pairs can merge in one round and the hierarchy is the same.
    A round finds the nearest cluster of each cluster with block products (a task holds two
    blocks of ``group_rows`` and emits one row per left cluster), and merges the mutual pairs
    closer than ``cut``.  A merged cluster is no closer to a third one than the nearer of its
    parts was, so a nearest cluster stays the nearest until it merges itself: after the first
    round only clusters that merged, or whose nearest did, are compared with all.  A cluster
    whose nearest is not below ``cut`` is final and leaves: the mean distance of what others
    merge to is no smaller.  So rounds go on with what can merge still, and a media that is down
    to ``group_rows`` of those is finished in one group.  Where one cluster is the nearest of many,
    it takes them one by one, a round each; a media that merged few in a round is finished in one
    group too if its sums need no more memory than the distances of ``group_rows``.  Equal
    distances are decided by the smaller pair of ids.
    """
    field = points.schema["media"]
    state_schema = T.StructType(
        [
            field,
            T.StructField("cid", T.LongType()),
            T.StructField("total", T.ArrayType(T.DoubleType())),
            T.StructField("size", T.DoubleType()),
        ]
    )

    def to_unit(batches):
        for pdf in batches:
            if len(pdf):
                sizes = pdf["size"].to_numpy(np.float64)
                totals = list(_units(pdf["vec"]) * sizes[:, None])
                yield pd.DataFrame({"media": pdf["media"], "cid": pdf["cid"], "total": totals, "size": sizes})

    state = cut_lineage(points.select("media", "cid", "vec", "size").mapInPandas(to_unit, state_schema))
    roots = cut_lineage(state.select("media", "cid", F.col("cid").alias("root")))
    merges: list[DataFrame] = []
    known: DataFrame | None = None
    near_schema = T.StructType(
        [
            field, T.StructField("cid", T.LongType()),
            T.StructField("dist", T.DoubleType()), T.StructField("other", T.LongType()),
        ]
    )

    def nearest_in_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=near_schema.names)  # from empty lists it would be numbers, which are no text for Spark
        a = np.vstack(left["total"].to_numpy()) / left["size"].to_numpy()[:, None]
        right = right.sort_values("r_cid", ignore_index=True)
        b = np.vstack(right["r_total"].to_numpy()) / right["r_size"].to_numpy()[:, None]
        dist = np.round(1.0 - a @ b.T, 12)
        own, other = left["cid"].to_numpy(), right["r_cid"].to_numpy()
        dist[own[:, None] == other[None, :]] = np.inf
        # (dist, smaller id, larger id): among equal distances the smallest other id wins.
        at = dist.argmin(axis=1)
        best = dist[np.arange(len(own)), at]
        out = pd.DataFrame({"media": left["media"], "cid": own, "dist": best, "other": other[at]})
        return out[np.isfinite(out["dist"])]

    active = state
    finished: list[DataFrame] = []
    width = state.agg(F.max(F.size("total"))).first()[0]
    while True:
        counts = active.groupBy("media").agg(F.count(F.lit(1)).alias("n"))
        few = F.col("n") <= group_rows
        if merges:
            counts = counts.join(pairs.groupBy("media").agg(F.count(F.lit(1)).alias("merged")), "media", "left")
            few = few | ((F.coalesce("merged", F.lit(0)) * SLOW < F.col("n")) & (F.col("n") * width <= group_rows**2))
        counts = cut_lineage(counts.select("media", "n", few.alias("few")))
        some, every_one = counts.agg(F.max("few"), F.min("few")).first()
        if some:
            finished.append(cut_lineage(active.join(counts.filter("few").select("media"), "media", "left_semi")))
        if every_one is not False:
            return _finish(finished, roots, merges, cut, group_rows)
        counts = counts.filter("not few").select("media", "n")
        active = active.join(counts, "media")
        blocks = F.ceil(F.col("n") / group_rows).cast("int")
        placed = active.select(
            "media", "cid", "total", "size", blocks.alias("blocks"),
            F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"),
        )
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        asks = placed if known is None else placed.join(known, ["media", "cid"], "left_anti")
        left = asks.select("media", "cid", "total", "size", F.col("block").alias("a"), every.alias("b"))
        right = placed.select(
            F.col("media").alias("r_media"), F.col("cid").alias("r_cid"), F.col("total").alias("r_total"),
            F.col("size").alias("r_size"), F.col("block").alias("r_b"), every.alias("r_a"),
        )
        found = left.groupBy("media", "a", "b").cogroup(right.groupBy("r_media", "r_a", "r_b")).applyInPandas(
            nearest_in_block, near_schema
        )
        best = found.groupBy("media", "cid").agg(
            F.min(F.struct("dist", F.least("cid", "other").alias("lo"), F.greatest("cid", "other").alias("hi"))).alias("p")
        )
        best = best.filter(F.col("p.dist") < cut)
        best = cut_lineage(best if known is None else best.unionByName(known.join(counts, "media", "left_semi")))
        active = active.join(best.select("media", "cid"), ["media", "cid"], "left_semi")
        pairs = (
            best.groupBy("media", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"))
            .agg(F.count(F.lit(1)).alias("sides"), F.min("p.dist").alias("height"))
            .filter("sides = 2")
        )
        sizes = [active.select("media", F.col("cid").alias(c), F.col("size").alias(f"{c}_size")) for c in ("lo", "hi")]
        pairs = pairs.join(sizes[0], ["media", "lo"]).join(sizes[1], ["media", "hi"])
        pairs = cut_lineage(pairs.select("media", "lo", "hi", "height", (F.col("lo_size") + F.col("hi_size")).cast("long").alias("size")))
        if pairs.isEmpty():
            return _finish(finished, roots, merges, cut, group_rows)
        merges.append(pairs)
        if len(merges) > MERGE_TABLES:
            merges = [cut_lineage(_all_of(merges))]
        touched = pairs.select("media", F.explode(F.array("lo", "hi")).alias("cid"))
        other = F.when(F.col("p.lo") == F.col("cid"), F.col("p.hi")).otherwise(F.col("p.lo"))
        kept = best.join(touched, ["media", "cid"], "left_anti").withColumn("other", other)
        kept = kept.join(touched.withColumnRenamed("cid", "other"), ["media", "other"], "left_anti")
        known = cut_lineage(kept.select("media", "cid", "p"))
        moved = pairs.select("media", F.col("hi").alias("cid"), "lo")
        merged = (
            active.drop("n").join(moved, ["media", "cid"], "left")
            .select("media", F.coalesce("lo", "cid").alias("cid"), "total", "size")
            .groupBy("media", "cid")
            .agg(
                F.min_by("total", "size").alias("t1"), F.count(F.lit(1)).alias("k"),
                F.collect_list("total").alias("both"), F.sum("size").alias("size"),
            )
        )
        # A cluster takes part in at most one pair, so ``both`` holds one or two sums.
        added = F.when(F.col("k") == 1, F.col("t1")).otherwise(
            F.zip_with(F.col("both")[0], F.get("both", 1), lambda x, y: x + y)
        )
        active = cut_lineage(merged.select("media", "cid", added.alias("total"), "size"))
        renamed = moved.select("media", F.col("cid").alias("root"), "lo")
        roots = cut_lineage(
            roots.join(renamed, ["media", "root"], "left").select("media", "cid", F.coalesce("lo", "root").alias("root"))
        )


def _all_of(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _finish(finished: list[DataFrame], roots: DataFrame, merges: list[DataFrame], cut: float, group_rows: int) -> DataFrame:
    """Finish the media that fit a group now (``finished``); all else is in ``merges`` or has no pair below the cut."""
    schema = _tree_schema(roots.schema["media"])
    done = [pairs.select("media", F.col("hi").alias("cid"), F.col("lo").alias("parent"), "height", "size") for pairs in merges]
    last = roots.sparkSession.createDataFrame([], schema)
    if finished:
        last = cut_lineage(_all_of(finished).groupBy("media").applyInPandas(lambda pdf: _tree_of(pdf, cut, group_rows), schema))
    done = _all_of([*done, last.filter("parent is not null").select("media", "cid", "parent", "height", "size")])
    ended = last.select("media", F.col("cid").alias("root"), F.col("root").alias("final"))
    named = roots.join(ended, ["media", "root"], "left").select("media", "cid", F.coalesce("final", "root").alias("root"))
    return named.join(done, ["media", "cid"], "left").select("media", "cid", "root", "parent", "height", "size")


def threshold_sweep(detections: DataFrame, cuts: Sequence[float], **kw) -> DataFrame:
    """Clusters found at each cut: (cut, media, clusters, detections), all from one tree.

    Every merge below a cut leaves one cluster less, so the counts are one aggregate.
    """
    tree = linkage_tree(detections, max(cuts), **kw)
    at = F.explode(F.array(*[F.lit(float(c)) for c in cuts]))
    rows = tree.select("media", "height", at.alias("cut")).groupBy("cut", "media")
    apart = F.col("height").isNull() | (F.col("height") >= F.col("cut"))
    return rows.agg(F.count(F.when(apart, 1)).alias("clusters"), F.count(F.lit(1)).alias("detections"))


def compare_labels(labels: DataFrame, first: str, second: str, media: str = "media") -> DataFrame:
    """Contingency of two labelings per media, with the share of each side and how it was changed.

    ``merged``: the second label joins several first ones; ``split``: the first label is
    spread over several second ones.
    """
    cells = labels.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(
        media, F.col(first).alias("first"), F.col(second).alias("second")
    ).agg(F.count(F.lit(1)).alias("n"))
    of_first = cells.groupBy(media, "first").agg(F.sum("n").alias("first_n"), F.count(F.lit(1)).alias("first_parts"))
    of_second = cells.groupBy(media, "second").agg(F.sum("n").alias("second_n"), F.count(F.lit(1)).alias("second_parts"))
    return (
        cells.join(of_first, [media, "first"])
        .join(of_second, [media, "second"])
        .select(
            media, "first", "second", "n",
            F.round(F.col("n") / F.col("first_n"), 6).alias("first_share"),
            F.round(F.col("n") / F.col("second_n"), 6).alias("second_share"),
            (F.col("first_parts") > 1).alias("split"),
            (F.col("second_parts") > 1).alias("merged"),
        )
    )


def relabel_counts(cells: DataFrame, media: str = "media") -> DataFrame:
    """Per media: labels merged into another one and labels newly created between two labelings."""
    return cells.groupBy(media).agg(
        F.count_distinct("first").alias("before"),
        F.count_distinct("second").alias("after"),
        F.count_distinct(F.when(F.col("merged"), F.col("second"))).alias("merged_labels"),
        F.count_distinct(F.when(F.col("split"), F.col("first"))).alias("split_labels"),
    ).select(
        media, "before", "after", "merged_labels", "split_labels",
        F.greatest(F.lit(0), F.col("before") - F.col("after")).alias("merged"),
        F.greatest(F.lit(0), F.col("after") - F.col("before")).alias("new"),
    )
