"""Entity clustering of the embedding table."""

from pyspark.sql import functions as F

from mediaops.operators import clustering as C
from mediaops.workloads import roles as R
from mediaops.workloads.registry import query


def rows(spark, sf):
    return R.vectors(spark, sf).select("media", "id", "t", "embedding")


def online_sql(policy: str, digits: int = 0) -> str:
    """The one-pass rule as a recursion over the rows of each media; the known entities travel as a list of vectors."""
    hit = {
        "best": "CASE WHEN list_max(sims) >= 0.3 THEN list_position(sims, list_max(sims)) END",
        "first": "nullif(list_position(list_transform(sims, lambda x: x >= 0.3), true), 0)",
    }[policy]
    entity = f", 'person_' || CASE WHEN no < {10**digits} THEN lpad(CAST(no AS VARCHAR), {digits}, '0') ELSE CAST(no AS VARCHAR) END AS entity_id" if digits else ""
    return f"""WITH RECURSIVE {R.VEC_SQL},
u AS (SELECT media, id, row_number() OVER (PARTITION BY media ORDER BY t, id) AS i, sqrt(list_dot_product(embedding, embedding)) AS norm, embedding FROM vec WHERE embedding IS NOT NULL),
n AS (SELECT media, id, i, list_transform(embedding, lambda x: CASE WHEN norm > 0 THEN x / norm ELSE x END) AS e FROM u),
walk AS (
  SELECT media, id, i, CAST(1 AS BIGINT) AS no, [e] AS known FROM n WHERE i = 1
  UNION ALL
  SELECT media, id, i, coalesce(hit, len(known) + 1), CASE WHEN hit IS NULL THEN list_append(known, e) ELSE known END
  FROM (SELECT *, {hit} AS hit FROM (SELECT n.*, known, list_transform(known, lambda k: round(list_dot_product(k, n.e), 12)) AS sims
    FROM walk JOIN n ON n.media = walk.media AND n.i = walk.i + 1)))
SELECT media, id, no AS entity_no{entity} FROM walk"""


@query("c2_online_clusters_best", online_sql("best", 3))
def online_best(spark, sf):
    return C.online_clusters(rows(spark, sf), 0.3, "best").withColumn("entity_id", C.entity_name("entity_no"))


@query("c2_online_clusters_first", online_sql("first", 2))
def online_first(spark, sf):
    return C.online_clusters(rows(spark, sf), 0.3, "first").withColumn("entity_id", C.entity_name("entity_no", 2))


def linkage_sql(cut: float) -> str:
    """Average linkage by its definition, one merge of every media a step; the labels travel as a list."""
    return f"""u AS (SELECT media, id, row_number() OVER (PARTITION BY media ORDER BY id) AS i, sqrt(list_dot_product(embedding, embedding)) AS norm, embedding FROM vec WHERE embedding IS NOT NULL),
n AS (SELECT media, id, i, list_transform(embedding, lambda x: CASE WHEN norm > 0 THEN x / norm ELSE x END) AS e FROM u),
d AS (SELECT a.media, a.i AS i, b.i AS j, round(1 - list_dot_product(a.e, b.e), 12) AS dist FROM n a JOIN n b ON a.media = b.media AND a.i < b.i),
walk AS (
  SELECT media, 0 AS step, CAST(NULL AS DOUBLE) AS height, list(i ORDER BY i) AS labels FROM n GROUP BY media
  UNION ALL
  SELECT media, step + 1, m.dist, list_transform(labels, lambda x: CASE WHEN x = m.hi THEN m.lo ELSE x END)
  FROM (SELECT media, step, any_value(labels) AS labels, min({{'dist': dist, 'lo': lo, 'hi': hi}}) AS m
    FROM (SELECT walk.media, step, any_value(labels) AS labels, least(labels[i], labels[j]) AS lo, greatest(labels[i], labels[j]) AS hi, avg(dist) AS dist
      FROM walk JOIN d ON d.media = walk.media AND labels[i] <> labels[j] GROUP BY walk.media, step, lo, hi) GROUP BY media, step)
  WHERE m.dist < {cut})"""


LINKED_SQL = """ended AS (SELECT media, arg_max(labels, step) AS labels FROM walk GROUP BY media),
linked AS (SELECT n.media, n.id, dense_rank() OVER (PARTITION BY n.media ORDER BY labels[i]) - 1 AS cluster_no FROM n JOIN ended ON n.media = ended.media)"""


@query("c3_linkage_clusters", f"WITH RECURSIVE {R.VEC_SQL}, {linkage_sql(0.7)}, {LINKED_SQL} SELECT media, id, cluster_no FROM linked")
def linkage(spark, sf):
    return C.linkage_clusters(rows(spark, sf), 0.7)


@query("c3_linkage_by_components", f"WITH RECURSIVE {R.VEC_SQL}, {linkage_sql(0.7)}, {LINKED_SQL} SELECT media, id, cluster_no FROM linked")
def linkage_parts(spark, sf):
    """The same where no media fits a group: components of the graph below the cut, large ones in rounds."""
    v = rows(spark, sf)
    return C.linkage_clusters(v, 0.7, group_rows=max(4, v.count() // 60))


@query("c4_labelings_compared", f"""WITH RECURSIVE {R.VEC_SQL}, {linkage_sql(0.7)}, {LINKED_SQL},
o AS ({online_sql("best")}),
c AS (SELECT o.media, entity_no AS "first", cluster_no AS "second", count(*) AS n FROM o JOIN linked USING (media, id) GROUP BY ALL)
SELECT media, "first", "second", n, round(n / sum(n) OVER f, 6) AS first_share, round(n / sum(n) OVER s, 6) AS second_share,
  count(*) OVER f > 1 AS split, count(*) OVER s > 1 AS merged FROM c
WINDOW f AS (PARTITION BY media, "first"), s AS (PARTITION BY media, "second")""")
def compared(spark, sf):
    both = C.online_clusters(rows(spark, sf), 0.3).join(C.linkage_clusters(rows(spark, sf), 0.7), ["media", "id"])
    return C.compare_labels(both, "entity_no", "cluster_no")


CELLS = f"""WITH {R.DET_SQL}, c AS (SELECT media, entity_id AS "first", entity_id_batch AS "second", count(*) AS n FROM det WHERE entity_id IS NOT NULL GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY media, "first") AS fn, count(*) OVER (PARTITION BY media, "first") AS fp,
  sum(n) OVER (PARTITION BY media, "second") AS sn, count(*) OVER (PARTITION BY media, "second") AS sp FROM c)"""


@query("c4_label_contingency", f"""{CELLS} SELECT media, "first", "second", n, round(n / fn, 6) AS first_share, round(n / sn, 6) AS second_share, fp > 1 AS split, sp > 1 AS merged FROM k""")
def contingency(spark, sf):
    return C.compare_labels(R.detections(spark, sf), "entity_id", "entity_id_batch")


@query("c4_relabel_counts", f"""{CELLS}, g AS (SELECT media, count(DISTINCT "first") AS before, count(DISTINCT "second") AS after, count(DISTINCT "second") FILTER (sp > 1) AS merged_labels,
count(DISTINCT "first") FILTER (fp > 1) AS split_labels FROM k GROUP BY media)
SELECT *, greatest(0, before - after) AS merged, greatest(0, after - before) AS new FROM g""")
def relabel(spark, sf):
    return C.relabel_counts(C.compare_labels(R.detections(spark, sf), "entity_id", "entity_id_batch"))


@query("a24_threshold_sweep", f"""WITH RECURSIVE {R.VEC_SQL}, {linkage_sql(0.9)}
SELECT CAST(cut AS DOUBLE) AS cut, media, count(DISTINCT n.i) - count(DISTINCT step) AS clusters, count(DISTINCT n.i) AS detections
FROM (SELECT unnest([0.6, 0.75, 0.9]) AS cut) JOIN n ON true LEFT JOIN (SELECT media, step, height FROM walk WHERE step > 0) w USING (media)
WHERE true GROUP BY cut, media""".replace("count(DISTINCT step)", "count(DISTINCT step) FILTER (height < cut)"))
def sweep(spark, sf):
    return C.threshold_sweep(rows(spark, sf), (0.6, 0.75, 0.9))
