"""Vector search, joins of vectors, paging."""

from pyspark.sql import functions as F

from mediaops.functions.vectors import cosine_between
from mediaops.operators import filters, search
from mediaops.operators import inverted_lists as IL
from mediaops.plans.staging import scratch_folder
from mediaops.workloads import roles as R
from mediaops.workloads.registry import query

SIM = R.cosine_sql("vec.embedding", "q.v")
SIM2 = R.cosine_sql("vec.search_terms_embedding", "q.v")
HYBRID_SQL = f"""scored AS (
  SELECT id, media, segment_index, t, confidence, round({SIM}, 6) AS desc_score, round({SIM2}, 6) AS second
  FROM vec, q),
hits AS (SELECT id, media, segment_index, t, confidence, desc_score, coalesce(second, 0.0) AS search_score,
  round(CASE WHEN second IS NOT NULL THEN 0.5 * desc_score + 0.5 * second ELSE desc_score END, 6) AS relevance_score
  FROM scored)"""
SEARCH_SQL = f"WITH {R.VEC_SQL}, {R.QUERY_SQL}, {HYBRID_SQL}"


@query("k1_hybrid_search", f"{SEARCH_SQL} SELECT * FROM hits ORDER BY relevance_score DESC, id LIMIT 10")
def hybrid(spark, sf):
    return search.hybrid_search(R.vectors(spark, sf), R.first_vector(spark, sf), 10)


@query("k1_hybrid_search_filtered",
       f"{SEARCH_SQL} SELECT * FROM hits WHERE media = 4 AND confidence = 'medium' ORDER BY relevance_score DESC, id LIMIT 10")
def hybrid_filtered(spark, sf):
    return search.hybrid_search(R.vectors(spark, sf), R.first_vector(spark, sf), 10, media=4, confidence="medium")


@query("k1_blank_query_finds_nothing", f"{SEARCH_SQL} SELECT * FROM hits WHERE 1 = 0")
def hybrid_blank(spark, sf):
    return search.hybrid_search(R.vectors(spark, sf), None, 10)


@query("k2_nearest_with_distance", f"""WITH {R.VEC_SQL}, {R.QUERY_SQL},
s AS (SELECT id, media, round({SIM}, 6) AS similarity FROM vec, q)
SELECT id, media, similarity, round(1 - similarity, 6) AS distance FROM s ORDER BY similarity DESC, id LIMIT 20""")
def nearest(spark, sf):
    return search.nearest_to(R.vectors(spark, sf).select("id", "media", "embedding"), R.first_vector(spark, sf), 20)


ENTITY_VEC_SQL = """ev AS (SELECT CAST(label AS BIGINT) AS media, count(*) AS appearances, min(vec_id) AS first_id,
  arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS representative FROM embeddings GROUP BY label)"""


@query("k3_similar_entities", f"""WITH {ENTITY_VEC_SQL}, {R.QUERY_SQL},
s AS (SELECT media, appearances, first_id, round({R.cosine_sql('ev.representative', 'q.v')}, 6) AS similarity FROM ev, q)
SELECT * FROM s WHERE similarity >= 0.0 ORDER BY similarity DESC, media LIMIT 5""")
def similar_entities(spark, sf):
    rows = R.vectors(spark, sf).groupBy("media").agg(
        F.count(F.lit(1)).alias("appearances"), F.min("id").alias("first_id"), F.min_by("embedding", "id").alias("representative")
    )
    return search.similar_above(rows, R.first_vector(spark, sf), 0.0, 5, "representative", "media")


@query("k4_similar_detections", f"""WITH {R.VEC_SQL}, {R.QUERY_SQL},
s AS (SELECT id, media, round({SIM}, 6) AS similarity FROM vec, q)
SELECT * FROM s WHERE similarity >= 0.2 ORDER BY similarity DESC, id LIMIT 10""")
def similar_detections(spark, sf):
    return search.similar_above(R.vectors(spark, sf).select("id", "media", "embedding"), R.first_vector(spark, sf), 0.2, 10)


@query("k5_knn_join", f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.id AS query_id, b.id AS match_id, round({R.cosine_sql('a.e', 'b.e')}, 6) AS score FROM v a JOIN v b ON a.id <> b.id)
SELECT query_id, match_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS "rank"
FROM s QUALIFY "rank" <= 5""")
def knn(spark, sf):
    v = R.vectors(spark, sf).select("id", "embedding")
    return search.knn_join(v, v, 5, other_only=True)


@query("k5_knn_join_approximate")
def knn_lists(spark, sf):
    """Five nearest of each vector in as many lists as a sample asks for."""
    v = R.vectors(spark, sf).select("id", "embedding")
    centres = IL.fit_centres(v)
    root = scratch_folder(spark)
    IL.save_lists(v, centres, root)
    stored, centres = IL.load_lists(spark, root)
    return IL.knn_join_lists(v, stored, centres, 5, IL.tune_probes(stored, centres, 5), other_only=True)


@query("k4_probed_search")
def probed(spark, sf):
    """The search for one vector in the stored lists nearest to it."""
    v = R.vectors(spark, sf).select("id", "media", "embedding")
    query_vector = R.first_vector(spark, sf)
    centres = IL.fit_centres(v)
    stored = IL.to_lists(v, centres)
    some = IL.probe(stored, centres, query_vector, IL.tune_probes(stored, centres, 10))
    return search.nearest_to(some.drop("list_no"), query_vector, 10)


@query("k6_detections_page", f"""WITH {R.DET_SQL} SELECT id, media, t, entity_id, age, gender, emotion
FROM det ORDER BY t, id LIMIT 500 OFFSET 300""")
def page(spark, sf):
    rows, _ = search.page(R.detections(spark, sf).select("id", "media", "t", "entity_id", "age", "gender", "emotion"), ["t", "id"], 500, 300)
    return rows


@query("k6_page_total", "SELECT count(*) AS total FROM events")
def page_total(spark, sf):
    return search.page(R.detections(spark, sf), ["t", "id"], 500, 300)[1]


@query("k7_first_per_media", f"""WITH {R.DET_SQL} SELECT media, id, t, label,
row_number() OVER (PARTITION BY media ORDER BY t, id) AS "rank" FROM det QUALIFY "rank" <= 3""")
def first_rows(spark, sf):
    return search.first_per_key(R.detections(spark, sf).select("media", "id", "t", "label"), ["media"], ["t", "id"], 3)


@query("k8_first_minutes", f"""WITH {R.MEDIA_SQL}, fr AS (SELECT media, fps, unnest(range(CAST(floor(duration) AS BIGINT))) AS frame_no FROM med)
SELECT media, fps, count(*) AS frames, max(frame_no) AS last_frame FROM fr WHERE frame_no < floor(0.1 * 60 * fps) GROUP BY media, fps""")
def first_minutes(spark, sf):
    m = R.media(spark, sf).withColumn("frame_count", F.floor("duration"))
    head = search.first_minutes(filters.frames_of(m).select("media", "fps", "frame_no"), 0.1)
    return head.groupBy("media", "fps").agg(F.count(F.lit(1)).alias("frames"), F.max("frame_no").alias("last_frame"))


@query("c1_cosine_similarity", f"""WITH {R.VEC_SQL} SELECT id,
round({R.cosine_sql('embedding', 'search_terms_embedding')}, 6) AS similarity FROM vec""")
def cosine(spark, sf):
    v = R.vectors(spark, sf)
    return v.select("id", F.round(cosine_between("embedding", "search_terms_embedding"), 6).alias("similarity"))


@query("p11_search_cards", f"""{SEARCH_SQL} SELECT id, media, segment_index, confidence AS description,
round_even(relevance_score, 3) AS relevance, round_even(desc_score, 3) AS desc_score, round_even(search_score, 3) AS search_score
FROM (SELECT * FROM hits ORDER BY relevance_score DESC, id LIMIT 100)""")
def cards(spark, sf):
    hits = search.hybrid_search(R.vectors(spark, sf).withColumn("description", F.col("confidence")), R.first_vector(spark, sf), 100)
    return filters.search_cards(hits)
