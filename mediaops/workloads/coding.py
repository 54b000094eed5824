"""Code classification, token layouts, overlay texts, passes and confidences."""

from pyspark.sql import functions as F

from mediaops.operators import boxes, codes, rollups, sequences
from mediaops.workloads import roles as R
from mediaops.workloads.registry import query

# Codes from parts: the number and letters of each part in one of several national forms.
CODE_SQL = """code AS (SELECT p_partkey AS id, n3, n4, n2, CASE p_partkey % 9
  WHEN 0 THEN n3 || 'abc' || n2 WHEN 1 THEN 'A' || n3 || 'BC' || n2 WHEN 2 THEN 'В' || n3 || 'КМ' || n2 WHEN 3 THEN 'АВ' || n3 || n2
  WHEN 4 THEN n4 || 'ТР' || n2 WHEN 5 THEN 'X-' || n3 || '-YZ' || n2 WHEN 6 THEN 'B ' || n4 || ' CD' WHEN 7 THEN 'T' || n4 || 'A' ELSE '01KG' || n3 || 'AAA' END AS text
  FROM (SELECT p_partkey, lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS n3, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS n4, lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') AS n2 FROM part))"""


def code_rows(spark, sf):
    p = R.table(spark, sf, "part")

    def digits(c, n):
        return F.lpad((c % 10**n).cast("string"), n, "0")

    n3, n4, n2 = digits(F.col("p_partkey"), 3), digits(F.col("p_partkey"), 4), digits(F.col("p_size"), 2)
    form = F.col("p_partkey") % 9
    text = (
        F.when(form == 0, F.concat(n3, F.lit("abc"), n2)).when(form == 1, F.concat(F.lit("A"), n3, F.lit("BC"), n2))
        .when(form == 2, F.concat(F.lit("В"), n3, F.lit("КМ"), n2)).when(form == 3, F.concat(F.lit("АВ"), n3, n2))
        .when(form == 4, F.concat(n4, F.lit("ТР"), n2)).when(form == 5, F.concat(F.lit("X-"), n3, F.lit("-YZ"), n2))
        .when(form == 6, F.concat(F.lit("B "), n4, F.lit(" CD"))).when(form == 7, F.concat(F.lit("T"), n4, F.lit("A")))
        .otherwise(F.concat(F.lit("01KG"), n3, F.lit("AAA")))
    )
    return p.select(F.col("p_partkey").alias("id"), text.alias("text"))


RULES_SQL = """k AS (SELECT id, text, regexp_replace(upper(text), '[^A-ZА-Я0-9]', '', 'g') AS cleaned FROM code),
l AS (SELECT *, translate(cleaned, 'АВЕКМНОРСТУХЯ', 'ABEKMHOPCTYXR') AS latin FROM k),
c AS (SELECT *, CASE WHEN regexp_matches(latin, '^\\d{3}[A-Z]{3}\\d{2}$') THEN 'kz_new' WHEN regexp_matches(latin, '^[A-Z]\\d{3}[A-Z]{2}\\d{2}$') THEN 'kz_old'
  WHEN regexp_matches(cleaned, '^[А-Я]\\d{3}[А-Я]{2}\\d{2,3}$') THEN 'ru_standard' WHEN regexp_matches(cleaned, '^[А-Я]{2}\\d{3}\\d{2,3}$') THEN 'ru_taxi'
  WHEN regexp_matches(cleaned, '^\\d{4}[ТР]{2}\\d{2,3}$') THEN 'ru_transit' END AS rule, right(cleaned, 2) AS reg FROM l)"""


@query("x1_code_classification", f"""WITH {CODE_SQL}, {RULES_SQL}
SELECT id, text, cleaned, rule, CASE WHEN rule LIKE 'kz%' THEN 'Kazakhstan' WHEN rule LIKE 'ru%' THEN 'Russia' END AS country,
CASE rule WHEN 'kz_new' THEN 'standard' WHEN 'kz_old' THEN 'old_format' WHEN 'ru_standard' THEN 'standard' WHEN 'ru_taxi' THEN 'taxi' WHEN 'ru_transit' THEN 'transit' END AS type,
CASE WHEN rule LIKE 'kz%' THEN CASE reg WHEN '01' THEN 'Almaty' WHEN '02' THEN 'Almaty Region' WHEN '03' THEN 'Akmola Region' WHEN '04' THEN 'Aktobe Region' WHEN '05' THEN 'Atyrau Region'
  WHEN '06' THEN 'West Kazakhstan Region' WHEN '07' THEN 'Zhambyl Region' WHEN '08' THEN 'Karaganda Region' WHEN '09' THEN 'Kostanay Region' WHEN '10' THEN 'Kyzylorda Region'
  WHEN '11' THEN 'Mangystau Region' WHEN '12' THEN 'Pavlodar Region' WHEN '13' THEN 'North Kazakhstan Region' WHEN '14' THEN 'South Kazakhstan Region' WHEN '15' THEN 'East Kazakhstan Region'
  WHEN '16' THEN 'Nur-Sultan' WHEN '17' THEN 'Shymkent' ELSE 'Region ' || reg END
WHEN rule LIKE 'ru%' THEN CASE reg WHEN '77' THEN 'Moscow' WHEN '78' THEN 'Saint Petersburg' WHEN '50' THEN 'Moscow Region' ELSE 'Region ' || reg END END AS region,
CASE WHEN rule IS NOT NULL THEN 0.8 END AS rule_confidence FROM c""")
def classify(spark, sf):
    return codes.classify_codes(code_rows(spark, sf))


@query("x1_code_countries", f"""WITH {CODE_SQL}, {RULES_SQL} SELECT CASE WHEN rule LIKE 'kz%' THEN 'Kazakhstan' ELSE 'Russia' END AS country, count(*) AS n FROM c WHERE rule IS NOT NULL GROUP BY 1""")
def countries(spark, sf):
    good, _ = codes.split_rejects(codes.classify_codes(code_rows(spark, sf)))
    return good.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query("x1_code_rejects", f"WITH {CODE_SQL}, {RULES_SQL} SELECT id, text FROM c WHERE rule IS NULL")
def rejects(spark, sf):
    _, bad = codes.split_rejects(codes.classify_codes(code_rows(spark, sf)))
    return bad.select("id", "text")


@query("x1_code_classification_with_separators", f"""WITH {CODE_SQL}, {RULES_SQL} SELECT id, CASE WHEN text NOT LIKE '%-%' THEN rule END AS rule FROM c""")
def with_separators(spark, sf):
    return codes.classify_codes(code_rows(spark, sf), keep_separators=True).select("id", "rule")


@query("x2_national_codes", f"""WITH {CODE_SQL}, c AS (SELECT id, text, upper(trim(text)) AS cleaned FROM code),
r AS (SELECT *, CASE WHEN regexp_matches(cleaned, '^\\d{{2}}KG\\d{{3}}[A-Z]{{3}}$') THEN 0 WHEN regexp_matches(cleaned, '^[A-Z]\\s*\\d{{4}}\\s*[A-Z]{{2}}$') THEN 2
  WHEN regexp_matches(cleaned, '^[A-Z]\\s*\\d{{4}}\\s*[A-Z]$') THEN 3 END AS rule_no FROM c)
SELECT id, text, cleaned, rule_no, CASE WHEN rule_no IS NOT NULL THEN 'Kyrgyzstan' END AS country,
CASE WHEN rule_no IS NOT NULL THEN CASE WHEN cleaned LIKE 'B%' THEN 'Bishkek' WHEN cleaned LIKE '01%' THEN 'Bishkek' ELSE 'Unknown' END END AS region,
CASE rule_no WHEN 0 THEN 'kg_new_format' WHEN 2 THEN 'kg_individual_latin' WHEN 3 THEN 'kg_individual_latin' END AS type,
CASE rule_no WHEN 0 THEN 'NNKGNNNAAA' WHEN 2 THEN 'LNNNNLL' WHEN 3 THEN 'LNNNL' END AS format FROM r""")
def national(spark, sf):
    return codes.classify_national(code_rows(spark, sf))


NATIONAL_SQL = f"""WITH {CODE_SQL}, c AS (SELECT id, text, upper(trim(text)) AS cleaned FROM code),
r AS (SELECT *, CASE WHEN regexp_matches(cleaned, '^\\d{{2}}KG\\d{{3}}[A-Z]{{3}}$') THEN 'kg_new_format' WHEN regexp_matches(cleaned, '^[A-Z]\\s*\\d{{4}}\\s*[A-Z]{{1,2}}$') THEN 'kg_individual_latin' END AS type FROM c)"""


@query("x2_rejects", NATIONAL_SQL + " SELECT id, text, cleaned FROM r WHERE type IS NULL")
def national_rejects(spark, sf):
    _, bad = codes.split_rejects(codes.classify_national(code_rows(spark, sf)), "rule_no")
    return bad.select("id", "text", "cleaned")


@query("x2_type_counts", NATIONAL_SQL + """ SELECT type, CASE WHEN cleaned LIKE 'B%' OR cleaned LIKE '01%' THEN 'Bishkek' ELSE 'Unknown' END AS region,
count(*) AS codes, min(id) AS first_id, max(id) AS last_id FROM r WHERE type IS NOT NULL GROUP BY 1, 2""")
def national_types(spark, sf):
    """Accepted codes per type and region."""
    good, _ = codes.split_rejects(codes.classify_national(code_rows(spark, sf)), "rule_no")
    return good.groupBy("type", "region").agg(F.count(F.lit(1)).alias("codes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def crop_rows(spark, sf):
    """A crop per part with parallel token arrays: its texts and boxes depend on the part."""
    p = R.table(spark, sf, "part")
    k = F.col("p_partkey")
    n3 = F.lpad((k % 1000).cast("string"), 3, "0")
    region = F.lpad((F.col("p_size") % 100).cast("string"), 2, "0")
    form = k % 12

    def poly(x, y, w, h):
        corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        return F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in corners])

    left, right, top, low = poly(0, 0, 40, 20), poly(45, 1, 40, 20), poly(100, 0, 40, 20), poly(100, 30, 40, 20)
    under = poly(45, 30, 40, 20)
    layouts = {
        0: ([F.concat(n3, F.lit("ABC"))], [left]),
        1: ([F.concat(n3, F.lit("ABC")), region], [left, right]),
        2: ([F.concat(n3, F.lit("ABC")), F.lit("KS")], [left, right]),
        3: ([F.concat(n3, F.lit("ABC")), F.lit("kg"), region], [left, low, top]),
        4: ([n3, F.lit("adg"), region], [left, right, top]),
        5: ([n3, F.lit("ADG"), region], [top, low, left]),
        6: ([n3, F.lit("ADG"), region, F.lit("KG1")], [left, right, top, low]),
        7: ([region, F.lit("KG"), n3, F.lit("ADG")], [left, poly(0, 18, 40, 20), top, poly(100, 18, 40, 20)]),
        8: ([F.concat(n3, F.lit("ABC")), F.concat(n3, F.lit("XYZ"))], [left, right]),
        9: ([F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D"), F.lit("E")], [left, right, top, low, under]),
        10: ([F.lit("SOLO")], [left]),
        11: ([n3, F.lit(" "), F.lit("ADG"), F.lit("GD")], [left, right, right, top]),
    }
    texts, polygons = F, F
    for i, (t, q) in layouts.items():
        texts, polygons = texts.when(form == i, F.array(*t)), polygons.when(form == i, F.array(*q))
    rows = p.select(k.alias("crop_id"), texts.alias("texts"), polygons.alias("polygons"), (F.col("p_size") / 100).alias("base"))
    return rows.select(
        "crop_id", "texts", F.transform("texts", lambda t, i: F.col("base") + i / 10).alias("scores"),
        F.array().cast("array<array<int>>").alias("boxes"), "polygons", F.array().cast("array<double>").alias("angles"),
    )


def tokens(spark, sf):
    return codes.tokens_from_arrays(crop_rows(spark, sf))


@query("x4_normalised_tokens", """SELECT p_partkey % 12 AS form, count(*) AS crops FROM part GROUP BY 1""")
def normalised(spark, sf):
    per_crop = tokens(spark, sf).groupBy("crop_id").agg(F.max("right").alias("right"))
    return per_crop.groupBy((F.col("crop_id") % 12).alias("form")).agg(F.count(F.lit(1)).alias("crops"))


LAYOUT_SQL = """lay AS (SELECT p_partkey AS crop_id, p_partkey % 12 AS form, lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS n3,
  replace(replace(lpad(CAST(p_size % 100 AS VARCHAR), 2, '0'), '61', '01'), '10', '01') AS reg FROM part)"""


@query("x3_token_layouts", f"""WITH {LAYOUT_SQL} SELECT crop_id, CASE form WHEN 0 THEN 'unknown' WHEN 1 THEN 'linear' WHEN 2 THEN 'linear' WHEN 3 THEN 'stacked' WHEN 4 THEN 'linear_3_elements'
  WHEN 5 THEN 'stacked_with_region' WHEN 6 THEN 'linear_4_elements' WHEN 7 THEN 'double_stacked' WHEN 8 THEN 'ambiguous_multiple_plates' WHEN 9 THEN 'unhandled_5_elements' WHEN 10 THEN 'single' ELSE 'linear_3_elements' END AS layout_type,
CASE WHEN form IN (1, 3, 4, 5, 6, 7) THEN reg WHEN form = 11 THEN '00' END AS region_code,
CASE WHEN form IN (1, 4, 5, 11) THEN 'KG?' WHEN form IN (2, 3, 6, 7) THEN 'KG' END AS country_code,
CASE WHEN form IN (0, 1, 2, 3) THEN n3 || 'ABC' WHEN form IN (4, 5, 6, 7, 11) THEN n3 || 'ADG' WHEN form = 10 THEN 'SOLO' END AS plate_number,
CASE WHEN form IN (8, 9) THEN '' ELSE concat_ws(' ', CASE WHEN form IN (1, 3, 4, 5, 6, 7) THEN reg WHEN form = 11 THEN '00' END, CASE WHEN form IN (2, 3, 6, 7) THEN 'KG' END,
  CASE WHEN form IN (0, 1, 2, 3) THEN n3 || 'ABC' WHEN form IN (4, 5, 6, 7, 11) THEN n3 || 'ADG' WHEN form = 10 THEN 'SOLO' END) END AS full_text,
form IN (1, 2, 3, 4, 5, 6, 7, 11) AS extraction_success FROM lay""")
def layouts(spark, sf):
    return codes.assemble_layout(tokens(spark, sf)).drop("tokens", "confidence")


@query("x3_region_rewrites", """SELECT code, replace(replace(code, '61', '01'), '10', '01') AS repaired, count(*) AS n FROM (
SELECT lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') AS code FROM part WHERE p_partkey % 12 IN (1, 3, 4, 5, 6, 7)) GROUP BY ALL""")
def rewrites(spark, sf):
    return codes.region_rewrites(tokens(spark, sf))


# Boxes of the tokens of each form, as crop_rows places them: form, position, left, top, right, bottom.
_BOXES = {
    1: "LR", 2: "LR", 3: "LBT", 4: "LRT", 5: "TBL", 6: "LRTB", 7: "LCTD", 8: "LR", 9: "LRTBU", 11: "LRT",
}
_PLACES = {"L": (0, 0), "R": (45, 1), "T": (100, 0), "B": (100, 30), "U": (45, 30), "C": (0, 18), "D": (100, 18)}
_BOX_SQL = ", ".join(
    f"({form}, {i}, {x}, {y}, {x + 40}, {y + 20})" for form, names in _BOXES.items() for i, (x, y) in enumerate(_PLACES[n] for n in names)
)


@query("j14_j15_token_pairs", f"""WITH g(form, pos, l, t, r, b) AS (VALUES {_BOX_SQL}),
c AS (SELECT p_partkey AS crop_id, g.* FROM part JOIN g ON p_partkey % 12 = form),
p AS (SELECT u.crop_id, u.pos AS first_pos, v.pos AS second_pos,
 u.b < v.t OR (u.t < v.t AND u.b - v.t <= least(u.b - u.t, v.b - v.t) * 0.4
   AND greatest(0, least(u.r, v.r) - greatest(u.l, v.l)) >= least(u.r - u.l, v.r - v.l) * 0.5) AS above,
 abs(u.t - v.t) < least(u.b - u.t, v.b - v.t) * 0.25 AND abs(u.b - v.b) < least(u.b - u.t, v.b - v.t) * 0.25 AND u.l < v.l
   AND (least(u.r, v.r) - greatest(u.l, v.l) <= 0 OR least(u.r, v.r) - greatest(u.l, v.l) < least(u.r - u.l, v.r - v.l) * 0.3) AS beside
 FROM c u JOIN c v ON u.crop_id = v.crop_id AND u.pos <> v.pos)
SELECT * FROM p WHERE above OR beside""")
def pairs(spark, sf):
    return boxes.token_pairs(tokens(spark, sf).select("crop_id", "pos", "left", "top", "right", "bottom"))


@query("a20_token_confidence", """SELECT p_partkey AS crop_id, CASE p_partkey % 12 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 4 WHEN 8 THEN 2 WHEN 9 THEN 5 WHEN 10 THEN 1 ELSE 3 END AS tokens,
round(p_size / 100 + CASE p_partkey % 12 WHEN 0 THEN 0 WHEN 1 THEN 0.05 WHEN 2 THEN 0.05 WHEN 3 THEN 0.1 WHEN 4 THEN 0.1 WHEN 5 THEN 0.1 WHEN 6 THEN 0.15 WHEN 7 THEN 0.15 WHEN 8 THEN 0.05 WHEN 9 THEN 0.2 WHEN 10 THEN 0 ELSE 0.5 / 3 END, 6) AS confidence FROM part""")
def confidence(spark, sf):
    return rollups.token_confidence(tokens(spark, sf))


@query("a20_combined_confidence", "SELECT l_orderkey AS id, l_linenumber AS pos, round((l_discount * 10 + l_tax * 10) / 2, 6) AS combined FROM lineitem")
def combined(spark, sf):
    return R.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"),
        F.round(rollups.combined_confidence(F.col("l_discount") * 10, F.col("l_tax") * 10), 6).alias("combined"),
    )


@query("a22_region_texts", """SELECT user_id AS region_id, string_agg(upper(replace(event_type, ' ', '')), '' ORDER BY event_id) AS text FROM events WHERE value > 0.3 GROUP BY user_id""")
def region_texts(spark, sf):
    rows = R.table(spark, sf, "events").select(
        F.col("user_id").alias("region_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"), F.col("value").alias("confidence")
    )
    return codes.region_texts(rows)


OVERLAY_SQL = """ov AS (SELECT user_id AS image_id, event_id AS pos, value AS confidence, event_type,
  CASE event_type WHEN 'click' THEN 'SPEED ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' KM/H' WHEN 'view' THEN 'Head 12:' || lpad(CAST(user_id % 60 AS VARCHAR), 2, '0') || ':01'
  WHEN 'error' THEN 'tail' ELSE event_type END AS text FROM events)"""


@query("x5_overlay_readings", f"""WITH {OVERLAY_SQL} SELECT image_id, count(*) AS tokens, CAST(floor(arg_max(confidence, pos) FILTER (event_type = 'click')) AS BIGINT) AS speed, 'km/h' AS speed_unit,
arg_max(CASE event_type WHEN 'view' THEN 'approaching' ELSE 'receding' END, pos) FILTER (event_type IN ('view', 'error')) AS direction,
arg_max('12:' || lpad(CAST(image_id % 60 AS VARCHAR), 2, '0') || ':01', pos) FILTER (event_type = 'view') AS clock,
coalesce(max(confidence) FILTER (event_type = 'click'), 0.0) AS confidence FROM ov GROUP BY image_id""")
def overlay(spark, sf):
    e = R.table(spark, sf, "events")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit("SPEED "), F.floor("value").cast("string"), F.lit(" KM/H")))
        .when(kind == "view", F.concat(F.lit("Head 12:"), F.lpad((F.col("user_id") % 60).cast("string"), 2, "0"), F.lit(":01")))
        .when(kind == "error", F.lit("tail")).otherwise(kind)
    )
    rows = e.select(F.col("user_id").alias("image_id"), F.col("event_id").alias("pos"), F.col("value").alias("confidence"), text.alias("text"))
    return codes.overlay_readings(rows)


PASS_SQL = """ps AS (SELECT l_orderkey AS region_id, 'fullscreen' AS source, 0 AS pass_no, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS pos, l_discount AS confidence, l_returnflag AS text FROM lineitem WHERE l_returnflag <> 'N'
  UNION ALL SELECT o_orderkey, 'vehicle_zones', 1, o_custkey, o_totalprice / 10000000, o_orderpriority FROM orders WHERE o_orderstatus <> 'P')"""


def passes(spark, sf):
    full = R.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("region_id"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("text"), (F.col("l_returnflag") != "N").alias("extraction_success"),
    )
    zones = R.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("region_id"), F.col("o_custkey").alias("pos"), (F.col("o_totalprice") / 10000000).alias("confidence"),
        F.col("o_orderpriority").alias("text"), (F.col("o_orderstatus") != "P").alias("extraction_success"),
    )
    return rollups.union_passes({"fullscreen": full, "vehicle_zones": zones})


@query("e1_union_of_passes", f"WITH {PASS_SQL} SELECT * FROM ps")
def union(spark, sf):
    return passes(spark, sf).drop("extraction_success")


@query("a18_best_codes", f"""WITH {PASS_SQL} SELECT region_id, arg_max(pos, (confidence, -pos)) AS pos, max(confidence) AS confidence FROM ps GROUP BY region_id""")
def best(spark, sf):
    return rollups.best_codes(passes(spark, sf)).select("region_id", "pos", "confidence")


@query("a19_first_usable_code", """WITH a AS (SELECT o_custkey AS c, arg_min(o_orderpriority, o_orderkey) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT s_suppkey AS c, s_name AS t FROM supplier)
SELECT c_custkey AS path, coalesce(a.t, b.t) AS code, coalesce(a.t, b.t) IS NOT NULL AS recognised FROM customer LEFT JOIN a ON a.c = c_custkey LEFT JOIN b ON b.c = c_custkey""")
def first_usable(spark, sf):
    images = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("path"))
    found = R.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("recognized_text"),
    )
    other = R.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"), F.lit(0).alias("pos"), F.col("s_name").alias("text"))
    return sequences.first_usable_code(found, other, images)


def metadata_rows(spark, sf):
    """Nested still metadata per order: line items as vehicles, the order as its code."""
    li = R.table(spark, sf, "lineitem")
    # An order has at most a few line items per line number; they stand for the objects of one image.
    v = li.groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_returnflag").alias("type"), F.col("l_discount").alias("confidence"), (F.col("l_returnflag") == "R").alias("is_primary"))).alias("vehicles")
    )
    o = R.table(spark, sf, "orders").join(v, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(
        F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("status"),
        F.struct(F.struct(F.lit(1280).alias("width"), F.lit(720).alias("height")).alias("dimensions")).alias("file_info"),
        F.struct(F.when(F.col("o_orderstatus") != "P", (F.col("o_totalprice") / 5000).cast("int")).alias("speed"), F.lit("approaching").alias("direction")).alias("radar_data"),
        "vehicles", F.array(F.struct(F.col("o_orderpriority").alias("text"))).alias("license_plates"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.col("o_orderpriority").alias("recognized_text")))).alias("yolo_plate_detections"),
    )


@query("p13_flattened_vehicles", """SELECT o_orderkey AS path, l_returnflag AS type, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def flat_vehicles(spark, sf):
    return sequences.flatten_stills(metadata_rows(spark, sf))["vehicles"].groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


@query("p13_flattened_images", """SELECT o_orderkey AS path, o_orderstatus AS status, 1280 AS width, 720 AS height, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 5000) AS INTEGER) END AS speed,
'approaching' AS direction, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS vehicles, 1 AS codes, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS code_boxes FROM orders""")
def flat_images(spark, sf):
    return sequences.flatten_stills(metadata_rows(spark, sf))["images"]


@query("a12_nested_image_statistics", """SELECT o_orderkey AS path, count(l_orderkey) AS vehicles_detected, 1 AS plates_detected, CASE any_value(o_orderstatus) WHEN 'F' THEN 1 ELSE 0 END AS yolo_plates_detected,
CASE any_value(o_orderstatus) WHEN 'F' THEN 1 ELSE 0 END AS yolo_plates_with_ocr, 1 AS unique_plates, any_value(o_orderstatus) <> 'P' AS has_speed_data,
coalesce(bool_or(l_returnflag = 'R'), false) AS primary_vehicle_detected FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def nested_statistics(spark, sf):
    return rollups.image_statistics(metadata_rows(spark, sf))
