"""Model responses, transcripts, translations, keyword texts."""

from pyspark.sql import functions as F

from mediaops.operators import keywords, labels, responses, segments, transcripts
from mediaops.workloads import roles as R
from mediaops.workloads.registry import query

# A response per document: its whole text as description in one of several wrappings, as a JSON string where the wrapping
# is JSON.  d is what the repair leaves of it: characters 7F to 9F and commas before a closing bracket go, and a text under
# a heading ends at the next bold mark or empty line.
RESP_SQL = r"""raw AS (SELECT source AS media, doc_id AS segment_index, lang, n_chars, doc_id % 6 AS form, coalesce(text, '') AS text FROM documents),
resp AS (SELECT *, string_split(text, ' ') AS words, regexp_replace(regexp_replace(CASE form WHEN 3 THEN
  CASE WHEN regexp_full_match(text, '[ \t\n\x0B\f\r]*') THEN '**Keywords:' ELSE regexp_replace(regexp_extract(regexp_replace(text, '^[ \t\n\x0B\f\r]+', '') || chr(10) || chr(10), '(?s)^(.+?)(\*\*|\n\n)', 1), '[ \t\n\x0B\f\r]+$', '') END
  ELSE text END, '[\x{7f}-\x{9f}]', '', 'g'), ', *([}\]])', '\1', 'g') AS d FROM raw)"""
CASES = {
    0: ("plain", '{"description": "%s", "confidence": "high"}'),
    1: ("fenced", 'Answer:\n```json\n{"description": "%s", "confidence": "high",}\n```\nend'),
    2: ("closed", '{"description": "%s", "confidence": "high"'),
    3: ("markdown", "**Description:** %s\n\n**Keywords:** one, two; three\n\n**Mood:** calm"),
    4: ("invalid", "no json: %s"),
    5: ("plain", '{"description": "%s", "mchange": true, "information": "new", "keywords": "single"}'),
}


def response_rows(spark, sf):
    d = R.table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    form = F.col("doc_id") % 6
    quoted = F.to_json(F.struct(F.col("text").alias("t")))
    escaped = F.substring(quoted, F.lit(7), F.length(quoted) - 8)  # without {"t":" and "}
    text = F
    for i, (outcome, template) in CASES.items():
        inner = F.col("text") if outcome in ("markdown", "invalid") else escaped
        text = text.when(form == i, F.concat(F.lit(template.split("%s")[0]), inner, F.lit(template.split("%s")[1])))
    return d.select(
        F.col("source").alias("media"), F.col("doc_id").alias("segment_index"), "lang", form.alias("form"),
        F.split("text", " ").alias("words"), text.alias("response"), "text",
    )


@query("x7_response_outcomes", f"""WITH {RESP_SQL} SELECT segment_index, CASE form WHEN 1 THEN 'fenced' WHEN 2 THEN 'closed' WHEN 3 THEN 'markdown' WHEN 4 THEN 'invalid' ELSE 'plain' END AS outcome,
CASE WHEN form <> 4 THEN d END AS description FROM resp""")
def outcomes(spark, sf):
    rows = responses.repair_responses(response_rows(spark, sf))
    described = F.get_json_object("json_text", "$.description")
    return rows.select("segment_index", "outcome", described.alias("description"))


@query("x7_outcome_counts", f"""WITH {RESP_SQL} SELECT CASE form WHEN 1 THEN 'fenced' WHEN 2 THEN 'closed' WHEN 3 THEN 'markdown' WHEN 4 THEN 'invalid' ELSE 'plain' END AS outcome, count(*) AS n FROM resp GROUP BY 1""")
def outcome_counts(spark, sf):
    return responses.outcome_counts(responses.repair_responses(response_rows(spark, sf)))


@query("x8_field_repair", f"""WITH {RESP_SQL} SELECT segment_index,
CASE WHEN form <> 4 THEN d END AS description,
CASE form WHEN 4 THEN NULL WHEN 3 THEN 'средняя' WHEN 5 THEN 'средняя' ELSE 'high' END AS confidence,
CASE form WHEN 5 THEN 'true' WHEN 3 THEN 'false' END AS scene_change, CASE form WHEN 5 THEN 'new' WHEN 3 THEN 'Информация извлечена из markdown' END AS new_information,
CASE form WHEN 5 THEN 'single' WHEN 3 THEN 'one|two|three' END AS keywords FROM resp""")
def field_repair(spark, sf):
    rows = responses.repair_fields(responses.repair_responses(response_rows(spark, sf)))
    return rows.select(
        "segment_index", "analysis.description", "analysis.confidence", "analysis.scene_change", "analysis.new_information",
        F.array_join("analysis.keywords", "|").alias("keywords"),
    )


@query("x9_quality_flags", f"""WITH {RESP_SQL}, a AS (SELECT *, lag(text) OVER (PARTITION BY media ORDER BY segment_index) AS prev, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS st FROM resp)
SELECT media, segment_index, array_to_string(list_filter([
  CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'chinese_characters' END,
  CASE WHEN length(text) < 20 THEN 'short_description' END,
  CASE WHEN prev <> '' AND prev = text THEN 'duplicate_description' END,
  CASE WHEN regexp_full_match(text, '[ \\t\\n\\x0B\\f\\r]*') OR trim(coalesce(lang, '')) = '' THEN 'empty_required_fields' END,
  CASE WHEN lang <> '' AND lower(lang) NOT IN ('высокая', 'средняя', 'низкая', 'high', 'medium', 'low') THEN 'invalid_confidence' END,
  CASE WHEN len(words) > 5 AND len(list_filter(range(len(words) - 3), lambda i: words[i + 1] = words[i + 2] AND words[i + 1] = words[i + 3] AND words[i + 1] = words[i + 4])) > 0 THEN 'keyword_loop' END,
  CASE WHEN len(words) > 10 AND len(list_distinct(words)) / CAST(len(words) AS DOUBLE) < 0.3 THEN 'keyword_flood' END,
  CASE WHEN length(text) > 100 AND len(st) > 10 AND len(list_distinct(st)) / CAST(len(st) AS DOUBLE) < 0.3 THEN 'search_terms_loop' END
], lambda x: x IS NOT NULL), ',') AS flags FROM a""")
def quality(spark, sf):
    rows = response_rows(spark, sf).withColumn(
        "analysis",
        F.struct(
            F.col("text").alias("description"), F.col("lang").alias("confidence"), F.col("words").alias("keywords"),
            F.col("text").alias("search_terms"),
        ),
    ).withColumn("response", F.col("text"))
    return responses.quality_flags(rows).select("media", "segment_index", F.array_join("flags", ",").alias("flags"))


@query("p10_search_documents", f"""WITH {RESP_SQL} SELECT media || '_seg_' || CAST(segment_index AS VARCHAR) AS id, media, segment_index,
regexp_replace(text || ' ' || text || ' ' || text, '^\\s+|\\s+$', '', 'g') AS document, nullif(substring(text, 1, 500), '') AS description,
nullif(substring(text, 1, 200), '') AS keywords, 'средняя' AS confidence, substring(lang, 1, 50) AS content_type, nullif(substring(text, 1, 500), '') AS search_terms
FROM resp WHERE regexp_replace(text || ' ' || text || ' ' || text, '^\\s+|\\s+$', '', 'g') <> ''""")
def documents(spark, sf):
    rows = response_rows(spark, sf).withColumn(
        "analysis",
        F.to_json(
            F.struct(
                F.col("text").alias("description"), F.col("text").alias("dialogue_translation"), F.col("words").alias("keywords"),
                F.col("text").alias("search_terms"), F.col("lang").alias("content_type"),
            )
        ),
    )
    rows = rows.withColumns({"start_time": F.lit(0.0), "end_time": F.lit(50.0), "duration": F.lit(50.0)})
    return responses.search_documents(rows).drop("start_time", "end_time", "duration")


@query("a15_parse_quality", f"""WITH {RESP_SQL}, k AS (SELECT media, count(*) AS total, count(*) FILTER (form IN (0, 5)) AS parsed, count(*) FILTER (form NOT IN (0, 5)) AS fallback FROM resp GROUP BY media)
SELECT *, round(100.0 * parsed / total, 6) AS parsed_pct, round(100.0 * fallback / total, 6) AS fallback_pct, round(100.0 * (parsed + fallback) / total, 6) AS kept_pct FROM k""")
def parse_quality(spark, sf):
    return responses.parse_quality(response_rows(spark, sf).withColumn("analysis", F.col("response")))


@query("x10_normalised_utterances", f"""WITH {R.UTT_SQL}, n AS (SELECT media, pos, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, "start", "end", CAST(floor("start") AS BIGINT) AS s FROM utt)
SELECT media, pos, text, round("end" - "start", 6) AS duration, len(string_split_regex(text, '\\s+')) AS word_count,
lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS start_formatted FROM n WHERE text <> ''""")
def normalised(spark, sf):
    rows = transcripts.normalise_utterances(R.utterances(spark, sf))
    return rows.select("media", "pos", "text", F.round("duration", 6).alias("duration"), "word_count", "start_formatted")


@query("x12_rendered_chunks", f"""WITH RECURSIVE {R.UTT_SQL}, n AS (SELECT *, length(text) AS size FROM utt),
w(media, pos, chunk, used) AS (
  SELECT media, pos, 0, size FROM n WHERE pos = 0
  UNION ALL
  SELECT n.media, n.pos, CASE WHEN w.used + n.size > 1500 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.used + n.size > 1500 THEN n.size ELSE w.used + n.size END
  FROM w JOIN n ON n.media = w.media AND n.pos = w.pos + 1)
SELECT media, chunk, count(*) AS lines, string_agg(CAST(pos AS VARCHAR) || ',' || CAST(pos + 1 AS VARCHAR) || ',' || text || ',a,b', chr(10) ORDER BY pos) AS rendered
FROM w JOIN n USING (media, pos) GROUP BY ALL""")
def rendered(spark, sf):
    chunked = segments.character_chunks(R.utterances(spark, sf), limit=1500)
    rows = chunked.withColumns(
        {"start": F.col("pos"), "end": F.col("pos") + 1, "start_formatted": F.lit("a"), "end_formatted": F.lit("b")}
    )
    return transcripts.render_chunks(rows)


@query("x11_translated_lines", """WITH l AS (SELECT conv_id AS media, turn AS pos, CASE WHEN turn % 3 = 2 THEN 'x,' ELSE '' END || CAST(turn AS VARCHAR) || '.5,' || CAST(turn + 1 AS VARCHAR) || ',"' || replace(text, chr(10), ' ') || '",00:00:01,00:00:02' AS line,
  replace(text, chr(10), ' ') AS clean FROM conversations)
SELECT media, pos, pos % 3 <> 2 AS ok, CASE WHEN pos % 3 <> 2 THEN pos + 0.5 END AS "start", CASE WHEN pos % 3 <> 2 THEN regexp_replace(regexp_replace('"' || clean || '"', '^"+|"+$', '', 'g'), '^\\s+|\\s+$', '', 'g') END AS translated,
CASE WHEN pos % 3 <> 2 THEN '00:00:02' END AS end_formatted FROM l""")
def translated_lines(spark, sf):
    c = R.table(spark, sf, "conversations")
    line = F.concat(
        F.when(F.col("turn") % 3 == 2, "x,").otherwise(""), F.col("turn").cast("string"), F.lit(".5,"),
        (F.col("turn") + 1).cast("string"), F.lit(',"'), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('",00:00:01,00:00:02'),
    )
    rows = c.select(F.col("conv_id").alias("media"), F.col("turn").alias("pos"), line.alias("line"))
    return transcripts.parse_lines(rows).select("media", "pos", "ok", "start", "translated", "end_formatted")


@query("j12_matched_translations", """WITH c AS (SELECT conv_id AS media, turn AS line_no, replace(text, chr(10), ' ') AS text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
r AS (SELECT media, line_no, text AS original_text, CASE WHEN line_no % 4 = 1 THEN '[TRANSLATION_PARSE_FAILED]' ELSE 'T' || CAST(line_no AS VARCHAR) END AS translated_text FROM c WHERE line_no < last),
n AS (SELECT media, count(*) AS k FROM r GROUP BY media)
SELECT * FROM r UNION ALL SELECT c.media, line_no, text, '[TRANSLATION_MISSING]' FROM c LEFT JOIN n USING (media) WHERE line_no >= coalesce(k, 0)""")
def matched(spark, sf):
    c = R.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("media"), F.lit(0).alias("chunk"), F.col("turn").cast("int").alias("line_no"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"),
    )
    last = c.groupBy("media").agg(F.max("line_no").alias("last"))
    line = F.when(F.col("line_no") % 4 == 1, F.lit("no numbers here")).otherwise(
        F.concat(F.col("line_no").cast("string"), F.lit(",1,T"), F.col("line_no").cast("string"), F.lit(",a,b"))
    )
    # An answer holds the lines of one chunk, whose size is bounded by the character budget.
    answers = (
        c.join(last, "media").filter("line_no < last").groupBy("media", "chunk")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("answer"))
    )
    return transcripts.match_translations(answers, c).select("media", "line_no", "original_text", "translated_text")


SIGNS = {"AUTOMOBILE": "Toyota Avenue", "BUILDING": "Проспект Mercedes", "FURNITURE": "ул. KIA BMW", "HOUSEHOLD": "High Street"}
SIGN_SQL = "sign AS (SELECT c_custkey AS pos, c_nationkey AS image_id, c_acctbal AS confidence, c_name || ' ' || CASE c_mktsegment " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in SIGNS.items()) + " ELSE 'none' END AS text FROM customer)"


def sign_rows(spark, sf):
    c = R.table(spark, sf, "customer")
    text = F
    for segment, words in SIGNS.items():
        text = text.when(F.col("c_mktsegment") == segment, words)
    return c.select(
        F.col("c_custkey").alias("pos"), F.col("c_nationkey").alias("image_id"), F.col("c_acctbal").alias("confidence"),
        F.concat_ws(" ", "c_name", text.otherwise("none")).alias("text"),
    )


@query("j9_street_signs", f"""WITH {SIGN_SQL} SELECT pos, text, CASE WHEN contains(lower(text), 'проспект') THEN 'проспект' WHEN contains(lower(text), 'ул.') THEN 'ул.'
WHEN contains(lower(text), 'street') THEN 'street' ELSE 'avenue' END AS keyword_found FROM sign WHERE regexp_matches(lower(text), 'проспект|ул\\.|street|avenue')""")
def streets(spark, sf):
    return labels.street_signs(sign_rows(spark, sf)).select("pos", "text", "keyword_found")


@query("j9_brand_texts", f"""WITH {SIGN_SQL}, b AS (SELECT *, CASE WHEN contains(upper(text), 'TOYOTA') THEN 'TOYOTA' WHEN contains(upper(text), 'KIA') THEN 'KIA' END AS brand FROM sign)
SELECT image_id, arg_min(brand, pos) AS brand, arg_min(confidence, pos) AS confidence FROM b WHERE brand IS NOT NULL GROUP BY image_id""")
def brands(spark, sf):
    return labels.brand_texts(sign_rows(spark, sf))


@query("j9_listed_keywords", """WITH k AS (SELECT p_partkey AS place, split_part(p_name, ' ', 1) AS keyword FROM part UNION ALL SELECT 1000000 + c_custkey, substr(c_name, 10) FROM customer
  UNION ALL SELECT 2000000 + min(doc_id), split_part(text, ' ', 3) AS w FROM documents GROUP BY w),
d AS (SELECT keyword, min(place) AS place FROM k WHERE keyword <> '' GROUP BY 1), t AS (SELECT conv_id, turn, text FROM conversations)
SELECT t.conv_id, t.turn, arg_min(d.keyword, d.place) AS keyword_found FROM t LEFT JOIN d ON contains(t.text, d.keyword) GROUP BY 1, 2""")
def listed_keywords(spark, sf):
    """A keyword table from part names, customer numbers and words of documents, looked up in every turn of the conversations."""
    parts = R.table(spark, sf, "part").select(F.col("p_partkey").alias("place"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("keyword"))
    numbers = R.table(spark, sf, "customer").select((F.lit(1000000) + F.col("c_custkey")).alias("place"), F.substr("c_name", F.lit(10)).alias("keyword"))
    third = R.table(spark, sf, "documents").groupBy(F.split_part("text", F.lit(" "), F.lit(3)).alias("keyword"))
    words = third.agg((F.lit(2000000) + F.min("doc_id")).alias("place")).select("place", "keyword")
    turns = R.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return keywords.first_listed(turns, parts.union(numbers).union(words)).select("conv_id", "turn", "keyword_found")


@query("x10_word_times", f"""WITH {R.UTT_SQL}, w AS (SELECT media, pos, "start", unnest(string_split(text, ' ')) AS raw, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM utt
 WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '')
SELECT media, pos, i AS word_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS word, CASE i % 2 WHEN 0 THEN 0.5 ELSE 0.0 END AS probability,
lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS start_formatted
FROM (SELECT *, CAST(floor("start" + i) AS BIGINT) AS s FROM w)""")
def word_times(spark, sf):
    """Nested words, one a second, half of them without a probability."""
    u = R.utterances(spark, sf)
    words = F.transform(
        F.split("text", " "),
        lambda w, i: F.struct(
            w.alias("word"), (F.col("start") + i).alias("start"), (F.col("start") + i + 1).alias("end"),
            F.when(i % 2 == 0, F.lit(0.5)).alias("probability"),
        ),
    )
    rows = transcripts.normalise_utterances(u.withColumn("words", words), words=True)
    return rows.select("media", "pos", F.posexplode("words").alias("word_no", "w")).select(
        "media", "pos", F.col("word_no").cast("long").alias("word_no"), "w.word", "w.probability", "w.start_formatted"
    )


SCENE_TEXTS = list(labels.SCENES)[:9]


@query("j7_scene_names", "SELECT event_id, CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{labels.SCENES[t]}'" for i, t in enumerate(SCENE_TEXTS))
       + f" ELSE '{labels.UNKNOWN_SCENE}' END AS scene FROM events")
def scene_names(spark, sf):
    e = R.table(spark, sf, "events")
    text = F.get(F.array(*[F.lit(t) for t in SCENE_TEXTS], F.lit("something else")), (F.col("event_id") % 10).cast("int"))
    return e.select("event_id", labels.scene_name(text).alias("scene"))
