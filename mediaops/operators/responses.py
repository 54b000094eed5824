"""Model responses: repair into JSON, field repair, quality flags, search documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.operators.segments import strip_text, text_hash
from mediaops.plans.slices import MAX_GROUP_ROWS, has_large_group, with_previous

FENCE = "```"
# Headings that mark a structured text answer.
HEADINGS = [
    "**Описание:**", "**Description:**", "**Диалог:**", "**Dialogue:**", "**Ключевые слова:**", "**Keywords:**",
    "**Тип контента:**", "**Content type:**", "**Атмосfera:**", "**Mood:**", "- Описание:", "- Description:",
    "- Диалог:", "- Dialogue:", "- Ключевые слова:", "- Keywords:",
]
# Field, its Russian and its English heading.
FIELD_HEADINGS = [
    ("description", "Описание", "Description"),
    ("dialogue_translation", "Диалог", "Dialogue"),
    ("keywords", "Ключевые слова", "Keywords"),
    ("content_type", "Тип контента", "Content type"),
    ("mood_atmosphere", "Атмосфера", "Mood"),
]
# Defaults of missing fields.
NO_DESCRIPTION = "Описание недоступно"
DEFAULT_CONFIDENCE = "средняя"
FROM_MARKDOWN = "Информация извлечена из markdown"
FALLBACK_DESCRIPTION = "JSON парсинг неуспешен - используется fallback"
CONFIDENCES = ["высокая", "средняя", "низкая", "high", "medium", "low"]
CRITICAL_FLAGS = ["keyword_loop", "keyword_flood", "search_terms_loop"]

ANALYSIS = (
    "description string, dialogue_translation string, keywords array<string>, search_terms string, "
    "content_type string, mood_atmosphere string, scene_change string, mchange string, "
    "new_information string, information string, confidence string"
)


def _inside_fence(text: Column) -> Column:
    """Text of a json fence (up to its end or the end of the text), or of a plain outer fence."""
    opened = F.instr(text, FENCE + "json")
    body = F.substring_index(F.expr("substring(_t, instr(_t, '```json') + 7)"), FENCE, 1)
    lines = F.split(text, "\n")
    inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(opened > 0, strip_text(body)).when(
        text.startswith(FENCE) & text.endswith(FENCE) & (F.size(lines) > 2), inner
    ).otherwise(text)


def _markdown_field(text: Column, russian: str, english: str) -> Column:
    """Value under a heading: bold Russian, bold English, then list item forms."""
    patterns = [rf"(?is)\*\*{h}:\*\*\s*(.+?)(?=\*\*|\n\n|$)" for h in (russian, english)]
    patterns += [rf"(?is)- {h}:\s*(.+?)(?=\n-|\n\n|$)" for h in (russian, english)]
    patterns = [p.replace("(?is)", "(?isu)") for p in patterns]
    return F.coalesce(*[F.when(text.rlike(p), strip_text(F.regexp_extract(text, p, 1))) for p in patterns])


def _keyword_list(value: Column) -> Column:
    items = F.transform(F.split(F.regexp_replace(value, r"(?m)^[-*]\s*", ""), r"[,;]|\n"), strip_text)
    kept = F.filter(items, lambda x: x != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(value))


def is_structured(text: Column) -> Column:
    """At least two of the known headings occur, ignoring case."""
    low = F.lower(text)
    found = reduce(lambda a, b: a + b, [low.contains(h.lower()).cast("int") for h in HEADINGS])
    return found >= 2


def _clean(text: Column) -> Column:
    """Control characters, blanks at line ends and commas before a closing bracket removed."""
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    text = F.regexp_replace(text, r"[^\S\n]+(?=\n|$)", "")
    return strip_text(F.regexp_replace(text, r",\s*([}\]])", "$1"))


def repair_responses(responses: DataFrame, column: str = "response") -> DataFrame:
    """Candidate JSON of each response: ``json_text``, how it was found, and whether it parses.

    Outcome is fenced, markdown, plain, closed (a missing brace was added), empty or invalid;
    an invalid text is kept as it is.
    """
    rows = responses.withColumn("_t", strip_text(F.col(column)))
    rows = rows.withColumn("_f", _inside_fence(F.col("_t")))
    fenced = F.col("_f") != F.col("_t")
    fields = [F.when(F.lit(n == "keywords"), F.lit(None).cast("string")).otherwise(_markdown_field(F.col("_t"), r, e)).alias(n)
              for n, r, e in FIELD_HEADINGS]
    words = _markdown_field(F.col("_t"), *FIELD_HEADINGS[2][1:])
    as_json = F.to_json(
        F.struct(
            F.coalesce(fields[0], F.lit(NO_DESCRIPTION)).alias("description"), fields[1],
            F.when(words.isNotNull(), _keyword_list(words)).alias("keywords"), fields[3], fields[4],
            F.lit(DEFAULT_CONFIDENCE).alias("confidence"), F.lit(False).alias("scene_change"),
            F.lit(FROM_MARKDOWN).alias("new_information"),
        )
    )
    structured = ~fenced & is_structured(F.col("_t"))
    rows = rows.withColumn("_s", structured)
    rows = rows.withColumn("_c", _clean(F.when(F.col("_s"), as_json).otherwise(F.col("_f"))))
    valid = F.try_parse_json("_c").isNotNull()
    closed = F.concat(F.col("_c"), F.lit("}"))
    closable = F.col("_c").startswith("{") & ~F.col("_c").endswith("}")
    how = (
        F.when(F.col("_c") == "", "empty")
        .when(valid, F.when(fenced, "fenced").when(F.col("_s"), "markdown").otherwise("plain"))
        .when(closable & F.try_parse_json(closed).isNotNull(), "closed")
        .otherwise("invalid")
    )
    rows = rows.withColumn("outcome", how)
    return rows.withColumn(
        "json_text",
        F.when(F.col("outcome") == "empty", "{}").when(F.col("outcome") == "closed", closed).otherwise(F.col("_c")),
    ).drop("_t", "_f", "_s", "_c")


def outcome_counts(repaired: DataFrame) -> DataFrame:
    return repaired.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def repair_fields(rows: DataFrame, column: str = "json_text") -> DataFrame:
    """Analysis struct with misspelt names moved, defaults set and keywords as a list."""
    v = F.try_parse_json(F.col(column))

    def text(path: str) -> Column:
        return F.try_variant_get(F.col("_v"), f"$.{path}", "string")

    keywords = F.coalesce(
        F.try_variant_get(F.col("_v"), "$.keywords", "array<string>"),
        F.when(F.schema_of_variant(F.try_variant_get(F.col("_v"), "$.keywords", "variant")) == "STRING", F.array(text("keywords"))),
        F.when(F.try_variant_get(F.col("_v"), "$.keywords", "variant").isNotNull(), F.array().cast("array<string>")),
    )
    fixed = F.struct(
        F.coalesce(text("description"), F.lit(NO_DESCRIPTION)).alias("description"),
        text("dialogue_translation").alias("dialogue_translation"),
        keywords.alias("keywords"),
        text("search_terms").alias("search_terms"),
        text("content_type").alias("content_type"),
        text("mood_atmosphere").alias("mood_atmosphere"),
        F.coalesce(text("scene_change"), text("mchange")).alias("scene_change"),
        F.coalesce(text("new_information"), text("information")).alias("new_information"),
        F.coalesce(text("confidence"), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
    )
    return rows.withColumn("_v", v).withColumn("analysis", F.when(F.col("_v").isNotNull(), fixed)).drop("_v")


def quality_flags(
    segments: DataFrame, response: str = "response", analysis: str = "analysis", max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Flags of degraded answers per segment, in a fixed order, and whether one is critical.

    The repeat test looks at the preceding segment of the same media.
    """
    large = has_large_group(segments, ["media"], max_rows)
    a = F.col(analysis)
    said = F.coalesce(a["description"], F.lit(""))
    confidence = F.lower(F.coalesce(a["confidence"], F.lit("")))
    words = a["keywords"]
    n = F.size(words)
    # Four equal neighbours, seen as a repeated group in the joined list.
    joined = F.array_join(words, "\x1f", "\x1e")
    run = (n > 5) & joined.rlike(r"(?:^|\x1f)([^\x1f]*)\x1f\1\x1f\1\x1f\1(?:\x1f|$)")
    terms = a["search_terms"]
    pieces = F.filter(F.split(strip_text(terms), r"\s+"), lambda x: x != "")
    tests = [
        ("chinese_characters", F.col(response).rlike("[一-鿿]")),
        ("short_description", F.length(said) < 20),
        ("empty_required_fields", (strip_text(said) == "") | (strip_text(confidence) == "")),
        ("invalid_confidence", (confidence != "") & ~confidence.isin(CONFIDENCES)),
        ("keyword_loop", run),
        ("keyword_flood", (n > 10) & (F.size(F.array_distinct(words)) / n < 0.3)),
        (
            "search_terms_loop",
            (F.length(terms) > 100) & (F.size(pieces) > 10)
            & (F.size(F.array_distinct(pieces)) / F.size(pieces) < 0.3),
        ),
    ]
    # All tests but that of the neighbour run before rows meet, so texts travel only where the caller asks for them.
    rows = segments.withColumn("_f", F.array(*[F.when(cond, F.lit(name)) for name, cond in tests]))
    rows = rows.withColumn("_d", F.when(said != "", text_hash(said)))
    rows = with_previous(rows, ["media"], ["segment_index"], ["_d"], max_rows=max_rows, large=large)
    repeat = F.array(F.when(F.col("prev__d") == F.col("_d"), F.lit("duplicate_description")))
    flags = F.concat(F.slice("_f", 1, 2), repeat, F.slice("_f", 3, len(tests)))
    rows = rows.withColumn("flags", F.filter(flags, lambda x: x.isNotNull())).drop("_f", "_d", "prev__d")
    critical = F.arrays_overlap("flags", F.array(*[F.lit(f) for f in CRITICAL_FLAGS]))
    return rows.withColumn("degraded", F.size("flags") > 0).withColumn("critical", critical)


def search_documents(segments: DataFrame, analysis: str = "analysis") -> DataFrame:
    """Searchable segment rows: the joined text and the stored, shortened fields.

    ``analysis`` is a JSON text or an already parsed struct.  Segments with an empty text are
    dropped.
    """
    rows = segments
    if dict(rows.dtypes)[analysis] == "string":
        rows = rows.withColumn(analysis, F.from_json(analysis, ANALYSIS))
    a = F.col(analysis)

    def blank(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    def cut(c: Column, n: int) -> Column:
        return F.nullif(F.substring(c, 1, n), F.lit(""))

    keywords = F.array_join(F.coalesce(a["keywords"], F.array().cast("array<string>")), " ")
    text = strip_text(F.concat_ws(" ", blank(a["description"]), blank(a["dialogue_translation"]), keywords))
    return (
        rows.withColumn("document", text)
        .filter("document <> ''")
        .select(
            F.concat_ws("_seg_", F.col("media").cast("string"), F.col("segment_index").cast("string")).alias("id"),
            "media", "segment_index", "start_time", "end_time", "duration", "document",
            cut(a["description"], 500).alias("description"),
            cut(keywords, 200).alias("keywords"),
            F.coalesce(cut(a["confidence"], 20), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
            F.substring(blank(a["content_type"]), 1, 50).alias("content_type"),
            cut(a["search_terms"], 500).alias("search_terms"),
        )
    )


def parse_quality(segments: DataFrame, analysis: str = "analysis") -> DataFrame:
    """Per media: segments, analyses that parse, those that do not or are a stored fallback, and shares."""
    parsed = F.from_json(analysis, "description string")
    is_object = F.try_parse_json(analysis).isNotNull()
    fallback = F.coalesce(parsed["description"] == FALLBACK_DESCRIPTION, F.lit(False))
    has = F.col(analysis).isNotNull()
    counted = segments.groupBy("media").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(has & is_object & ~fallback).alias("parsed"),
        F.count_if(has & (~is_object | fallback)).alias("fallback"),
    )
    share = lambda c: F.round(100.0 * F.col(c) / F.col("total"), 6)
    return counted.withColumns(
        {
            "parsed_pct": share("parsed"), "fallback_pct": share("fallback"),
            "kept_pct": F.round(100.0 * (F.col("parsed") + F.col("fallback")) / F.col("total"), 6),
        }
    )
