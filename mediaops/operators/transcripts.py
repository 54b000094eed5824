"""Utterances: normalisation, statistics, rendering for translation and reading it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.functions.clock import hms_floor
from mediaops.operators.segments import strip_text

# Marker texts of lines that could not be matched.
PARSE_FAILED = "[TRANSLATION_PARSE_FAILED]"
MISSING = "[TRANSLATION_MISSING]"
FAILED_PREFIX = "[TRANSLATION_FAILED]"


def normalise_utterances(raw: DataFrame, words: bool = False) -> DataFrame:
    """Trimmed, non-empty utterances with formatted times, duration and word count.

    With ``words`` the nested word array gets formatted times as well.
    """
    rows = raw.withColumn("text", strip_text(F.col("text"))).filter("text <> ''")
    rows = rows.withColumns(
        {
            "start_formatted": hms_floor(F.col("start")),
            "end_formatted": hms_floor(F.col("end")),
            "duration": F.col("end") - F.col("start"),
            "word_count": F.size(F.split("text", r"\s+")),
        }
    )
    if not words:
        return rows
    return rows.withColumn(
        "words",
        F.transform(
            F.coalesce("words", F.array().cast(dict(raw.dtypes)["words"])),
            lambda w: F.struct(
                strip_text(w["word"]).alias("word"), w["start"].alias("start"), w["end"].alias("end"),
                F.coalesce(w["probability"], F.lit(0.0)).alias("probability"),
                hms_floor(w["start"]).alias("start_formatted"), hms_floor(w["end"]).alias("end_formatted"),
            ),
        ),
    )


def utterance_stats(utterances: DataFrame, limit: float = 40.0) -> DataFrame:
    """Per media: covered span, mean / longest / shortest length, rows over a minute and over the limit."""
    length = F.col("end") - F.col("start")
    return utterances.groupBy("media").agg(
        F.count(F.lit(1)).alias("utterances"),
        F.round(F.max("end") - F.min("start"), 6).alias("span"),
        F.round(F.avg(length), 6).alias("avg_length"),
        F.round(F.max(length), 6).alias("max_length"),
        F.round(F.min(length), 6).alias("min_length"),
        F.count_if(length > 60).alias("over_minute"),
        F.count_if(length > limit + 1).alias("over_limit"),
    )


def render_chunks(chunked: DataFrame) -> DataFrame:
    """One text per (media, chunk): a line ``start,end,text,start,end`` per utterance, in order.

    A chunk holds a bounded number of characters, so its text is bounded too.
    """
    line = F.concat_ws(
        ",", F.col("start").cast("string"), F.col("end").cast("string"), "text", "start_formatted", "end_formatted"
    )
    return chunked.groupBy("media", "chunk").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n"
        ).alias("rendered"),
        F.count(F.lit(1)).alias("lines"),
    )


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Fields of translated lines: two numbers, a text that may hold commas, two clock texts.

    Lines with fewer than five fields, or whose first two are no numbers, give nulls.
    """
    rows = lines.withColumn("_p", F.split(line, ","))
    n = F.size("_p")
    number = [strip_text(F.get("_p", i)).try_cast("double") for i in (0, 1)]
    ok = (n >= 5) & number[0].isNotNull() & number[1].isNotNull()
    body = F.array_join(F.slice("_p", 3, F.greatest(n - 4, F.lit(0))), ",")
    text = strip_text(F.regexp_replace(body, r'^"+|"+$', ""))
    return rows.withColumns(
        {
            "ok": ok,
            "start": F.when(ok, number[0]),
            "end": F.when(ok, number[1]),
            "translated": F.when(ok, text),
            "start_formatted": F.when(ok, F.get("_p", n - 2)),
            "end_formatted": F.when(ok, F.get("_p", n - 1)),
        }
    ).drop("_p")


def match_translations(translated: DataFrame, originals: DataFrame) -> DataFrame:
    """Translated chunks matched to their original lines by line number.

    ``translated`` has media, chunk and the answer text; ``originals`` has media, chunk,
    line_no (from 0), text.  Blank lines and failed lines still take a line number.  A line
    that does not parse gives a marker row with the original text.  When fewer rows than
    originals come back, the originals from that count on are added as missing.
    """
    lines = translated.select(
        "media", "chunk", F.posexplode(F.split(strip_text(F.col("answer")), "\n")).alias("line_no", "line")
    ).withColumn("line", strip_text(F.col("line")))
    used = lines.filter((F.col("line") != "") & ~F.col("line").startswith(FAILED_PREFIX))
    parsed = parse_lines(used)
    keys = ["media", "chunk", "line_no"]
    found = parsed.join(originals.select(*keys, F.col("text").alias("original_text")), keys, "left")
    # A line beyond the originals is kept only when it parses.
    rows = found.filter(F.col("ok") | F.col("original_text").isNotNull()).select(
        *keys, "original_text", F.when(F.col("ok"), F.col("translated")).otherwise(PARSE_FAILED).alias("translated_text"),
        "start", "end", "start_formatted", "end_formatted",
    )
    counts = rows.groupBy("media", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    tail = (
        originals.join(counts, ["media", "chunk"], "left")
        .filter(F.col("line_no") >= F.coalesce("_n", F.lit(0)))
        .select(*keys, F.col("text").alias("original_text"), F.lit(MISSING).alias("translated_text"))
    )
    return rows.unionByName(tail, allowMissingColumns=True)
