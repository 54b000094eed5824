"""Time segments: generation, previous context, frame lookup, speech and character chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.functions.clock import whole_second
from mediaops.plans.folds import budget_chunks
from mediaops.plans.slices import MAX_GROUP_ROWS, has_large_group, with_previous
from mediaops.plans.staging import cut_lineage

SEGMENT_SECONDS = 50.0
OVERLAP_SECONDS = 15.0
SPEECH_LIMIT = 40.0
SILENCE_GAP = 3.0
CHUNK_CHARS = 5000


def explode_range(table: DataFrame, count: Column, out: str, block: int = 10_000) -> DataFrame:
    """Rows repeated for 0 .. count-1; the range is opened in two steps, so no array is long."""
    rows = table.withColumn("_n", count.cast("long")).filter("_n > 0")
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block))))
    first = F.col("_b") * block
    last = F.least(first + block - 1, F.col("_n") - 1)
    return rows.withColumn(out, F.explode(F.sequence(first, last))).drop("_n", "_b")


def overlapping_segments(
    media: DataFrame, duration: str = "duration", length: float = SEGMENT_SECONDS, overlap: float = OVERLAP_SECONDS
) -> DataFrame:
    """Segments of ``length`` seconds, each starting ``length - overlap`` after the one before.

    Segments start while the start is before the end of the media; the last ones are cut there.
    """
    hop = length - overlap
    rows = explode_range(media, F.ceil(F.col(duration) / hop), "segment_index")
    start = F.col("segment_index") * F.lit(hop)
    return (
        rows.withColumn("start_time", start)
        .withColumn("end_time", F.least(start + length, F.col(duration)))
        .withColumn("segment_duration", F.col("end_time") - F.col("start_time"))
    )


def previous_context(segments: DataFrame, media: str = "media") -> DataFrame:
    """Description of segment index - 1 when that segment succeeded, else an empty text.

    An equi-join on (media, index) spreads by index, so a long media is no hot spot.
    """
    before = segments.filter("success and description is not null").select(
        media, (F.col("segment_index") + 1).alias("segment_index"), F.col("description").alias("_prev")
    )
    return segments.join(before, [media, "segment_index"], "left").withColumn(
        "context", F.coalesce("_prev", F.lit(""))
    ).drop("_prev")


def frames_in_segments(frames: DataFrame, segments: DataFrame, width: float = SEGMENT_SECONDS) -> DataFrame:
    """Frames joined to every segment of the same media that covers them, both ends included.

    Times are compared by whole seconds of the frame clock.  The range condition becomes an
    equi-join on (media, time bucket): a segment is listed in each bucket it touches and a
    frame in its own one, so rows of a long media spread over its buckets.  Spark takes the size of
    generated segments for that of their media, so the join is told not to broadcast them.
    """
    f = frames.withColumn("sec", whole_second(F.col("t"))).withColumn("_b", F.floor(F.col("sec") / width))
    s = segments.select(
        "media", "segment_index", "start_time", "end_time",
        F.explode(F.sequence(F.floor(F.col("start_time") / width), F.floor(F.col("end_time") / width))).alias("_b"),
    )
    return (
        f.join(s.hint("merge"), ["media", "_b"])
        .filter(F.col("sec").between(F.col("start_time"), F.col("end_time")))
        .drop("_b")
    )


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row: a lambda variable is not computed again."""
    return F.transform(F.array(value), use)[0]


def _repetitive(text: Column) -> Column:
    """More than 5 words and one of them over 70% of all.

    A word above half of a sorted list fills its middle, so only one candidate is counted.
    """

    def test(words: Column) -> Column:
        n = F.size(words)
        middle = F.element_at(F.sort_array(words), F.floor(n / 2).cast("int") + 1)
        return (n > 5) & ((n - F.size(F.array_remove(words, middle))) / n > 0.7)

    return _once(F.split(text, r"\s+"), test)


def strip_text(text: Column) -> Column:
    """All white space removed from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def text_hash(text: Column) -> Column:
    """32 bytes that tell texts apart; null for null."""
    return F.unhex(F.sha2(text, 256))


def clean_repetitive(
    utterances: DataFrame, keys: tuple[str, ...] = ("media",), order: tuple[str, ...] = ("pos",),
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Drop blank texts, texts of one repeated word, and repeats of the text kept just before.

    Dropping an equal neighbour cannot change which text was kept last, so the fold is a
    comparison with the preceding survivor of the first two tests.
    """
    # Filtering only makes keys smaller, so the count is taken before the costly test.
    large = has_large_group(utterances, keys, max_rows)
    text = strip_text(F.col("text"))
    rows = utterances.withColumn("_t", text).filter("_t <> ''").filter(~_repetitive(F.col("_t")))
    # Neighbours are compared by their hash, so a text travels only where the caller asks for it.
    rows = rows.withColumn("_t", text_hash(F.col("_t")))
    seen = with_previous(rows, keys, order, ["_t"], max_rows=max_rows, large=large)
    return seen.filter(F.col("prev__t").isNull() | (F.col("prev__t") != F.col("_t"))).drop("_t", "prev__t")


def character_chunks(
    utterances: DataFrame, keys: tuple[str, ...] = ("media",), order: tuple[str, ...] = ("pos",),
    limit: int = CHUNK_CHARS, max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Greedy chunks of whole utterances with at most ``limit`` characters; a longer one stands alone."""
    from mediaops.plans.slices import running_sum

    size = F.length("text").cast("long")
    large = has_large_group(utterances, keys, max_rows)
    rows = running_sum(utterances, keys, order, size, "_reach", max_rows, large)
    rows = rows.withColumn("_enter", F.col("_reach") - size)
    return budget_chunks(rows, keys, order, "_enter", "_reach", float(limit), max_rows, large).drop(
        "_enter", "_reach", "chunk_enter", "opens", "left_enter"
    )


def _silence_rows(rows: DataFrame, start: Column, end: Column, back: float) -> DataFrame:
    """Silence from start to end, cut into pieces of the speech limit that overlap by ``back``."""
    hop = SPEECH_LIMIT - back
    span = end - start
    pieces = F.when(span > SPEECH_LIMIT, F.ceil((span - SPEECH_LIMIT) / hop) + 1).otherwise(F.lit(1))
    placed = rows.select("media", start.alias("_s"), end.alias("_e"), pieces.alias("_p")).filter("_e > _s")
    placed = explode_range(placed, F.col("_p"), "_i").withColumn("start_time", F.col("_s") + F.col("_i") * hop)
    return placed.select(
        "media", "start_time", F.least(F.col("start_time") + SPEECH_LIMIT, F.col("_e")).alias("end_time"),
        F.lit("silence").alias("kind"), F.lit(None).cast("string").alias("text"),
    )


def speech_segments(utterances: DataFrame, media: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Speech and silence rows of each media from its utterances (media, pos, start, end, text).

    Utterances are merged while they end within 40 s of the segment start; a longer one is
    kept whole.  A gap of more than 3 s before the next utterance is taken into the segment
    when that utterance still starts within the limit, otherwise every gap becomes silence
    rows.  Silence is cut at 40 s with a 10 s overlap (5 s before the first utterance) and the
    cutting ends where the silence ends.  Media without utterances get plain 40 s rows.

    Where a segment starts depends only on its first utterance, so the packing is a budget
    chain, which also works for a media of any length.
    """
    order = ("start", "pos")
    large = has_large_group(utterances, ["media"], max_rows)
    rows = with_previous(utterances, ["media"], order, ["end"], max_rows=max_rows, large=large)
    first = F.col("prev_end").isNull()
    enter = F.when(first & (F.col("start") <= SPEECH_LIMIT), 0.0).when(first, F.col("start")).otherwise(
        F.greatest("prev_end", "start")
    )
    rows = rows.withColumn("enter", enter)
    # Stored once: five kinds of rows are read from it.
    packed = cut_lineage(budget_chunks(rows, ["media"], order, "enter", "end", SPEECH_LIMIT, max_rows, large))

    gap = F.col("start") - F.col("prev_end")
    taken = F.col("opens") & ~first & (gap > SILENCE_GAP) & (F.col("start") - F.col("left_enter") <= SPEECH_LIMIT)
    closed_at = F.when(taken, F.col("start")).otherwise(F.col("prev_end"))
    # Every utterance adds to its own segment; an opening one may also lengthen the one before.
    own = F.struct(
        F.col("chunk"), F.col("chunk_enter").alias("s"), F.col("end").alias("e"),
        F.struct(*order).alias("at"), F.col("text"), F.lit(None).cast("double").alias("longer"),
    )
    other = F.struct(
        (F.col("chunk") - 1).alias("chunk"), F.col("left_enter").alias("s"), F.lit(None).cast("double").alias("e"),
        F.lit(None).cast(f"struct<start:double,pos:{dict(utterances.dtypes)['pos']}>").alias("at"),
        F.lit(None).cast("string").alias("text"), F.col("start").alias("longer"),
    )
    parts = packed.select("media", F.explode(F.filter(F.array(own, F.when(taken, other)), lambda x: x.isNotNull())).alias("p"))
    said = F.when(F.col("p.at").isNotNull(), F.struct(F.col("p.at").alias("at"), F.col("p.text").alias("text")))
    speech = (
        parts.groupBy("media", F.col("p.chunk").alias("chunk"))
        .agg(
            F.max("p.s").alias("start_time"),
            F.coalesce(F.max("p.longer"), F.max_by("p.e", "p.at")).alias("end_time"),
            F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["text"]), " ").alias("text"),
        )
        .select("media", "start_time", "end_time", F.lit("speech").alias("kind"), "text")
    )
    leading = _silence_rows(
        packed.filter(first & (F.col("start") > SPEECH_LIMIT)), F.lit(0.0), F.col("start"), back=5.0
    )
    between = _silence_rows(packed.filter(F.col("opens") & ~first), closed_at, F.col("start"), back=10.0)
    last = packed.groupBy("media").agg(F.max_by("end", F.struct(*order)).alias("last_end"))
    tail = media.join(last, "media", "left").select(
        "media", F.col("last_end").alias("start_time"), F.col("duration").alias("end_time"),
        F.lit("silence").alias("kind"), F.lit(None).cast("string").alias("text"),
    )
    plain = _silence_rows(tail.filter("start_time is null"), F.lit(0.0), F.col("end_time"), back=0.0)
    tail = tail.filter("start_time is not null and start_time < end_time")
    out = speech.unionByName(leading).unionByName(between).unionByName(tail).unionByName(plain)
    return out.withColumn("duration", F.col("end_time") - F.col("start_time")).withColumn(
        "has_speech", F.col("kind") == "speech"
    )
