"""Detection boxes: geometry jobs, primary object, token pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.functions import boxes as G


def box_geometry(detections: DataFrame, frames: DataFrame, expand: int = 20, pad: float = 0.25) -> DataFrame:
    """Derived boxes of each detection (x, y, w, h) inside its frame (width, height).

    Corners, integer centre, the box grown for reading (half as much vertically), the padded
    crop window, and whether the box has the shape of a code plate.
    """
    rows = detections.join(frames.select("media", "width", "height"), "media")
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    width, height = F.col("width"), F.col("height")
    ex = G.window(x, y, w, h, F.lit(expand), F.lit(expand // 2), width, height)
    cr = G.window(x, y, w, h, G.to_zero(w * pad), G.to_zero(h * pad), width, height)
    aspect = F.when(h > 0, w / h).otherwise(0.0)
    area = w * h
    plate_like = (
        (aspect > 2.0) & (aspect < 6.0)
        & (area > width * height * 0.01) & (area < width * height * 0.3)
        & (y > height * 0.4)
    )
    return rows.select(
        "id", "media", "x", "y", (x + w).alias("x2"), (y + h).alias("y2"),
        G.centre(x, x + w).alias("cx"), G.centre(y, y + h).alias("cy"),
        ex[0].alias("exp_x"), ex[1].alias("exp_y"), (ex[2] - ex[0]).alias("exp_w"), (ex[3] - ex[1]).alias("exp_h"),
        cr[0].alias("crop_x1"), cr[1].alias("crop_y1"), cr[2].alias("crop_x2"), cr[3].alias("crop_y2"),
        plate_like.alias("plate_like"),
    )


def primary_object(detections: DataFrame, keys: list[str], frame_width: float = 1280.0, order: str = "pos") -> DataFrame:
    """The object of each frame with the largest centred area; the first one on ties.

    Score is area * (1 - 0.3 * offset), offset being the distance of the box centre from the
    frame centre in half widths.  Frames without a positive score give no row.  A max_by
    combines before the shuffle, so a frame with very many boxes is no hot spot.
    """
    half = frame_width / 2
    offset = F.abs(F.col("x") + F.col("w") / 2 - half) / half
    scored = detections.withColumn("score", F.col("w") * F.col("h") * (1 - offset * 0.3)).filter("score > 0")
    best = F.struct(F.col("score"), -F.col(order))
    value = F.struct(*[c for c in detections.columns if c not in keys], "score")
    return scored.groupBy(*keys).agg(F.max_by(value, best).alias("_b")).select(*keys, "_b.*")


def with_bounds(tokens: DataFrame) -> DataFrame:
    """Box edges of a polygon given as an array of [x, y] points; null for a missing polygon."""
    xs = F.transform("polygon", lambda p: p[0])
    ys = F.transform("polygon", lambda p: p[1])
    return tokens.withColumns(
        {
            "left": F.array_min(xs), "top": F.array_min(ys),
            "right": F.array_max(xs), "bottom": F.array_max(ys),
        }
    )


def _edges(prefix: str) -> dict:
    return {e: F.col(f"{prefix}{e}") for e in ("left", "top", "right", "bottom")}


def token_pairs(tokens: DataFrame, crop: str = "crop_id") -> DataFrame:
    """Ordered token pairs of one crop where the first is above, or directly left of, the second.

    Every crop, whatever its number of tokens.  Tokens of a crop are gathered in an array, the
    texts read off one small picture, and its relations come as rows.
    ``tokens`` has crop, pos, left, top, right, bottom.
    """
    item = F.struct("pos", "left", "top", "right", "bottom")
    items = tokens.groupBy(crop).agg(F.sort_array(F.collect_list(item)).alias("items")).filter(F.size("items") > 1)
    pairs = items.select(crop, F.explode("items").alias("a"), "items").select(crop, "a", F.explode("items").alias("b"))
    a, b = _edges("a."), _edges("b.")
    return (
        pairs.filter("a.pos <> b.pos")
        .select(
            crop, F.col("a.pos").alias("first_pos"), F.col("b.pos").alias("second_pos"),
            G.is_above(a, b).alias("above"), G.is_beside(a, b).alias("beside"),
        )
        .filter("above or beside")
    )
