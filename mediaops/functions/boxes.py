"""Box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_zero(c: Column) -> Column:
    """Integer part, rounding toward zero."""
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("long")


def centre(lo: Column, hi: Column) -> Column:
    """Integer middle of an interval."""
    return to_zero((lo + hi) / 2)


def window(x: Column, y: Column, w: Column, h: Column, dx: Column, dy: Column, width: Column, height: Column):
    """Box grown by dx and dy on each side and clamped to the frame: (x1, y1, x2, y2)."""
    zero = F.lit(0)
    return (
        F.greatest(zero, x - dx),
        F.greatest(zero, y - dy),
        F.least(width, x + w + dx),
        F.least(height, y + h + dy),
    )


def is_above(upper: dict[str, Column], lower: dict[str, Column]) -> Column:
    """Upper box ends before the lower one begins, or overlaps it only a little.

    Boxes are dicts with left, top, right, bottom.  A partial overlap counts when the upper
    box starts higher, covers at most 40% of the smaller height and shares at least half of
    the smaller width.
    """
    min_h = F.least(upper["bottom"] - upper["top"], lower["bottom"] - lower["top"])
    min_w = F.least(upper["right"] - upper["left"], lower["right"] - lower["left"])
    shared = F.greatest(
        F.lit(0), F.least(upper["right"], lower["right"]) - F.greatest(upper["left"], lower["left"])
    )
    soft = (
        (upper["top"] < lower["top"])
        & (upper["bottom"] - lower["top"] <= min_h * 0.4)
        & (shared >= min_w * 0.5)
    )
    return (upper["bottom"] < lower["top"]) | soft


def is_beside(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Same line, left box first: edges within 25% of the smaller height, x overlap below 30%."""
    min_h = F.least(left["bottom"] - left["top"], right["bottom"] - right["top"])
    min_w = F.least(left["right"] - left["left"], right["right"] - right["left"])
    overlap = F.least(left["right"], right["right"]) - F.greatest(left["left"], right["left"])
    aligned = (F.abs(left["top"] - right["top"]) < min_h * 0.25) & (
        F.abs(left["bottom"] - right["bottom"]) < min_h * 0.25
    )
    return aligned & (left["left"] < right["left"]) & ((overlap <= 0) | (overlap < min_w * 0.3))
