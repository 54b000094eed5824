"""Clock formats for media time in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c < 10, F.concat(F.lit("0"), text)).otherwise(text)


def _hms(total: Column) -> Column:
    hours = F.floor(total / 3600)
    return F.concat_ws(":", _two(hours), _two(F.floor((total - hours * 3600) / 60)), _two(F.pmod(total, F.lit(60))))


def hms_floor(seconds: Column) -> Column:
    """``HH:MM:SS`` of the started second."""
    return _hms(F.floor(seconds))


def whole_second(seconds: Column) -> Column:
    """Nearest second, halves to the even one (the clock used for grouping frames)."""
    return F.bround(seconds, 0).cast("long")


def hms_round(seconds: Column) -> Column:
    """``HH:MM:SS`` of the nearest second, halves to the even one."""
    return _hms(whole_second(seconds))


def minutes_seconds(seconds: Column) -> Column:
    """``MM:SS`` with unbounded minutes."""
    total = F.floor(seconds)
    return F.concat_ws(":", _two(F.floor(total / 60)), _two(F.pmod(total, F.lit(60))))
