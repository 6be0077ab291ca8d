"""Scores over streams: every rule is a function of one row, so the batch plan serves as it is and keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import Rule
from ..plans.analysis import score


def scored_stream(stream: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    return score(stream, text_col, rules)


def bands_over_time(stream: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes", text_col: str = "text") -> DataFrame:
    """window, band, n with a watermark: rows later than `late` are dropped from their window's count."""
    scored = score(stream.withWatermark(time_col, late), text_col)
    return scored.groupBy(F.window(time_col, window), "band").agg(F.count(F.lit(1)).alias("n"))
