"""Corpus reports over scored documents: all of them aggregations that shuffle counts, not texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analysis import BANDS


def scored_only(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose score (and further columns) isn't null."""
    return df.na.drop(subset=["score", *cols])


def band_counts(scored: DataFrame) -> DataFrame:
    """band, n for all bands, those without documents too."""
    ones = [F.count_if(F.col("band") == b).alias(b) for b, _ in BANDS]
    row = scored_only(scored).agg(*ones)
    return row.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("n")) for b, _ in BANDS])).alias("x")).select("x.*")


def histogram(scored: DataFrame, bins: int = 50, top: float = 100.0) -> DataFrame:
    """bin_start, bin_end, n over equal bins from 0 to top; bins without documents have zero."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("score") / F.lit(top) * F.lit(bins)))).cast("int")
    counted = scored_only(scored).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = top / bins
    return grid.join(counted, "bin", "left").select((F.col("bin") * F.lit(width)).alias("bin_start"), ((F.col("bin") + 1) * F.lit(width)).alias("bin_end"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def summary(scored: DataFrame, value: str = "score") -> DataFrame:
    """One row: n, mean, median, min, max and quantiles with linear interpolation, rounded to three places."""
    q = lambda p: F.percentile(value, F.lit(p))
    r = lambda x: F.round(x, 3)
    return scored_only(scored).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(value)).alias("mean"), r(q(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
        r(q(0.1)).alias("p10"), r(q(0.25)).alias("p25"), r(q(0.75)).alias("p75"), r(q(0.9)).alias("p90"),
    )


def regression(scored: DataFrame, x: str = "word_count", y: str = "score") -> DataFrame:
    """One row: n, slope, intercept, correlation. One row or a constant x: slope 0, intercept mean, correlation null."""
    flat = (F.count(F.lit(1)) <= 1) | (F.min(x) == F.max(x))
    return scored_only(scored, x).agg(
        F.count(F.lit(1)).alias("n"), F.when(flat, F.lit(0.0)).otherwise(F.regr_slope(y, x)).alias("slope"), F.when(flat, F.avg(y)).otherwise(F.regr_intercept(y, x)).alias("intercept"),
        F.when(flat | (F.min(y) == F.max(y)), F.lit(None).cast("double")).otherwise(F.corr(x, y)).alias("correlation"),
    )


def samples(scored: DataFrame, id_col: str, first: int) -> DataFrame:
    """The first rows by id, with a number from 1 on: a top-k, so nothing but those rows is sorted in one place."""
    top = scored_only(scored).orderBy(id_col).limit(first)
    return top.select(F.row_number().over(Window.orderBy(id_col)).alias("index"), id_col, "score", "word_count", "band")


def mean_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"))


def slowest_at_longest(df: DataFrame, key: str, at: str, value: str, first: int) -> DataFrame:
    """Of the rows with the greatest `at`, the groups with the greatest mean value; ties by key."""
    longest = df.agg(F.max(at).alias("_top"))  # one row
    return df.join(F.broadcast(longest), F.col(at) == F.col("_top")).groupBy(key).agg(F.avg(value).alias(f"mean_{value}")).orderBy(F.desc(f"mean_{value}"), key).limit(first)


def non_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: kept, dropped."""
    return df.agg(F.count(text_col).alias("kept"), F.count_if(F.col(text_col).isNull()).alias("dropped"))


def changed(before: DataFrame, after: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """key, before, after of what differs between two key-value tables; a missing side is null."""
    a, b = before.select(F.col(key), F.col(value).alias("before")), after.select(F.col(key), F.col(value).alias("after"))
    return a.join(b, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))
