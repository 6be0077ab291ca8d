"""Writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(results: DataFrame) -> DataFrame:
    """One column, json, with a row's whole payload."""
    return results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("json"))


#: The sign of each band.
SIGNS = {"clean": ".", "light": "*", "moderate": "!", "heavy": "!!", "saturated": "!!!"}


def summary_line(label: str, counts: bool = False) -> Column:
    """label: score/100 [band] (n words) and the band's sign; with counts also the counters that aren't zero."""
    sign = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair]), F.col("band")), F.lit("?"))
    line = F.format_string("%s: %d/100 [%s] (%d words) %s", label, "score", "band", "word_count", sign)
    hits = F.filter(F.map_entries("counts"), lambda e: e["value"] != 0)
    shown = F.array_join(F.transform(hits, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return F.concat(line, F.when(F.size(hits) > 0, F.concat(F.lit("  ("), shown, F.lit(")"))).otherwise("")) if counts else line


def listing(results: DataFrame, label: str) -> DataFrame:
    """One row per violation."""
    return results.select(label, F.explode("violations").alias("v")).select(label, "v.rule", "v.match", "v.context", "v.penalty", "v.start", "v.end")


def any_below(results: DataFrame, threshold: int) -> bool:
    """Whether some score is below the threshold; stops at the first."""
    return not results.where(F.col("score") < threshold).limit(1).isEmpty()


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one record per row: summaries and timings."""
    df.coalesce(1).write.mode("overwrite").json(path)
