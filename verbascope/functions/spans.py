"""All matches of a pattern with their places, from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"


def spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, match>> in code points, half-open. The pattern must not match the empty string."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, p, F.lit(0))
    between = F.split(text, p, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        end = at + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end"), x["m"].alias("match")))).alias("out"))

    pairs = F.filter(F.zip_with(found, between, lambda m, g: F.struct(m.alias("m"), g.alias("gap"))), lambda x: x["m"].isNotNull())
    return F.when(F.regexp_like(text, p), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def context(text: Column, start: Column, end: Column, width: int) -> Column:
    """What stands around a span: `width` code points about its middle, on one line, with dots where the text goes on."""
    middle = F.floor((start + end) / 2)
    lo, n = F.greatest(F.lit(0), middle - width // 2), F.length(text)
    hi = F.least(n, middle + width // 2)
    core = F.replace(F.substring(text, (lo + 1).cast("int"), (hi - lo).cast("int")), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(lo > 0, "...").otherwise(""), core, F.when(hi < n, "...").otherwise(""))
