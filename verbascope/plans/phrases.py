"""Repeated word sequences: in-row for scores and streams, relational for corpora."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.views import held, ngram_tokens
from ..operators.lexicons import STOPWORDS
from ..sources.tables import stored

REUSE = "array<struct<phrase:string,count:int,n:int>>"
_STOP = frozenset(STOPWORDS)


def maximal_repeats(tokens: list[str], min_n: int, max_n: int, min_count: int) -> list[tuple[str, int, int]]:
    """(phrase, count, n), longest first, then by count, then as they appear.

    A sequence that is as frequent as a longer one, or one as long before it, whose text holds its text, is left out;
    so are sequences of stop words alone.
    """
    kept: list[tuple[int, int, int, str]] = []
    alive = range(len(tokens))
    for n in range(min_n, max_n + 1):
        at: dict[tuple, list[int]] = {}
        for i in alive:
            if i + n <= len(tokens):
                at.setdefault(tuple(tokens[i : i + n]), []).append(i)
        often = {g: x for g, x in at.items() if len(x) >= min_count}
        kept += [(n, x[0], len(x), " ".join(g)) for g, x in often.items() if not _STOP.issuperset(g)]
        alive = sorted(i for x in often.values() for i in x)
        if not alive:
            break
    kept.sort(key=lambda x: (-x[0], x[1]))
    out = [(p, c, n, i) for k, (n, i, c, p) in enumerate(kept) if not any(o[2] >= c and p in o[3] for o in kept[:k])]
    return [x[:3] for x in sorted(out, key=lambda x: (-x[2], -x[1], x[3]))]


def reuse_column(tokens: Column, min_n: int = 4, max_n: int = 8, min_count: int = 3) -> Column:
    """The maximal repeats of a column of tokens. Only texts with a repeated sequence of min_n words, told by hashes on the JVM, go to Python."""

    @pandas_udf(REUSE)
    def repeats(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"phrase": p, "count": c, "n": n} for p, c, n in maximal_repeats(list(t), min_n, max_n, min_count)])

    return repeats(F.when(may_repeat(tokens, min_n, min_count), tokens))


def may_repeat(tokens: Column, n: int, min_count: int) -> Column:
    hashes = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)]))
    return F.when(F.size(tokens) >= n, F.size(hashes) - F.size(F.array_distinct(hashes)) >= min_count - 1).otherwise(False)


def repeated_phrases(df: DataFrame, id_col: str, text_col: str, min_n: int = 4, max_n: int = 8, min_count: int = 3) -> DataFrame:
    """id, phrase, count, n, rank for each maximal repeat: explode, count, self anti-join, rank.

    A sequence can only repeat where its first min_n words do, so hashes of those leave few places for the longer ones.
    """
    tokens = df.select(F.col(id_col).alias("id"), held(ngram_tokens(F.col(text_col))).alias("t"))
    tokens = stored(tokens, "tokens").where(may_repeat(F.col("t"), min_n, min_count))  # a filter over a stored column can't be rewritten in terms of texts
    hashes = F.transform(F.sequence(F.lit(0), F.size("t") - min_n), lambda i: F.xxhash64(F.array_join(F.slice("t", i + 1, min_n), " ")))
    places = tokens.select("id", F.posexplode(hashes).alias("p", "h"))
    often_at = places.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("id", "h"))).where(F.col("c") >= min_count)
    at = stored(often_at.groupBy("id").agg(F.collect_list("p").alias("at")), "places")  # no more than a text's own words

    def grams_of(n: int) -> Column:
        return F.transform(F.filter("at", lambda p: p + n <= F.size("t")), lambda p: F.struct(F.lit(n).alias("n"), (p + 1).alias("pos"), F.slice("t", p + 1, n).alias("g")))

    grams = tokens.join(at, "id").select("id", F.explode(F.concat(*map(grams_of, range(min_n, max_n + 1)))).alias("x")).select("id", "x.n", "x.pos", "x.g")
    stop = F.array(*map(F.lit, STOPWORDS))
    often = grams.groupBy("id", "n", "g").agg(F.count(F.lit(1)).cast("int").alias("count"), F.min("pos").alias("pos")).where(F.col("count") >= min_count)
    often = often.where(~F.forall("g", lambda w: F.array_contains(stop, w))).select("id", "n", "pos", "count", F.array_join("g", " ").alias("phrase"))
    often = stored(often, "repeats")
    a, b = often.alias("a"), often.alias("b")
    earlier = (F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.pos") < F.col("a.pos")))
    left = a.join(b, (F.col("a.id") == F.col("b.id")) & earlier & (F.col("b.count") >= F.col("a.count")) & F.contains(F.col("b.phrase"), F.col("a.phrase")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), F.desc("count"), "pos"))
    return left.select(F.col("id").alias(id_col), "phrase", "count", "n", rank.alias("rank"))
