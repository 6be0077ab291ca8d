"""Quality rules as a short-circuit cascade.

Every rule is a metric of the text and a range in which a document fails. On a sample spread over the table the cascade
times each metric and learns which rules reject which rows, then orders the rules: again and again the one comes next
that rejects the most of what is left, per second that its metric takes. A document that one rule rejects isn't measured
by the later ones. Rules on metrics that are wanted of every document cost nothing more and come first. The order changes
the work, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, stored, text_or_empty

#: The metrics, as SQL over _text. Those of later steps use the columns of earlier ones.
_WORDS = f"filter(split(_text, '{SPACE}+'), x -> x <> '')".replace("\\", "\\\\")
_COUNT = f"cast(regexp_count(_text, '{WORD}') as bigint)".replace("\\", "\\\\")
_WORD_CHARS = f"cast(char_length(_text) - regexp_count(_text, '{SPACE}') as bigint)".replace("\\", "\\\\")
_SYMBOLS = "cast(regexp_count(_text, '[#*$%&|<>]') as bigint)"
_LINES = f"filter(split(_text, '\\n', -1), x -> x rlike '{WORD}')".replace("\\", "\\\\")


def with_repeat_words(df: DataFrame, out: str, on: Column | None = None) -> DataFrame:
    """Words that lie in a 3-word window found twice or more in the text, where on holds (else null).

    Windows become 64-bit numbers: hash bits above, position below, so one sort of primitives brings equal windows
    together; the words themselves then confirm each pair. The work is that of a sort of the text's own windows.
    """
    words = F.expr(_WORDS)
    # What isn't deterministic keeps the optimizer from moving the split into the lambdas below, should a filter follow.
    df = df.withColumn("_w", F.when((F.spark_partition_id() >= 0) & (F.lit(True) if on is None else on), words))
    df = df.withColumn("_bits", F.expr("cast(coalesce(ceil(log2(size(_w) + 1)), 1) as int)"))
    df = df.withColumn("_s", F.expr("case when size(_w) > 3 then sort_array(transform(sequence(0, size(_w) - 3), i -> shiftleft(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)), _bits) | cast(i as bigint))) end"))
    same = "shiftrightunsigned(a, _bits) = shiftrightunsigned(b, _bits)"
    df = df.withColumn("_p", F.expr(f"filter(zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1), (a, b) -> case when {same} then struct(cast(a & (shiftleft(1L, _bits) - 1) as int) as p, cast(b & (shiftleft(1L, _bits) - 1) as int) as q) end), x -> x is not null)"))
    equal = " and ".join(f"get(_w, x.p + {k}) = get(_w, x.q + {k})" for k in range(3))
    df = df.withColumn("_p", F.expr(f"case when size(_p) > 0 then filter(_p, x -> {equal}) end"))
    df = df.withColumn("_p", F.expr("case when size(_p) > 0 then sort_array(array_distinct(concat(transform(_p, x -> x.p), transform(_p, x -> x.q)))) end"))
    covered = F.expr("cast(coalesce(aggregate(zip_with(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1), (a, b) -> least(b - a, 3)), 3, (n, x) -> n + x), 0) as bigint)")
    return df.withColumn(out, covered if on is None else F.when(on, covered)).drop("_w", "_bits", "_s", "_p")


@dataclass(frozen=True)
class QualityRule:
    """fails: SQL over the metrics; metric: the one that it needs beyond n_words."""

    name: str
    metric: str
    fails: str


#: The production rules. The first two are the base; the others reject only what no prose comes near.
RULES = (
    QualityRule("few_words", "n_words", "n_words < 50"),
    QualityRule("repetition", "n_repeat_words", "100 * n_repeat_words > 50 * n_words"),
    QualityRule("word_length", "word_chars", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    QualityRule("symbols", "n_symbols", "2 * n_symbols > n_words"),
    QualityRule("few_letters", "n_letter_words", "10 * n_letter_words < 7 * n_words"),
    QualityRule("ellipses", "n_ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
    QualityRule("bullets", "n_bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    QualityRule("repeated_lines", "n_dup_lines", "10 * n_dup_lines > 3 * n_lines"),
)
BASE = ("few_words", "repetition")
#: The metrics that op7 wants of every document.
WANTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows of the sample, about; how often each metric is timed.
SAMPLE_ROWS, TIMED = 1_000, 2

_LETTERS = rf"cast(regexp_count(_text, '(?<!{WORD[:-1]})[^\x20\x09-\x0D\p{{L}}]*+\p{{L}}') as bigint)".replace("\\", "\\\\")
_ENDINGS = rf"cast(size(filter(_lines, x -> x rlike '(?:\.\.\.|…){SPACE}*\z')) as bigint)".replace("\\", "\\\\")
_BULLETS = rf"cast(size(filter(_lines, x -> x rlike '^{SPACE}*[-*•]')) as bigint)".replace("\\", "\\\\")
_NEEDS_LINES = {"n_ellipsis_lines": _ENDINGS, "n_bullet_lines": _BULLETS}


def add_metric(df: DataFrame, name: str, on: Column | None = None) -> DataFrame:
    """df with a metric of _text, where on holds (else null); line metrics bring n_lines with them."""
    if name in df.columns:
        return df
    where = lambda x: x if on is None else F.when(on, x)
    if name == "n_repeat_words":
        return with_repeat_words(df, name, on)
    if name == "n_dup_lines" or name in _NEEDS_LINES:
        df = df.withColumn("_lines", where(F.expr(_LINES)))
        value = F.expr(_NEEDS_LINES[name]) if name in _NEEDS_LINES else (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
        found = {name: where(value)} | ({} if "n_lines" in df.columns else {"n_lines": where(F.size("_lines").cast("long"))})
        return df.withColumns(found).drop("_lines")
    value = {"n_words": _COUNT, "word_chars": _WORD_CHARS, "n_symbols": _SYMBOLS, "n_letter_words": _LETTERS}[name]
    return df.withColumn(name, where(F.expr(value)))


def order_rules(docs: DataFrame, rules: tuple[QualityRule, ...] = RULES, text_col: str = "text", wanted: tuple[str, ...] = ("n_words",), sample_rows: int = SAMPLE_ROWS) -> list[QualityRule]:
    """The rules in the order in which they reject the most of what is left per second, on a sample of about sample_rows rows of the whole table; ties by their given order.

    What a metric costs is the time of a job that measures it over the sample, less that of one that measures the wanted
    ones alone. What comes to the driver are counts by sets of failed rules.
    """
    total = docs.count()
    sample = stored(docs.select(text_or_empty(text_col).alias("_text")).sample(min(1.0, sample_rows / max(total, 1)), 1), "quality-sample")
    for m in wanted:
        sample = add_metric(sample, m)

    def seconds(df: DataFrame) -> float:
        times = []
        for _ in range(TIMED):
            began = time.perf_counter()
            df.agg(F.bit_xor(F.xxhash64(*[c for c in df.columns if c != "_text"]))).first()
            times.append(time.perf_counter() - began)
        return min(times)

    metrics = dict.fromkeys(r.metric for r in rules if r.metric not in wanted)
    base = seconds(sample) if metrics else 0.0
    cost = {m: max(seconds(add_metric(sample, m)) - base, 1e-3) for m in metrics}
    for m in metrics:
        sample = add_metric(sample, m)
    failed = F.filter(F.array(*[F.when(F.expr(r.fails), i).otherwise(-1) for i, r in enumerate(rules)]), lambda x: x >= 0)
    left = [(set(r["f"]), r["n"]) for r in sample.groupBy(failed.alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()]
    rest, order = list(range(len(rules))), []
    while rest:
        rejected = {i: sum(n for f, n in left if i in f) for i in rest}
        done = {rules[i].metric for i in order}
        price = {i: 0.0 if rules[i].metric in wanted or rules[i].metric in done else cost[rules[i].metric] for i in rest}
        best = max(rest, key=lambda i: (not price[i], rejected[i] / (price[i] or 1.0), -i))
        order.append(best)
        rest.remove(best)
        left = [(f, n) for f, n in left if best not in f]
    return [rules[i] for i in order]


def cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[QualityRule, ...] = RULES, order: list[QualityRule] | None = None, wanted: tuple[str, ...] = ("n_words",)) -> DataFrame:
    """One row per row of docs: id, kept, failed_rule (the first in the cascade's order), and the metrics of the rules.

    Only the wanted metrics are measured of every row; another is null where a rule before its own has rejected the row.
    Null text counts as empty and fails few_words. Ids aren't looked at; repeated rows are judged each. An empty table
    gives no rows; other columns are ignored.
    """
    order = order_rules(docs, rules, text_col, wanted) if order is None else order
    df = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    for m in wanted:
        df = add_metric(df, m)
    df = df.withColumn("failed_rule", F.lit(None).cast("string"))
    for r in order:
        df = add_metric(df, r.metric, F.col("failed_rule").isNull())
        df = df.withColumn("failed_rule", F.coalesce("failed_rule", F.when(F.expr(r.fails), F.lit(r.name))))
    names = dict.fromkeys([*wanted, *(r.metric for r in order)])
    return df.select(F.col("_id").alias(id_col), *names, "failed_rule", F.col("failed_rule").isNull().alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = cascade(spark.read.parquet(f"{sf_dir}/documents.parquet"), wanted=WANTED)
    failed = F.expr(" or ".join(f"({r.fails})" for r in RULES if r.name in BASE))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


SQL = {
    "op7_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines
  FROM d),
win AS (
  SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g, i
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM hit, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
j AS (
  SELECT m.*, coalesce(rep.n, 0) AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words AS base_failed
  FROM m LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_symbols > n_words
            OR 10 * n_letter_words < 7 * n_words OR 10 * n_ellipsis_lines > 3 * n_lines OR 10 * n_bullet_lines > 9 * n_lines
            OR 10 * n_dup_lines > 3 * n_lines) AS kept
FROM j
"""
}
