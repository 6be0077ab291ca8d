"""The analysis of a text column as one plan: views, rules, counters, score, and on demand violations and advice."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact_round
from ..functions.views import VIEWS, held, materialise
from ..operators.rules import VIOLATION, CappedRule, PhraseReuse, Rule, default_rules
from .phrases import reuse_column
from .resolve import resolve_spans

#: Band names with their least scores, best first.
BANDS = (("clean", 80), ("light", 60), ("moderate", 40), ("heavy", 20), ("saturated", 0))


@dataclass(frozen=True)
class Hyperparameters:
    short_text_word_count: int = 10
    density_words_basis: float = 1000.0
    context_window_chars: int = 60
    concentration_alpha: float = 2.5
    amplified: tuple[str, ...] = ("contrast_pairs", "pithy_fragment", "setup_resolution")
    decay_lambda: float = 0.04
    score_min: int = 0
    score_max: int = 100
    bands: tuple[tuple[str, int], ...] = BANDS


DEFAULT_HYPERPARAMETERS = Hyperparameters()


def prepared(df: DataFrame, text_col: str, rules: list[Rule], extra: set[str] = frozenset()) -> DataFrame:
    """df with the views that the rules read."""
    reuse = [r for r in rules if isinstance(r, PhraseReuse)]
    names = {v for r in rules for v in r.views} | {"v_words", *(["v_ngrams"] if reuse else [])} | set(extra)
    df = materialise(df.withColumn("v_text", F.col(text_col)), names & VIEWS.keys())
    if reuse:
        r = reuse[0]
        df = df.withColumn("v_reuse", reuse_column(F.col("v_ngrams"), r["repeated_ngram_min_n"], r["repeated_ngram_max_n"], r["repeated_ngram_min_count"]))
    return df


def band_of(score: Column, hp: Hyperparameters = DEFAULT_HYPERPARAMETERS) -> Column:
    return reduce(lambda c, b: c.when(score >= b[1], b[0]), hp.bands[1:-1], F.when(score >= hp.bands[0][1], hp.bands[0][0])).otherwise(hp.bands[-1][0])


def score_of(density: Column, hp: Hyperparameters = DEFAULT_HYPERPARAMETERS) -> Column:
    """Rounded half to even, then clamped."""
    return F.greatest(F.lit(hp.score_min), F.least(F.lit(hp.score_max), F.rint(F.lit(float(hp.score_max)) * F.exp(F.lit(-hp.decay_lambda) * density)).cast("int")))


def with_counts(df: DataFrame, rules: list[Rule], hp: Hyperparameters) -> DataFrame:
    """Adds d_0, d_1, ... (what each rule counts), s_0, ... (its absolute penalties), zero in short texts."""
    long = F.col("v_words") >= hp.short_text_word_count
    df = df.withColumns({f"d_{i}": F.when(long, F.coalesce(r.delta(), F.lit(0))).otherwise(0).cast("int") for i, r in enumerate(rules)})
    return df.withColumns({f"s_{i}": F.when(F.col(f"d_{i}") != 0, F.coalesce(r.strength(F.col(f"d_{i}")), F.lit(0))).otherwise(0).cast("int") for i, r in enumerate(rules)})


def count_columns(rules: list[Rule]) -> dict[str, Column]:
    keys: dict[str, Column] = {}
    for i, r in enumerate(rules):
        keys[r.count_key] = keys[r.count_key] + F.col(f"d_{i}") if r.count_key in keys else F.col(f"d_{i}")
    return keys


def weighted_sum(rules: list[Rule], hp: Hyperparameters) -> Column:
    """Penalties, those of some categories amplified by how often the category was hit."""
    counts, total = count_columns(rules), F.lit(0.0)
    for i, r in enumerate(rules):
        w = F.col(f"s_{i}").cast("double")
        key = r.name if r.name in hp.amplified else f"{r.name}s"
        if key in hp.amplified and key in counts:
            c = counts[key]
            w = w * F.when(c > 1, 1 + F.lit(hp.concentration_alpha) * (c - 1)).otherwise(1.0)
        total = total + w
    return total


def score(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, hp: Hyperparameters = DEFAULT_HYPERPARAMETERS, counts: bool = False) -> DataFrame:
    """df with score, band and word_count (and counts, a struct, on demand). Null texts give nulls. No span is built."""
    rules = default_rules() if rules is None else rules
    kept = df.columns
    work = with_counts(prepared(df, text_col, rules), rules, hp)
    work = work.withColumn("_weighted", held(weighted_sum(rules, hp)))
    density = F.when(F.col("v_words") > 0, F.col("_weighted") / (F.col("v_words") / F.lit(hp.density_words_basis))).otherwise(0.0)
    short = F.col("v_words") < hp.short_text_word_count
    work = work.withColumn("score", F.when(F.col("v_text").isNotNull(), F.when(short, F.lit(hp.score_max)).otherwise(score_of(density, hp))))
    out = [*kept, "score", F.when(F.col("score").isNotNull(), band_of(F.col("score"), hp)).alias("band"), F.when(F.col("v_text").isNotNull(), F.col("v_words")).alias("word_count")]
    if counts:
        out.append(F.struct(*[c.alias(k) for k, c in count_columns(rules).items()]).alias("counts"))
    return work.select(*out)


def analyze(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, hp: Hyperparameters = DEFAULT_HYPERPARAMETERS, spans: bool = True) -> DataFrame:
    """df with the whole payload: score, band, word_count, violations, counts (a map), total_penalty, weighted_sum, density, advice.

    Violations carry the place that each is found at. Places depend on those given out before in the same text, so they
    come from an Arrow function, the only one here besides phrase reuse; with spans=False they stay null.
    """
    rules = default_rules() if rules is None else rules
    kept = df.columns
    work = prepared(df, text_col, rules)
    short = (F.col("v_words") < hp.short_text_word_count) | F.col("v_text").isNull()
    # Hits are found once: those that are counted before the counts, others where something was counted.
    hits = {i: h for i, r in enumerate(rules) if (h := r.hits()) is not None}
    rules = [r.reading(f"h_{i}") if i in hits else r for i, r in enumerate(rules)]
    work = work.withColumns({f"h_{i}": held(F.when(~short, h)) for i, h in hits.items() if rules[i].COUNTS_HITS})
    work = with_counts(work, rules, hp)
    work = work.withColumns({f"h_{i}": held(F.when(F.col(f"d_{i}") != 0, h)) for i, h in hits.items() if not rules[i].COUNTS_HITS})
    none, silent = F.array().cast(VIOLATION), F.array().cast("array<string>")
    work = work.withColumns({f"f_{i}": F.when(short | (F.col(f"d_{i}") == 0), none).otherwise(r.found()) for i, r in enumerate(rules)})
    work = work.withColumns({f"a_{i}": F.when(short | (F.col(f"d_{i}") == 0) | (F.size(r.shown()) == 0 if isinstance(r, CappedRule) else F.lit(False)), silent).otherwise(r.advice()) for i, r in enumerate(rules)})
    work = work.withColumns({"_weighted": held(weighted_sum(rules, hp)), "_found": F.concat(*[F.col(f"f_{i}") for i in range(len(rules))])})
    density = F.when(F.col("v_words") > 0, F.col("_weighted") / (F.col("v_words") / F.lit(hp.density_words_basis))).otherwise(0.0)
    work = work.withColumn("_density", F.when(short, F.lit(0.0)).otherwise(density))
    work = work.withColumn("score", F.when(F.col("v_text").isNotNull(), F.when(short, F.lit(hp.score_max)).otherwise(score_of(F.col("_density"), hp))))
    found = resolve_spans(F.col("v_text"), F.col("_found"), hp.context_window_chars) if spans else F.col("_found")
    has = F.col("v_text").isNotNull()
    keys = count_columns(rules)
    return work.select(
        *kept,
        "score",
        F.when(has, band_of(F.col("score"), hp)).alias("band"),
        F.when(has, F.col("v_words")).alias("word_count"),
        F.when(has, found).alias("violations"),
        F.when(has, F.create_map(*[x for k, c in keys.items() for x in (F.lit(k), c)])).alias("counts"),
        F.when(has, F.aggregate("_found", F.lit(0), lambda n, v: n + v["penalty"])).alias("total_penalty"),
        F.when(has, exact_round(F.col("_weighted"), 2)).alias("weighted_sum"),
        F.when(has, exact_round(F.col("_density"), 2)).alias("density"),
        F.when(has, F.array_distinct(F.concat(*[F.col(f"a_{i}") for i in range(len(rules))]))).alias("advice"),
    )


def analyze_text(spark, text: str, rules: list[Rule] | None = None, hp: Hyperparameters = DEFAULT_HYPERPARAMETERS) -> dict:
    """One text; the payload as a dictionary."""
    return analyze(spark.createDataFrame([(text,)], "text string"), "text", rules, hp).drop("text").first().asDict(recursive=True)


def register_view(spark, table: str, view: str, text_col: str = "text", details: bool = False, rules: list[Rule] | None = None) -> None:
    """A temporary view of a table with its scores (or the whole payload), for SQL users."""
    source = spark.table(table)
    (analyze(source, text_col, rules) if details else score(source, text_col, rules, counts=True)).createOrReplaceTempView(view)
