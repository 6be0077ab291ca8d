"""Learning rule settings from labelled texts.

One pass computes a narrow table of statistics per document; thresholds, caps and penalties follow from aggregations over
it (exact percentiles, rates and clipped means at candidate values), of which only a few numbers reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.views import word_count
from ..operators import rules as R
from ..sources.tables import stored
from .analysis import DEFAULT_HYPERPARAMETERS, Hyperparameters, prepared

GRID = [i / 20 for i in range(21)]


def clamp(x, low, high):
    if low > high:
        raise ValueError("lower bound above upper bound")
    return max(low, min(high, x))


def blend(default: float, fitted: float, support: int, pivot: float = 12.0) -> float:
    """Nearer to what was fitted, the more values support it."""
    w = support / (support + pivot) if support else 0.0
    return default * (1 - w) + fitted * w


def penalty_by_support(base: int, matched: int, total: int) -> int:
    if total <= 0:
        return base
    size = max(1, round(abs(base) * clamp(1.5 - matched / total, 0.5, 1.75)))
    return -size if base < 0 else size


def fitted_penalty(base: int, pos: tuple[int, int], neg: tuple[int, int]) -> int:
    """(matched, total) of each cohort. A rule that fires no more often in the negatives gets no penalty."""
    own = penalty_by_support(base, *pos)
    if neg[1] <= 0:
        return own
    p, n = pos[0] / pos[1] if pos[1] else 0.0, neg[0] / neg[1]
    if n <= p:
        return 0
    size = max(1, round(abs(own) * clamp(0.75 + 1.75 * (n - p) + 0.5 * neg[1] / (neg[1] + pos[1] + 6.0), 0.5, 2.5)))
    return -size if base < 0 else size


def scaled(config: dict, scale: float) -> dict:
    """The penalties among the settings times scale, of size one at least unless scale is zero."""
    out = dict(config)
    for k, v in config.items():
        if isinstance(v, int) and not isinstance(v, bool) and (k == "penalty" or k.endswith(("_penalty", "_penalty_step"))) or k == "penalty_step":
            size = 0 if scale == 0 or v == 0 else max(1, round(abs(v) * scale))
            out[k] = -size if v < 0 else size
    return out


@dataclass
class Values:
    """A column of values with a column `pos`, for percentiles and rates by cohort. extra: what stands for positives that have no value."""

    df: DataFrame
    default_positive: float | None = None

    def __post_init__(self):
        rows = {r["pos"]: r["n"] for r in self.df.groupBy("pos").agg(F.count("x").alias("n")).collect()}
        self.n = {True: rows.get(True, 0), False: rows.get(False, 0)}
        if not self.n[True] and self.default_positive is not None:
            one = self.df.sparkSession.range(1).select(F.lit(True).alias("pos"), F.lit(float(self.default_positive)).alias("x"))
            self.df, self.n[True] = self.df.unionByName(one), 1

    def percentiles(self, wanted: list[tuple[bool | None, float]]) -> list[float | None]:
        part = lambda c: F.col("x") if c is None else F.when(F.col("pos") == c, F.col("x"))
        return list(self.df.agg(*[F.percentile(part(c), F.lit(q)).alias(f"q{i}") for i, (c, q) in enumerate(wanted)]).first())

    def shares(self, at: list[float], of: Callable[[Column, float], Column]) -> list[tuple[float, float]]:
        """(positives, negatives): mean of `of` at each candidate; zero for an empty cohort."""
        cols = [F.avg(F.when(F.col("pos") == c, of(F.col("x"), t).cast("double"))) for t in at for c in (True, False)]
        got = [v or 0.0 for v in self.df.agg(*[c.alias(f"m{i}") for i, c in enumerate(cols)]).first()]
        return list(zip(got[::2], got[1::2], strict=True))


def threshold(values: Values, default: float, low: float, high: float, q_pos: float, q_neg: float, pivot: float, mode: str) -> float:
    """The candidate that parts the cohorts best; mode is gt or ge for values that are high in negatives, lt or le for low ones."""
    if not values.n[True]:
        return clamp(default, low, high)
    tail = mode[0] == "g"
    base = clamp(default, low, high)
    wanted = [(None, q) for q in GRID] + [(True, q_pos), (True, 0.99 if tail else 0.01)]
    if values.n[False]:
        wanted += [(False, q_neg), (False, 0.01 if tail else 0.99)]
    found = sorted({base, low, high, *(clamp(v, low, high) for v in values.percentiles(wanted) if v is not None)})
    test = {"gt": lambda x, t: x > t, "ge": lambda x, t: x >= t, "lt": lambda x, t: x < t, "le": lambda x, t: x <= t}[mode]
    return clamp(_best(found, values, values.shares(found, test), base, pivot, 0.4, None), low, high)


def _best(found: list, values: Values, rates: list[tuple[float, float]], base: float, pivot: float, cost: float, fires: list[tuple[float, float]] | None) -> float:
    negatives, best, best_key = values.n[False], base, None
    for t, (p, n), (fp, fn) in zip(found, rates, fires or rates, strict=True):
        gap, goal = n - p, -p
        if negatives:
            goal = gap - cost * p + (0.10 if fp <= 0.20 else 0.0) - (0.25 if fn <= fp else 0.0)
        key = (goal, gap, -p, n)
        if best_key is None or key > best_key:
            best, best_key = t, key
    if negatives and best_key[1] <= 0:
        return base
    return blend(base, best, values.n[True] + negatives, pivot)


def cap(values: Values, default: int, low: int, high: int, q_pos: float, q_neg: float, pivot: float, times: float = 2.0) -> int:
    if not values.n[True]:
        return clamp(default, low, high)
    base = clamp(default, low, high)
    wanted = [(None, q) for q in GRID] + [(True, q_pos)] + ([(False, q_neg)] if values.n[False] else [])
    got = values.percentiles(wanted)
    found = {base, low, high, clamp(round(base * times), low, high), *(clamp(round(v), low, high) for v in got[:21]), *(clamp(math.ceil(v), low, high) for v in got[21:])}
    found = sorted(found)
    means, fires = values.shares(found, lambda x, t: F.least(x, F.lit(float(t)))), values.shares(found, lambda x, t: F.least(x, F.lit(float(t))) > 0)
    return clamp(round(_best(found, values, means, base, pivot, 0.25, fires)), low, high)


def _statistics(rules: dict[type, R.Rule]) -> dict[str, Column]:
    """Per document: numbers, or arrays of numbers, that the settings are learned from."""
    r = lambda t: rules.get(t) or t()
    t = F.col(R.TEXT)
    density = lambda n, words: F.when(words > 0, n / words * F.lit(150.0))
    pivots = F.filter("v_sentences", lambda s: F.contains(s, F.lit(",")) & F.regexp_like(s, F.lit(P.PIVOT)))
    return {
        "bold": r(R.Structural).bold(), "bullet_runs": R.runs(F.col("v_bullets"), 1), "triads": r(R.Structural).triads(), "sentences": F.size("v_sentence_words"),
        "cv": F.when((F.size("v_sentence_words") >= 2) & (R._mean(F.col("v_sentence_words")) > 0), R.variation(F.col("v_sentence_words"))), "dashes": density(r(R.EmDash).dashes(), word_count(t)), "contrasts": r(R.ContrastPair).total(),
        "keywords": r(R.KeywordBold).total(), "setups": F.regexp_count(t, F.lit(P.SETUP_A)) + F.regexp_count(t, F.lit(P.SETUP_B)), "colons": r(R.ColonDensity).ratio(), "pivot_words": F.transform(pivots, word_count), "bullets": r(R.BulletDensity).ratio(),
        "quotes": r(R.BlockquoteDensity).quotes(), "bold_runs": R.runs(F.col("v_bold_bullets"), 1), "dividers": r(R.HorizontalRules).dividers(), "repeats": F.transform("v_reuse", lambda h: h["n"]), "repeat_counts": F.transform("v_reuse", lambda h: h["count"]),
        "words": F.when(F.regexp_count("v_masked", F.lit(R.SlopWord.PATTERN)) > 0, 1).otherwise(0),
    }


def fit(df: DataFrame, text_col: str = "text", label_col: str | None = "label", rules: list[R.Rule] | None = None, calibrate: bool = True, hp: Hyperparameters = DEFAULT_HYPERPARAMETERS) -> list[R.Rule]:
    """New rules with learned settings. Labels above zero are positive (texts as they should be); without any, all texts count as positive. Null texts are left out, null labels count as positive."""
    rules = R.default_rules() if rules is None else rules
    if not isinstance(df.schema[text_col].dataType, type(df.sparkSession.range(1).select(F.lit("")).schema[0].dataType)):
        raise TypeError(f"{text_col} must hold strings")
    label = F.coalesce(F.col(label_col), F.lit(1)) if label_col else F.lit(1)
    base = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), (label > 0).alias("pos"))
    if not base.limit(1).count():
        return [type(r)(dict(r.config)) for r in rules]
    if base.where("pos").isEmpty():
        base = base.withColumn("pos", F.lit(True))
    by_type = {type(r): r for r in rules}
    views = {v for t in R.RULE_TYPES for v in t.views if v != "v_reuse"} | {"v_masked"}
    wide = [t() for t in R.RULE_TYPES if t is not R.PhraseReuse] + [R.PhraseReuse({"repeated_ngram_min_n": 2, "repeated_ngram_max_n": 8, "repeated_ngram_min_count": 2})]
    stats = _statistics(by_type)
    hit = {r.rule_type: F.coalesce(r.delta() > 0, F.lit(False)) for r in rules if not isinstance(r, (R.PhraseReuse, R.Tone))}
    tone = by_type.get(R.Tone) or R.Tone()
    hit |= {"tone_phrases": R.phrase_count(F.col("v_lower"), tone.PHRASES) > 0, "tone_openers": tone._pattern_count() > 0}
    table = prepared(base, "text", wide, views)
    table = stored(table.select("pos", *[c.alias(k) for k, c in stats.items()], *[c.alias(f"hit_{k}") for k, c in hit.items()]), "fit-statistics")
    totals = {r["pos"]: r["n"] for r in table.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).collect()}

    def values(name: str, nonzero: bool = False, default: float | None = None) -> Values:
        array = dict(table.dtypes)[name].startswith("array")
        x = F.explode(F.col(name).cast("array<double>")) if array else F.col(name).cast("double")
        one = table.select("pos", x.alias("x")).where("x is not null")
        return Values(one.where("x <> 0") if nonzero else one, default)

    def matches(condition: Column, usable: Column | None = None) -> tuple[tuple[int, int], tuple[int, int]]:
        rows = table if usable is None else table.where(usable)
        got = {r["pos"]: (r["m"], r["n"]) for r in rows.groupBy("pos").agg(F.count_if(condition).alias("m"), F.count(F.lit(1)).alias("n")).collect()}
        return got.get(True, (0, 0)), got.get(False, (0, 0))

    out = []
    for rule in rules:
        c, kind = dict(rule.config), type(rule)
        hi = lambda v, d, lo, up, a, b, p, m: math.ceil(threshold(v, d, lo, up, a, b, p, m))
        condition = F.col(f"hit_{rule.rule_type}") if f"hit_{rule.rule_type}" in table.columns else None
        usable = None
        if kind is R.SlopWord:
            condition = F.col("words") > 0
        elif kind is R.Structural:
            c["bold_header_min"] = hi(values("bold"), c["bold_header_min"], 1, 128, 0.9, 0.1, 18, "ge")
            c["bullet_run_min"] = hi(values("bullet_runs", default=c["bullet_run_min"]), c["bullet_run_min"], 2, 128, 0.9, 0.1, 18, "ge")
            c["triadic_record_cap"] = cap(values("triads", True, c["triadic_record_cap"]), c["triadic_record_cap"], 1, 128, 0.9, 0.75, 18)
            c["triadic_advice_min"] = hi(values("triads"), c["triadic_advice_min"], 1, 128, 0.75, 0.5, 18, "ge")
            for key, name in (("bold_header_penalty", "bold"), ("triadic_penalty", "triads")):
                c[key] = fitted_penalty(c[key], *matches(F.col(name) > 0))
            c["bullet_run_penalty"] = fitted_penalty(c["bullet_run_penalty"], *matches(F.size("bullet_runs") > 0))
            out.append(kind(c))
            continue
        elif kind is R.Tone:
            c["tone_penalty"] = fitted_penalty(c["tone_penalty"], *matches(F.col("hit_tone_phrases")))
            c["sentence_opener_penalty"] = fitted_penalty(c["sentence_opener_penalty"], *matches(F.col("hit_tone_openers")))
            out.append(kind(c))
            continue
        elif kind is R.Rhythm:
            v = values("sentences", True)
            if v.n[True]:
                start = clamp(math.floor(v.percentiles([(True, 0.25)])[0]), 2, 200)
                c["min_sentences"] = hi(v, start, 2, 200, 0.25, 0.75, 28, "ge")
                c["cv_threshold"] = threshold(values("cv"), c["cv_threshold"], 0.05, 2.0, 0.1, 0.9, 20, "lt")
                condition, usable = F.coalesce(F.col("cv") < c["cv_threshold"], F.lit(False)), None
            else:
                out.append(kind(c))
                continue
        elif kind in (R.EmDash, R.ColonDensity, R.BulletDensity):
            name, field, top = {R.EmDash: ("dashes", "density_threshold", 100.0), R.ColonDensity: ("colons", "density_threshold", 100.0), R.BulletDensity: ("bullets", "ratio_threshold", 1.0)}[kind]
            v = values(name)
            if not v.n[True]:
                out.append(kind(c))
                continue
            c[field] = threshold(v, c[field], 0.0, top, 0.9, 0.1, 18, "gt")
            condition, usable = F.col(name) > c[field], F.col(name).isNotNull()
        elif kind in (R.ContrastPair, R.KeywordBold, R.SetupResolution):
            name = {R.ContrastPair: "contrasts", R.KeywordBold: "keywords", R.SetupResolution: "setups"}[kind]
            own = kind is R.KeywordBold
            v = values(name, True, c["record_cap"] if own else None)
            start = c["record_cap"] if own or not v.n[True] else math.ceil(v.percentiles([(True, 0.9)])[0])
            c["record_cap"] = cap(v, start, 1, 64, 0.9, 0.75 if own else 0.9, 18 if own else 20)
            if "advice_min" in c:
                every = values(name)
                start = c["advice_min"] if own else clamp(math.ceil(every.percentiles([(True, 0.75)])[0]), 1, 64)
                c["advice_min"] = hi(every, start, 1, 64, 0.75, 0.25, 18 if own else 16, "ge")
            condition = F.col(name) > 0
        elif kind is R.PithyFragment:
            v = values("pivot_words")
            if not v.n[True]:
                out.append(kind(c))
                continue
            c["max_sentence_words"] = math.floor(threshold(v, c["max_sentence_words"], 2, 64, 0.9, 0.1, 16, "le"))
            short = F.size(F.filter("pivot_words", lambda n: n <= c["max_sentence_words"]))
            counts = table.select("pos", short.cast("double").alias("x")).where("x <> 0")
            c["record_cap"] = cap(Values(counts), c["record_cap"], 1, 64, 0.9, 0.9, 20)
            condition = short > 0
        elif kind is R.BlockquoteDensity:
            v = values("quotes")
            c["min_lines"] = hi(v, c["min_lines"], 1, 128, 0.9, 0.1, 18, "ge")
            middle = math.floor(v.percentiles([(True, 0.5)])[0])
            c["free_lines"] = clamp(round(blend(c["free_lines"], middle, v.n[True], 20)), 0, c["min_lines"] - 1)
            over = table.select("pos", F.greatest(F.lit(0.0), (F.col("quotes") - c["free_lines"]).cast("double")).alias("x"))
            c["cap"] = cap(Values(over), c["cap"], 1, 128, 0.9, 0.75, 18)
            c["penalty_step"] = fitted_penalty(c["penalty_step"], *matches(F.col("quotes") >= c["min_lines"]))
            out.append(kind(c))
            continue
        elif kind is R.BoldBulletRun:
            v = values("bold_runs")
            start = clamp(math.ceil(v.percentiles([(True, 0.9)])[0]), 2, 64) if v.n[True] else c["min_run_length"]
            c["min_run_length"] = hi(values("bold_runs", default=c["min_run_length"]), start, 2, 64, 0.9, 0.1, 16, "ge")
            condition = F.size("bold_runs") > 0
        elif kind is R.HorizontalRules:
            c["min_count"] = hi(values("dividers"), c["min_count"], 1, 64, 0.9, 0.1, 18, "ge")
            condition = F.col("dividers") >= c["min_count"]
        elif kind is R.PhraseReuse:
            v = values("repeats")
            if not v.n[True]:
                out.append(kind(c))
                continue
            low, top = v.percentiles([(True, 0.2), (True, 0.9)])
            c["repeated_ngram_min_n"] = hi(v, clamp(math.floor(low), 2, 12), 2, 12, 0.2, 0.8, 16, "ge")
            least = c["repeated_ngram_min_n"]
            c["repeated_ngram_max_n"] = cap(v, clamp(math.ceil(top), least, 16), least, 16, 0.9, 0.9, 16)
            k = values("repeat_counts")
            c["repeated_ngram_min_count"] = hi(k, clamp(math.ceil(k.percentiles([(True, 0.75)])[0]), 2, 32), 2, 32, 0.75, 0.25, 12, "ge")
            per = Values(table.select("pos", F.size("repeats").cast("double").alias("x")).where("x > 0"))
            c["record_cap"] = cap(per, math.ceil(per.percentiles([(True, 0.9)])[0]) if per.n[True] else c["record_cap"], 1, 128, 0.9, 0.9, 20)
            condition = F.size("repeats") > 0
        c["penalty"] = fitted_penalty(c["penalty"], *matches(condition, usable))
        out.append(kind(c))
    if calibrate and totals.get(True) and totals.get(False):
        out = _calibrated(base, out, hp)
    return out


def _calibrated(base: DataFrame, rules: list[R.Rule], hp: Hyperparameters) -> list[R.Rule]:
    """A rule that weighs no more on the negatives loses its penalties; one that fires as often on the positives, or on most of them, keeps half."""
    work = prepared(base, "text", rules)
    work = work.withColumns({f"d_{i}": F.coalesce(r.delta(), F.lit(0)) for i, r in enumerate(rules)})
    weights = []
    for i, r in enumerate(rules):
        w = F.coalesce(r.strength(F.col(f"d_{i}")), F.lit(0)).cast("double")
        if r.name in hp.amplified or f"{r.name}s" in hp.amplified:
            w = w * F.when(F.col(f"d_{i}") > 1, 1 + F.lit(hp.concentration_alpha) * (F.col(f"d_{i}") - 1)).otherwise(1.0)
        weights.append(w.alias(f"w_{i}"))
    table = stored(work.select("pos", *weights), "fit-weights")
    cols = [f(F.when(F.col("pos") == c, x)).alias(f"{k}{i}{c}") for i in range(len(rules)) for c in (True, False) for k, f, x in (("m", F.avg, F.col(f"w_{i}")), ("f", F.avg, (F.col(f"w_{i}") != 0).cast("double")))]
    got = table.agg(*cols).first()
    out = []
    for i, r in enumerate(rules):
        pm, nm, pf, nf = (got[f"{k}{i}{c}"] for k, c in (("m", True), ("m", False), ("f", True), ("f", False)))
        scale = 0.0 if nm <= pm else 0.5 if nf <= pf or pf > 0.8 else 1.0
        out.append(type(r)(scaled(r.config, scale)))
    return out
