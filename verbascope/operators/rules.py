"""The twenty-four rules, as columns over document views.

A rule gives up to four things: `delta`, what it adds to its counter; `strength`, the sum of its absolute penalties;
`found`, an array of violations; and `advice`, an array of strings. The first two come from counting expressions alone,
so a plan that asks only for scores never builds spans. Each is a column of its own: rules that a query doesn't ask for
are pruned. Rules that find places give them as `hits`; a plan may hold those in a column, which `reading` makes the
other parts read instead of finding them again.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.numbers import exact_round
from ..functions.spans import context, spans
from . import lexicons as L

VIOLATION = "array<struct<rule:string,match:string,context:string,penalty:int,start:int,end:int>>"
TEXT = "v_text"


def _none() -> Column:
    return F.array().cast(VIOLATION)


def _no_advice() -> Column:
    return F.array().cast("array<string>")


def violation(rule: str, match, ctx, penalty, start=None, end=None) -> Column:
    as_col = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(as_col(rule, "string").alias("rule"), as_col(match, "string").alias("match"), as_col(ctx, "string").alias("context"), as_col(penalty, "int").alias("penalty"), as_col(start, "int").alias("start"), as_col(end, "int").alias("end"))


def when_some(condition: Column, array: Column, empty: Column) -> Column:
    return F.when(condition, array).otherwise(empty)


def phrase_count(lower: Column, phrases: tuple[str, ...]) -> Column:
    """Occurrences of all phrases, each by itself and without overlaps."""
    held = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(lower, p))
    return F.aggregate(held, F.lit(0), lambda n, p: n + ((F.length(lower) - F.length(F.replace(lower, p, F.lit("")))) / F.length(p)).cast("int"))


def phrase_hits(text: Column, lower: Column, phrases: tuple[str, ...]) -> Column:
    """Spans, phrase by phrase."""
    held = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(lower, p))
    return F.flatten(F.transform(held, lambda p: F.transform(spans(text, F.concat(F.lit(r"(?iu)\Q"), p, F.lit(r"\E"))), lambda h: F.struct(h["start"], h["end"], F.lower(h["match"]).alias("match")))))


def runs(flags: Column, least: int) -> Column:
    """Lengths of the runs of '1' that are at least so long."""
    return F.transform(F.regexp_extract_all(F.array_join(flags, ""), F.lit(f"1{{{least},}}"), F.lit(0)), F.length)


@dataclass
class Rule:
    """Settings are flat numbers; subclasses name their defaults."""

    config: dict = field(default_factory=dict)
    rule_type, name, count_key, level = "", "", "", ""
    DEFAULTS = {}
    views = ()
    #: Whether delta is the number of hits; the column that holds them, if there is one.
    COUNTS_HITS, held_in = False, None

    def __post_init__(self):
        unknown = set(self.config) - set(self.DEFAULTS)
        if unknown:
            raise TypeError(f"{type(self).__name__} has no setting {', '.join(sorted(unknown))}")
        self.config = {**self.DEFAULTS, **self.config}

    def __getitem__(self, key: str):
        return self.config[key]

    def delta(self) -> Column:
        raise NotImplementedError

    def strength(self, delta: Column) -> Column:
        """Sum of absolute penalties, given delta's column; for most rules one penalty per counted hit."""
        return delta * abs(self["penalty"])

    def hits(self) -> Column | None:
        """What violations and advice are made of, None if they are made of numbers."""
        return None

    def reading(self, column: str) -> Rule:
        """The rule, with its hits taken from a column."""
        rule = copy.copy(self)
        rule.held_in = column
        return rule

    def seen(self) -> Column:
        return F.col(self.held_in) if self.held_in else self.hits()

    def found(self) -> Column:
        raise NotImplementedError

    def advice(self) -> Column:
        return _no_advice()

    def _from_hits(self, hits: Column, penalty: int | None, explicit: bool = False) -> Column:
        t = F.col(TEXT)
        return F.transform(hits, lambda h: violation(self.name, h["match"], context(t, h["start"], h["end"], self["context_window_chars"]), h["penalty"] if penalty is None else penalty, h["start"] if explicit else None, h["end"] if explicit else None))

    def _once(self, holds: Column, match: str, ctx: Column, penalty=None) -> Column:
        return when_some(holds, F.array(violation(self.name, match, ctx, self["penalty"] if penalty is None else penalty)), _none())


def _number(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", exact_round(x, places))


def _percent(x: Column) -> Column:
    return F.format_string("%.0f%%", F.rint(x * 100))


def _preview(text: Column) -> Column:
    return F.concat(F.lit('"'), F.substring(text, F.lit(1), F.lit(80)), F.when(F.length(text) > 80, F.lit('..."')).otherwise(F.lit('"')))


def _list(numbers: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda n: n.cast("string")), ", "), F.lit("]"))


#: Contexts and matches that users compare, with the numbers as arguments.
ABOUT_PHRASE = "'%s' (%d-word phrase) appears %d times"
ABOUT_COPULA = "%d/%d sentences (%s) use a copula within the first 6 words"
ABOUT_SENTENCE = "Sentence %d has %d words (>= {min_words}): %s"
ABOUT_CLOSING = "Closing sentence matches %d generalizing patterns: %s"
ABOUT_BALANCE = "Body paragraph word counts %s - balance ratio %s (> {balance_threshold})"
ABOUT_PARAGRAPHS = "Paragraph length CV=%s (< {cv_threshold:.2f}) across lengths %s"
ABOUT_DIVIDERS = "%d horizontal rules — excessive section dividers"
ABOUT_QUOTES = "%d blockquote lines — Claude uses these as thesis statements"


class SlopWord(Rule):
    rule_type, name, count_key, level = "SlopWordRule", "slop_word", "slop_words", "word"
    DEFAULTS = {"penalty": -2, "context_window_chars": 60}
    views, COUNTS_HITS = ("v_masked",), True
    PATTERN = P.any_of(L.WORDS)

    def hits(self) -> Column:
        t = F.col(TEXT)
        title = P.TITLE_TOKEN

        def proper(h: Column) -> Column:
            before, after = F.substring(t, F.lit(1), h["start"]), F.substring(t, h["end"] + 1, F.length(t))
            named = F.regexp_like(before, F.lit(rf"(?<![\p{{L}}'.\-]){title}{P.SP}*\z")) | F.regexp_like(after, F.lit(rf"^{P.SP}*(?:{title}|[A-Z]\.)(?![\p{{L}}'.\-])"))
            return F.regexp_like(F.substring(t, h["start"] + 1, F.lit(1)), F.lit(r"^\p{Lu}")) & named

        return F.filter(spans(F.col("v_masked"), self.PATTERN), lambda h: ~proper(h))

    def delta(self) -> Column:
        return F.size(self.seen())

    def found(self) -> Column:
        return self._from_hits(F.transform(self.seen(), lambda h: F.struct(h["start"], h["end"], F.lower(h["match"]).alias("match"))), self["penalty"], True)

    def advice(self) -> Column:
        words = F.transform(self.seen(), lambda h: F.lower(h["match"]))

        def line(w: Column) -> Column:
            n = F.size(F.filter(words, lambda x: x == w))
            shown = F.concat(F.lit("'"), w, F.lit("'"), F.when(n > 1, F.concat(F.lit(" ("), n.cast("string"), F.lit(" occurrences)"))).otherwise(""))
            return (
                F.when(w.isin(*L.HEDGES), F.concat(F.lit("Cut "), shown, F.lit(" and begin with the statement.")))
                .when(w.isin(*L.VERBS), F.concat(F.lit("Replace "), shown, F.lit(" with what was done, and its result.")))
                .when(w.isin(*L.SYSTEM_NOUNS), F.concat(F.lit("Replace "), shown, F.lit(" with the system or group meant.")))
                .when(w.isin(*L.TIMELINE_NOUNS), F.concat(F.lit("Replace "), shown, F.lit(" with the period or step meant.")))
                .when(w.isin(*L.ADJECTIVES), F.concat(F.lit("Cut "), shown, F.lit(" or name the property that it stands for.")))
                .otherwise(F.concat(F.lit("Replace "), shown, F.lit(" with the thing itself.")))
            )

        return F.transform(F.array_distinct(words), line)


class PhraseRule(Rule):
    """Literal phrases, then regular expressions; one violation per hit."""

    views = ("v_lower",)
    PHRASES: tuple[str, ...] = ()
    PATTERNS: tuple[str, ...] = ()

    def _gate(self) -> Column:
        return F.lit(True)

    def _pattern_count(self) -> Column:
        n = sum((F.regexp_count(TEXT, F.lit(p)) for p in self.PATTERNS), F.lit(0))
        return F.when(self._gate(), n).otherwise(0)

    def delta(self) -> Column:
        n = phrase_count(F.col("v_lower"), self.PHRASES) if self.PHRASES else F.lit(0)
        return n + self._pattern_count() if self.PATTERNS else n

    def _phrase_penalty(self) -> int:
        return self["penalty"]

    def _pattern_penalty(self) -> int:
        return self["penalty"]

    def strength(self, delta: Column) -> Column:
        a, b = abs(self._phrase_penalty()), abs(self._pattern_penalty())
        return delta * a if a == b else (delta - self._pattern_count()) * a + self._pattern_count() * b

    def _clean(self, m: Column) -> Column:
        return F.lower(F.regexp_replace(m, rf"^{P.SP}+|{P.SP}+\z", ""))

    def pattern_hits(self) -> Column:
        found = [spans(F.col(TEXT), p) for p in self.PATTERNS]
        hits = F.concat(*found) if len(found) > 1 else found[0]
        hits = F.transform(hits, lambda h: F.struct(h["start"], h["end"], self._clean(h["match"]).alias("match")))
        return F.when(self._gate(), hits).otherwise(F.slice(hits, 1, 0))

    def hits(self) -> Column:
        out = []
        if self.PHRASES:
            out.append((phrase_hits(F.col(TEXT), F.col("v_lower"), self.PHRASES), self._phrase_penalty()))
        if self.PATTERNS:
            out.append((self.pattern_hits(), self._pattern_penalty()))
        priced = [F.transform(x, lambda h: F.struct(h["start"], h["end"], h["match"], F.lit(p).alias("penalty"))) for x, p in out]
        return F.concat(*priced) if len(priced) > 1 else priced[0]

    def found(self) -> Column:
        return self._from_hits(self.seen(), None)

    def advice(self) -> Column:
        return F.transform(self.seen(), lambda h: self.line(h["match"]))

    def line(self, m: Column) -> Column:
        return F.concat(F.lit("Cut '"), m, F.lit("' and state the point."))


class SlopPhrase(PhraseRule):
    rule_type, name, count_key, level = "SlopPhraseRule", "slop_phrase", "slop_phrases", "sentence"
    DEFAULTS = {"penalty": -3, "context_window_chars": 60}
    PHRASES, PATTERNS = L.PHRASES, (P.NOT_JUST_BUT,)

    def _gate(self) -> Column:
        held = [F.regexp_like("v_lower", F.lit(rf"{P.BEFORE}{w}{P.AFTER}")) for w in ("not", "but")]
        return F.contains(TEXT, F.lit(",")) & held[0] & held[1]

    def line(self, m: Column) -> Column:
        return (
            F.when(m.isin(*L.INTERACTIVE), F.concat(F.lit("Cut '"), m, F.lit("' and give the point instead of the invitation.")))
            .when(m.isin(*L.ANNOUNCEMENTS), F.concat(F.lit("Cut '"), m, F.lit("' and give the point instead of announcing it.")))
            .when(m.isin(*L.TRANSITIONS), F.concat(F.lit("Cut '"), m, F.lit("' and let the content show the relation.")))
            .otherwise(F.concat(F.lit("Cut '"), m, F.lit("' and give the point instead of the setup.")))
        )


class Tone(PhraseRule):
    rule_type, name, count_key, level = "ToneMarkerRule", "tone", "tone", "sentence"
    DEFAULTS = {"tone_penalty": -3, "sentence_opener_penalty": -2, "context_window_chars": 60}
    PHRASES, PATTERNS = L.META + L.NARRATIVITY, (P.OPENER % "certainly", P.OPENER % "absolutely")

    def _gate(self) -> Column:
        return F.contains("v_lower", F.lit("certainly")) | F.contains("v_lower", F.lit("absolutely"))

    def _phrase_penalty(self) -> int:
        return self["tone_penalty"]

    def _pattern_penalty(self) -> int:
        return self["sentence_opener_penalty"]

    def _clean(self, m: Column) -> Column:
        return F.lower(F.regexp_extract(m, r"(?iu)(certainly|absolutely)[,! ]\z", 1))

    def line(self, m: Column) -> Column:
        return F.when(m.isin("certainly", "absolutely"), F.concat(F.lit("Don't open a sentence with '"), m, F.lit("'."))).otherwise(F.concat(F.lit("Cut '"), m, F.lit("' and give the point.")))


class Weasel(PhraseRule):
    rule_type, name, count_key, level = "WeaselPhraseRule", "weasel", "weasel", "sentence"
    DEFAULTS = {"penalty": -2, "context_window_chars": 60}
    PHRASES = L.WEASEL

    def line(self, m: Column) -> Column:
        return F.concat(F.lit("Cut '"), m, F.lit("' or cite who says so."))


class Disclosure(PhraseRule):
    rule_type, name, count_key, level = "AIDisclosureRule", "ai_disclosure", "ai_disclosure", "sentence"
    DEFAULTS = {"penalty": -10, "context_window_chars": 60}
    PHRASES, PATTERNS = L.DISCLOSURES, (P.CUTOFF, P.JUST_AI)

    def line(self, m: Column) -> Column:
        return F.concat(F.lit("Remove '"), m, F.lit("': a text doesn't say what wrote it."))


class Placeholder(PhraseRule):
    rule_type, name, count_key, level = "PlaceholderRule", "placeholder", "placeholder", "sentence"
    DEFAULTS = {"penalty": -5, "context_window_chars": 60}
    PATTERNS = (P.PLACEHOLDER,)
    views = ()

    def _clean(self, m: Column) -> Column:
        return F.lower(m)

    def line(self, m: Column) -> Column:
        return F.concat(F.lit("Fill in or remove the placeholder '"), m, F.lit("'."))


class Structural(Rule):
    rule_type, name, count_key, level = "StructuralPatternRule", "structural", "structural", "paragraph"
    DEFAULTS = {"bold_header_min": 3, "bold_header_penalty": -5, "bullet_run_min": 6, "bullet_run_penalty": -3, "triadic_record_cap": 5, "triadic_penalty": -1, "triadic_advice_min": 3, "context_window_chars": 60}
    views = ("v_bullets",)

    def bold(self) -> Column:
        return F.regexp_count(TEXT, F.lit(P.BOLD_HEADER))

    def triads(self) -> Column:
        return F.regexp_count(TEXT, F.lit(P.TRIAD))

    def bullet_runs(self) -> Column:
        return runs(F.col("v_bullets"), self["bullet_run_min"])

    def hits(self) -> Column:
        return F.slice(spans(F.col(TEXT), P.TRIAD), 1, self["triadic_record_cap"])

    def _parts(self) -> tuple[Column, Column, Column]:
        return (self.bold() >= self["bold_header_min"]).cast("int"), F.size(self.bullet_runs()), F.least(self.triads(), F.lit(self["triadic_record_cap"]))

    def delta(self) -> Column:
        a, b, c = self._parts()
        return a + b + c

    def strength(self, delta: Column) -> Column:
        a, b, c = self._parts()
        return a * abs(self["bold_header_penalty"]) + b * abs(self["bullet_run_penalty"]) + c * abs(self["triadic_penalty"])

    def found(self) -> Column:
        bold = self._once(self.bold() >= self["bold_header_min"], "bold_header_explanation", F.concat(F.lit("Found "), self.bold().cast("string"), F.lit(" instances of **Bold.** pattern")), self["bold_header_penalty"])
        bullets = F.transform(self.bullet_runs(), lambda n: violation(self.name, "excessive_bullets", F.concat(F.lit("Run of "), n.cast("string"), F.lit(" consecutive bullet lines")), self["bullet_run_penalty"]))
        triads = F.transform(self.seen(), lambda h: violation(self.name, "triadic", context(F.col(TEXT), h["start"], h["end"], self["context_window_chars"]), self["triadic_penalty"]))
        return F.concat(bold, bullets, triads)

    def advice(self) -> Column:
        n = self.triads()
        return F.concat(
            when_some(self.bold() >= self["bold_header_min"], F.array(F.concat(self.bold().cast("string"), F.lit(" paragraphs begin with a bold label; vary them."))), _no_advice()),
            F.transform(self.bullet_runs(), lambda k: F.concat(F.lit("Write the list of "), k.cast("string"), F.lit(" items as prose."))),
            F.transform(self.seen(), lambda h: F.concat(F.lit("'"), h["match"], F.lit("' is a list of three; use one or two of its terms."))),
            when_some(n >= self["triadic_advice_min"], F.array(F.concat(n.cast("string"), F.lit(" lists of three; vary their length."))), _no_advice()),
        )


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v).cast("double") / F.size(x)


def variation(x: Column) -> Column:
    """Population standard deviation over mean, summed from the left."""
    mean = _mean(x)
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(x)) / mean


class OnceRule(Rule):
    """At most one violation per document."""

    def holds(self) -> Column:
        raise NotImplementedError

    def about(self) -> Column:
        raise NotImplementedError

    def tip(self) -> Column:
        raise NotImplementedError

    match = ""

    def delta(self) -> Column:
        return F.coalesce(self.holds(), F.lit(False)).cast("int")

    def found(self) -> Column:
        return self._once(F.coalesce(self.holds(), F.lit(False)), self.match, self.about())

    def advice(self) -> Column:
        return when_some(F.coalesce(self.holds(), F.lit(False)), F.array(self.tip()), _no_advice())


class Rhythm(OnceRule):
    rule_type, name, count_key, level = "RhythmRule", "rhythm", "rhythm", "passage"
    DEFAULTS = {"min_sentences": 5, "cv_threshold": 0.3, "penalty": -5}
    views, match = ("v_sentence_words",), "monotonous_rhythm"

    def holds(self) -> Column:
        x = F.col("v_sentence_words")
        return (F.size(x) >= self["min_sentences"]) & (_mean(x) > 0) & (variation(x) < self["cv_threshold"])

    def about(self) -> Column:
        x = F.col("v_sentence_words")
        return F.concat(F.lit("CV="), _number(variation(x), 2), F.lit(" across "), F.size(x).cast("string"), F.lit(" sentences (mean "), _number(_mean(x), 1), F.lit(" words)"))

    def tip(self) -> Column:
        x = F.col("v_sentence_words")
        return F.concat(F.lit("Sentences are alike in length (CV="), _number(variation(x), 2), F.lit(", "), F.array_min(x).cast("string"), F.lit(" to "), F.array_max(x).cast("string"), F.lit(" words); vary them."))


class EmDash(OnceRule):
    rule_type, name, count_key, level = "EmDashDensityRule", "em_dash", "em_dash", "passage"
    DEFAULTS = {"words_basis": 150.0, "density_threshold": 1.0, "penalty": -3}
    views, match = ("v_words",), "em_dash_density"

    def dashes(self) -> Column:
        t = F.col(TEXT)  # the two don't overlap, so each is counted by itself
        return (2 * F.length(t) - F.length(F.replace(t, F.lit("—"), F.lit(""))) - F.length(F.replace(t, F.lit(" -- "), F.lit("   ")))).cast("int")

    def ratio(self) -> Column:
        return F.when(F.col("v_words") > 0, self.dashes() / F.col("v_words") * F.lit(float(self["words_basis"])))

    def holds(self) -> Column:
        return self.ratio() > self["density_threshold"]

    def about(self) -> Column:
        return F.concat(self.dashes().cast("string"), F.lit(" em dashes in "), F.col("v_words").cast("string"), F.lit(" words ("), _number(self.ratio(), 1), F.lit(" per 150 words)"))

    def tip(self) -> Column:
        return F.concat(self.dashes().cast("string"), F.lit(" dashes in "), F.col("v_words").cast("string"), F.lit(" words; use other punctuation."))


class CappedRule(Rule):
    """Hits of which only the first few become violations; subclasses say which number counts."""

    CAPPED_COUNT = False

    def total(self) -> Column:
        raise NotImplementedError

    def delta(self) -> Column:
        n = self.total()
        return F.least(n, F.lit(self["record_cap"])) if self.CAPPED_COUNT else n

    def strength(self, delta: Column) -> Column:
        return F.least(delta, F.lit(self["record_cap"])) * abs(self["penalty"])

    def shown(self) -> Column:
        return F.slice(self.seen(), 1, self["record_cap"])

    def found(self) -> Column:
        return self._from_hits(self.shown(), self["penalty"])


class ContrastPair(CappedRule):
    rule_type, name, count_key, level = "ContrastPairRule", "contrast_pair", "contrast_pairs", "sentence"
    DEFAULTS = {"penalty": -1, "record_cap": 5, "advice_min": 2, "context_window_chars": 60}
    CAPPED_COUNT = True

    def total(self) -> Column:
        return F.regexp_count(TEXT, F.lit(P.X_NOT_Y)) + F.regexp_count(TEXT, F.lit(P.STAGED))

    def hits(self) -> Column:
        def of(pattern: str, kind: str) -> Column:
            return F.transform(spans(F.col(TEXT), pattern), lambda h: F.struct(h["start"], h["end"], F.lit(kind).alias("kind"), F.regexp_replace(h["match"], rf"^{P.SP}+|{P.SP}+\z", "").alias("match")))

        return F.sort_array(F.concat(of(P.X_NOT_Y, "x_not_y"), of(P.STAGED, "staged_contrast")))

    def advice(self) -> Column:
        n, staged = F.size(self.seen()), F.exists(self.seen(), lambda h: h["kind"] == "staged_contrast")
        return F.concat(
            F.transform(self.shown(), lambda h: F.concat(F.lit("Say '"), h["match"], F.when(h["kind"] == "x_not_y", "' as a plain sentence, not as a slogan.").otherwise("' directly, without staging a contrast."))),
            when_some(n >= self["advice_min"], F.array(F.concat(n.cast("string"), F.when(staged, " contrasts").otherwise(" slogans of one thing, not another"), F.lit("; write at least one as a plain sentence."))), _no_advice()),
        )


class KeywordBold(CappedRule):
    rule_type, name, count_key, level = "IntrasentenceKeywordBoldRule", "intrasentence_keyword_bold", "intrasentence_keyword_bold", "sentence"
    DEFAULTS = {"penalty": -2, "record_cap": 5, "advice_min": 3, "max_words": 5, "context_window_chars": 60}
    views, COUNTS_HITS = ("v_masked",), True

    def hits(self) -> Column:
        t, masked = F.col(TEXT), F.col("v_masked")

        def keep(h: Column) -> Column:
            inner = F.substring(h["match"], F.lit(3), F.length(h["match"]) - 4)
            before, after = F.substring(masked, F.lit(1), h["start"]), F.substring(masked, h["end"] + 1, F.length(masked))
            line, rest = F.substring_index(F.substring(t, F.lit(1), h["start"]), "\n", -1), F.substring_index(F.substring(t, h["start"] + 1, F.length(t)), "\n", 1)
            label = F.regexp_like(inner, F.lit(r"[:.]\z")) & F.regexp_like(after, F.lit(rf"^{P.SP}+{P.NS}"))
            number = F.regexp_like(inner, F.lit(P.NUMERIC_BOLD))
            long = F.regexp_count(inner, F.lit(f"{P.W}+")) > self["max_words"]
            excluded = F.regexp_like(F.concat(line, rest), F.lit(rf"^{P.SP}*(?:#|>)|{P.BULLET}"))
            # At the start, after a sentence's end, or on a line after such an end or an empty line, blanks aside.
            bare = F.rtrim(before, F.lit(" \t\r"))
            above = F.rtrim(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit(" \t\r"))
            begins = (bare == "") | F.right(bare, F.lit(1)).isin(".", "!", "?") | F.endswith(bare, F.lit("\n")) & ((above == "") | F.right(above, F.lit(1)).isin(".", "!", "?", "\n"))
            return ~(label | number | long | excluded | begins)

        found = F.filter(spans(masked, P.BOLD_SPAN), keep)
        hits = F.transform(found, lambda h: F.struct(h["start"], h["end"], F.substring(t, h["start"] + 1, h["end"] - h["start"]).alias("match")))
        return F.when(F.contains(masked, F.lit("**")), hits).otherwise(F.slice(hits, 1, 0))

    def total(self) -> Column:
        return F.when(F.contains("v_masked", F.lit("**")), F.size(self.seen())).otherwise(0)

    def found(self) -> Column:
        return self._from_hits(self.shown(), self["penalty"], True)

    def advice(self) -> Column:
        n = self.total()
        return F.concat(
            F.transform(self.shown(), lambda h: F.concat(F.lit("Take the bold off '"), h["match"], F.lit("' in the sentence."))),
            when_some(n >= self["advice_min"], F.array(F.concat(n.cast("string"), F.lit(" bold keywords in running prose; use plain text."))), _no_advice()),
        )


class SetupResolution(CappedRule):
    rule_type, name, count_key, level = "SetupResolutionRule", "setup_resolution", "setup_resolution", "sentence"
    DEFAULTS = {"penalty": -3, "record_cap": 5, "context_window_chars": 60}
    views, COUNTS_HITS = ("v_lower",), True

    def _gate(self) -> Column:
        return F.contains("v_lower", F.lit("n't")) | F.regexp_like("v_lower", F.lit(rf"{P.BEFORE}(?:not|cannot){P.AFTER}"))

    def hits(self) -> Column:
        found = F.array_distinct(F.concat(spans(F.col(TEXT), P.SETUP_A), spans(F.col(TEXT), P.SETUP_B)))
        return F.when(self._gate(), found).otherwise(F.slice(found, 1, 0))

    def total(self) -> Column:
        return F.when(self._gate(), F.size(self.seen())).otherwise(0)

    def advice(self) -> Column:
        return F.transform(self.shown(), lambda h: F.concat(F.lit("'"), h["match"], F.lit("' sets up one thing to resolve into another; state the point.")))


class ColonDensity(OnceRule):
    rule_type, name, count_key, level = "ColonDensityRule", "colon_density", "colon_density", "passage"
    DEFAULTS = {"words_basis": 150.0, "density_threshold": 1.5, "penalty": -3}
    views, match = ("v_unfenced",), "colon_density"

    def colons(self) -> Column:
        prose = F.filter(F.split("v_unfenced", "\n", -1), lambda x: ~F.startswith(x, F.lit("#")))
        n = F.aggregate(prose, F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(P.COLON)))
        return F.when(F.contains("v_unfenced", F.lit(": ")), n).otherwise(0)

    def _words(self) -> Column:
        return F.regexp_count("v_unfenced", F.lit(f"{P.NS}+"))

    def ratio(self) -> Column:
        words = self._words()
        return F.when(words > 0, self.colons() / words * F.lit(float(self["words_basis"])))

    def holds(self) -> Column:
        return self.ratio() > self["density_threshold"]

    def about(self) -> Column:
        return F.concat(self.colons().cast("string"), F.lit(" elaboration colons in "), self._words().cast("string"), F.lit(" words ("), _number(self.ratio(), 1), F.lit(" per 150 words)"))

    def tip(self) -> Column:
        return F.concat(self.colons().cast("string"), F.lit(" colons introduce elaborations in "), self._words().cast("string"), F.lit(" words; use full stops."))


class PithyFragment(CappedRule):
    rule_type, name, count_key, level = "PithyFragmentRule", "pithy_fragment", "pithy_fragment", "sentence"
    DEFAULTS = {"penalty": -2, "max_sentence_words": 6, "record_cap": 3}
    views, COUNTS_HITS = ("v_sentences", "v_sentence_words"), True

    def hits(self) -> Column:
        return F.filter("v_sentences", lambda s, i: (F.get("v_sentence_words", i) <= self["max_sentence_words"]) & F.contains(s, F.lit(",")) & F.regexp_like(s, F.lit(P.PIVOT)))

    def total(self) -> Column:
        return F.size(self.seen())

    def found(self) -> Column:
        return F.transform(self.shown(), lambda s: violation(self.name, s, s, self["penalty"]))

    def advice(self) -> Column:
        return F.transform(self.shown(), lambda s: F.concat(F.lit("'"), s, F.lit("' is a pithy fragment; join it to a full sentence.")))


class BulletDensity(OnceRule):
    rule_type, name, count_key, level = "BulletDensityRule", "bullet_density", "bullet_density", "paragraph"
    DEFAULTS = {"ratio_threshold": 0.4, "penalty": -8}
    views, match = ("v_lines", "v_bullets"), "bullet_density"

    def filled(self) -> Column:
        return F.size(F.filter("v_lines", lambda x: F.regexp_like(x, F.lit(f"{P.NS}"))))

    def bullets(self) -> Column:
        return F.size(F.filter("v_bullets", lambda x: x == "1"))

    def ratio(self) -> Column:
        n = self.filled()
        return F.when(n > 0, self.bullets() / n)

    def holds(self) -> Column:
        return self.ratio() > self["ratio_threshold"]

    def about(self) -> Column:
        return F.concat(self.bullets().cast("string"), F.lit(" of "), self.filled().cast("string"), F.lit(" non-empty lines are bullets ("), _percent(self.ratio()), F.lit(")"))

    def tip(self) -> Column:
        return F.concat(F.lit("Write as prose: "), self.about(), F.lit("."))


class BlockquoteDensity(OnceRule):
    rule_type, name, count_key, level = "BlockquoteDensityRule", "blockquote_density", "blockquote_density", "paragraph"
    DEFAULTS = {"min_lines": 3, "free_lines": 2, "cap": 4, "penalty_step": -3}
    views, match = ("v_lines",), "blockquote_density"

    def quotes(self) -> Column:
        def step(a: Column, x: Column) -> Column:
            fence = F.regexp_like(x, F.lit(rf"^{P.SP}*```"))
            return F.struct(F.when(fence, ~a["in_code"]).otherwise(a["in_code"]).alias("in_code"), (a["n"] + F.when(~fence & ~a["in_code"] & F.startswith(x, F.lit(">")), 1).otherwise(0)).alias("n"))

        n = F.aggregate("v_lines", F.struct(F.lit(False).alias("in_code"), F.lit(0).alias("n")), step, lambda a: a["n"])
        return F.when(F.contains(TEXT, F.lit(">")), n).otherwise(0)

    def _times(self) -> Column:
        return F.least(self.quotes() - self["free_lines"], F.lit(self["cap"]))

    def holds(self) -> Column:
        return self.quotes() >= self["min_lines"]

    def strength(self, delta: Column) -> Column:
        return F.when(self.holds(), F.abs(self._times() * self["penalty_step"])).otherwise(0)

    def found(self) -> Column:
        return self._once(self.holds(), self.match, self.about(), self._times() * self["penalty_step"])

    def about(self) -> Column:
        return F.format_string(ABOUT_QUOTES, self.quotes())

    def tip(self) -> Column:
        return F.concat(self.quotes().cast("string"), F.lit(" blockquote lines"), F.lit("; bring the quotations into the text."))


class BoldBulletRun(Rule):
    rule_type, name, count_key, level = "BoldTermBulletRunRule", "bold_bullet_list", "bold_bullet_list", "paragraph"
    DEFAULTS = {"min_run_length": 3, "penalty": -5}
    views = ("v_bold_bullets",)

    def runs(self) -> Column:
        return runs(F.col("v_bold_bullets"), self["min_run_length"])

    def delta(self) -> Column:
        return F.size(self.runs())

    def found(self) -> Column:
        return F.transform(self.runs(), lambda n: violation(self.name, "bold_bullet_list", F.concat(F.lit("Run of "), n.cast("string"), F.lit(" bold-term bullets")), self["penalty"]))

    def advice(self) -> Column:
        return F.transform(self.runs(), lambda n: F.concat(n.cast("string"), F.lit(" bullets in a row begin with a bold term; use prose.")))


class HorizontalRules(OnceRule):
    rule_type, name, count_key, level = "HorizontalRuleOveruseRule", "horizontal_rules", "horizontal_rules", "paragraph"
    DEFAULTS = {"min_count": 4, "penalty": -3}
    match = "horizontal_rules"

    def dividers(self) -> Column:
        return F.regexp_count(TEXT, F.lit(P.DIVIDER))

    def holds(self) -> Column:
        return self.dividers() >= self["min_count"]

    def about(self) -> Column:
        return F.format_string(ABOUT_DIVIDERS, self.dividers())

    def tip(self) -> Column:
        return F.concat(self.dividers().cast("string"), F.lit(" horizontal rules"), F.lit("; sections need no lines between them."))


class PhraseReuse(CappedRule):
    """Word sequences that come again and again. Its in-row form serves scores and streams; plans/phrases.py has the relational one."""

    rule_type, name, count_key, level = "PhraseReuseRule", "phrase_reuse", "phrase_reuse", "passage"
    DEFAULTS = {"penalty": -1, "record_cap": 5, "repeated_ngram_min_n": 4, "repeated_ngram_max_n": 8, "repeated_ngram_min_count": 3}
    views = ("v_reuse",)
    CAPPED_COUNT = True

    def hits(self) -> Column:
        return F.col("v_reuse")

    def total(self) -> Column:
        return F.size("v_reuse")

    def found(self) -> Column:
        return F.transform(self.shown(), lambda h: violation(self.name, h["phrase"], F.format_string(ABOUT_PHRASE, h["phrase"], h["n"], h["count"]), self["penalty"]))

    def advice(self) -> Column:
        return F.transform(self.shown(), lambda h: F.concat(F.lit("'"), h["phrase"], F.lit("' comes "), h["count"].cast("string"), F.lit(" times; vary it.")))


class CopulaChain(OnceRule):
    rule_type, name, count_key, level = "CopulaChainRule", "copula_chain", "copula_chain", "passage"
    DEFAULTS = {"min_sentences": 6, "threshold": 0.5, "penalty": -3}
    views, match = ("v_sentences",), "copula_density"

    def chained(self) -> Column:
        head = lambda s: F.array_join(F.slice(F.split(s, f"{P.SP}+", 7), 1, 6), " ")
        return F.size(F.filter("v_sentences", lambda s: F.regexp_like(head(s), F.lit(P.COPULA))))

    def holds(self) -> Column:
        n = F.size("v_sentences")
        return (n >= self["min_sentences"]) & (self.chained() / n >= self["threshold"])

    def about(self) -> Column:
        return F.format_string(ABOUT_COPULA, self.chained(), F.size("v_sentences"), _percent(self.chained() / F.size("v_sentences")))

    def tip(self) -> Column:
        return F.concat(self.chained().cast("string"), F.lit(" of "), F.size("v_sentences").cast("string"), F.lit(" sentences lean on is, are, was or were; use verbs that do something."))


class ExtremeSentence(Rule):
    rule_type, name, count_key, level = "ExtremeSentenceRule", "extreme_sentence", "extreme_sentence", "passage"
    DEFAULTS = {"min_words": 140, "penalty": -5}
    views, COUNTS_HITS = ("v_plain_sentences", "v_plain_sentence_words"), True

    def hits(self) -> Column:
        numbered = F.transform("v_plain_sentences", lambda s, i: F.struct(s.alias("s"), (i + 1).alias("i"), F.get("v_plain_sentence_words", i).alias("n")))
        return F.when(F.exists("v_plain_sentence_words", lambda n: n >= self["min_words"]), F.filter(numbered, lambda x: x["n"] >= self["min_words"])).otherwise(F.slice(numbered, 1, 0))

    def delta(self) -> Column:
        return F.size(self.seen())

    def found(self) -> Column:
        return F.transform(self.seen(), lambda x: violation(self.name, "run_on_sentence", F.format_string(ABOUT_SENTENCE.format(**self.config), x["i"], x["n"], _preview(x["s"])), self["penalty"]))

    def advice(self) -> Column:
        return F.transform(self.seen(), lambda x: F.concat(F.lit("Split sentence "), x["i"].cast("string"), F.lit(" ("), x["n"].cast("string"), F.lit(" words).")))


class ClosingAphorism(OnceRule):
    rule_type, name, count_key, level = "ClosingAphorismRule", "closing_aphorism", "closing_aphorism", "passage"
    DEFAULTS = {"min_sentences": 4, "penalty": -4}
    views, match = ("v_sentences",), "closing_aphorism"
    LEAST = 2

    def signs(self) -> Column:
        last = F.get("v_sentences", F.size("v_sentences") - 1)
        return sum((F.regexp_like(last, F.lit(p)).cast("int") for p in P.APHORISMS), F.lit(0))

    def holds(self) -> Column:
        return (F.size("v_sentences") >= self["min_sentences"]) & (self.signs() >= self.LEAST)

    def about(self) -> Column:
        return F.format_string(ABOUT_CLOSING, self.signs(), _preview(F.get("v_sentences", F.size("v_sentences") - 1)))

    def tip(self) -> Column:
        return F.lit("End on a fact or a next step instead of a moral.")


class ParagraphBalance(OnceRule):
    rule_type, name, count_key, level = "ParagraphBalanceRule", "paragraph_balance", "paragraph_balance", "passage"
    DEFAULTS = {"min_body_paragraphs": 3, "balance_threshold": 0.7, "penalty": -6}
    views, match = ("v_paragraph_words",), "paragraph_balance"

    def ratio(self) -> Column:
        body = F.slice("v_paragraph_words", 2, F.greatest(F.size("v_paragraph_words") - 1, F.lit(0)))
        return F.array_min(body) / F.array_max(body)

    def holds(self) -> Column:
        return (F.size("v_paragraph_words") >= self["min_body_paragraphs"] + 1) & (self.ratio() > self["balance_threshold"])

    def about(self) -> Column:
        return F.format_string(ABOUT_BALANCE.format(**self.config), _list(F.slice("v_paragraph_words", 2, F.greatest(F.size("v_paragraph_words") - 1, F.lit(0)))), _number(self.ratio(), 2))

    def tip(self) -> Column:
        return F.lit("Paragraphs are of nearly one length; let content decide it.")


class ParagraphCV(OnceRule):
    rule_type, name, count_key, level = "ParagraphCVRule", "paragraph_cv", "paragraph_cv", "passage"
    DEFAULTS = {"min_paragraphs": 5, "cv_threshold": 0.45, "penalty": -1}
    views, match = ("v_paragraph_words",), "paragraph_cv"

    def holds(self) -> Column:
        x = F.col("v_paragraph_words")
        return (F.size(x) >= self["min_paragraphs"]) & (_mean(x) > 0) & (variation(x) < self["cv_threshold"])

    def about(self) -> Column:
        x = F.col("v_paragraph_words")
        return F.format_string(ABOUT_PARAGRAPHS.format(**self.config), _number(variation(x), 2), _list(x))

    def tip(self) -> Column:
        x = F.col("v_paragraph_words")
        return F.concat(F.lit("Paragraph lengths vary little (CV="), _number(variation(x), 2), F.lit(" across "), F.size(x).cast("string"), F.lit(" paragraphs)."))


#: In the order in which they are evaluated.
RULE_TYPES = (
    SlopWord, SlopPhrase, Structural, Tone, Weasel, Disclosure, Placeholder, Rhythm, EmDash, ContrastPair, KeywordBold, SetupResolution, ColonDensity,
    PithyFragment, BulletDensity, BlockquoteDensity, BoldBulletRun, HorizontalRules, PhraseReuse, CopulaChain, ExtremeSentence, ClosingAphorism, ParagraphBalance, ParagraphCV,
)
BY_NAME = {r.rule_type: r for r in RULE_TYPES}


def default_rules() -> list[Rule]:
    return [r() for r in RULE_TYPES]
