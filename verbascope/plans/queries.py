"""The queries over the driver's tables, by name, and SQL that must agree with each."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicons as L
from ..operators.rules import RULE_TYPES, KeywordBold, Rule, SlopWord
from ..sources.tables import stored
from . import analytics, phrases
from ..functions.views import held
from .analysis import analyze, prepared, score
from .fit import fit

#: Endings that make rules fire; document n gets number n modulo their count.
SNIPPETS = (
    "It is a crucial and robust landscape, and they delve into a seamless game-changing journey significantly.",
    "It's worth noting that we adapt. In addition, the key insight is not just a plan, but also a habit. We want to adapt to different needs.",
    "- one\n- two\n- three\n- four\n- five\n- six\n- seven\n**Speed.** Fast runs. **Cost:** Low cost. **Care.** Good care.",
    "Certainly! Let me know if this helps. Absolutely, feel free to ask. I hope this works.",
    "Many believe it. Studies show that some argue, and research suggests more, small, quick, and bright.",
    "As an AI I cannot browse. As of my last cutoff, I'm just an AI. Please [insert name here] and [todo: fix].",
    "We ran there now. They sat here then. You came back soon. She went home late. He left town early. It was a calm night. This is a plain day. These are old roads.",
    "It moved -- slowly -- and then — suddenly — it stopped. Choose speed, not luck. Not only did it work but it also lasted long.",
    "It isn't about speed. It's about trust. That's not a bug. It's a habit. Short, but sweet. Quick, not easy.",
    "Note: this matters: always here: see https: yes and value: true or so: right.\n# Head: not here",
    "> one\n> two\n> three\n> four\n\n---\n\n***\n\n___\n\n---\n\n- **A** x\n- **B** y\n- **C** z\n- **D** w",
    "the quick red fox ran home. the quick red fox ran away. the quick red fox ran off. In the end, we build what we choose.",
    "one two three four five six\n\none two three four five\n\none two three four five\n\none two three four five six\n\none two three four five",
    "Plain words stand here without any sign of trouble.",
)


#: Endings with code, tables, names and bold keywords, dealt out alike.
MARKED_SNIPPETS = (
    "Here is `inline crucial` text and ``two robust`` ticks, then prose.\n```\ncrucial fence: with words\nand more\n```\nA crucial end.",
    "| one | two |\n|-----|-----|\n| three. four | five |\n| six | seven |\nAfter the table. It ends.",
    "We met Crucial Jones and the Robust Systems team at a crucial time.",
    "The plan has a **very bold** word in it and **another one** here.\n\n**Label.** Text that follows it.",
    "A fence is next.\n```python\nx = 1\n```\nAnd `a` then `b` follow.\n```\nlast one\n```",
    "Plain words end this one.",
)


def documents(spark: SparkSession, sf_dir: str, snippets: tuple[str, ...] = SNIPPETS) -> DataFrame:
    """documents with text continued by a snippet; asterisks of their own go where the snippets are marked up."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ending = F.get(F.array(*map(F.lit, snippets)), (F.col("doc_id") % len(snippets)).cast("int"))
    own = F.coalesce("text", F.lit(""))
    own = F.translate(own, "*", "") if snippets is MARKED_SNIPPETS else own
    return df.select("doc_id", "source", F.concat(own, F.lit("\n\n"), ending).alias("text"))


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, dealt out evenly: a file may hold all of its rows in one group, which only one task reads, and analysing a text costs far more than sending it."""
    return documents(spark, sf_dir).repartition("doc_id", "text")


def _count_query(rule: type[Rule], snippets: tuple[str, ...] = SNIPPETS) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = rule()
        return prepared(documents(spark, sf_dir, snippets), "text", [r]).select("doc_id", F.coalesce(r.delta(), F.lit(0)).cast("long").alias("hits"))

    return query


CORE = tuple(r for r in RULE_TYPES if r is not KeywordBold)


def _core(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(documents(spark, sf_dir).select("doc_id", "source", "text"), "text", [r() for r in CORE])
    return stored(scored.drop("text"), "scores")


def core_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _core(spark, sf_dir).select("doc_id", F.col("score").cast("long"), "band", F.col("word_count").cast("long"))


def full_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), "text").select("doc_id", "score", "band", "word_count")


def full_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(dealt(spark, sf_dir), "text").drop("text", "source", "counts").withColumn("violations", F.to_json("violations"))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze(dealt(spark, sf_dir), "text").select("doc_id", held(F.col("violations")).alias("violations"))
    return found.select("doc_id", F.explode("violations").alias("v")).select("doc_id", "v.*")


def by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(score(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", "text")).drop("text"), "roles").groupBy("role").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))


def code_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside of code, characters outside of fences, and fences."""
    views = prepared(documents(spark, sf_dir, MARKED_SNIPPETS), "text", [], {"v_masked", "v_unfenced", "v_tokens"})
    fences = F.coalesce(F.size(F.filter("v_tokens", lambda x: x["fence"])), F.lit(0))
    return views.select("doc_id", F.col("v_words").cast("long").alias("words"), F.length("v_unfenced").cast("long").alias("chars"), F.greatest(fences, F.lit(0)).cast("long").alias("fences"))


def plain_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with fences and tables taken as breaks."""
    views = prepared(documents(spark, sf_dir, MARKED_SNIPPETS), "text", [], {"v_plain_sentences", "v_plain_sentence_words"})
    return views.select("doc_id", F.size("v_plain_sentences").cast("long").alias("sentences"), F.array_max("v_plain_sentence_words").cast("long").alias("longest"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.views import counts_of, paragraphs, sentences, word_count

    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", word_count(t).cast("long").alias("words"), F.size(sentences(t)).cast("long").alias("sentences"), F.size(paragraphs(t)).cast("long").alias("paragraphs"), F.coalesce(F.array_max(counts_of(sentences(t))), F.lit(0)).cast("long").alias("longest"))


def reused_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.repeated_phrases(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "phrase", F.col("count").cast("long"), F.col("n").cast("long"))


def mean_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.mean_by(_core(spark, sf_dir), ["source"], "score").select("source", F.round("mean_score", 6).alias("mean_score"))


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = analytics.regression(_core(spark, sf_dir))
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "correlation")])


def fitted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings learned from all labelled documents, those of quality 1 as positives: rule, place in the order, settings as JSON."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rules = fit(documents(spark, sf_dir).join(labels, "doc_id"), "text", "label")
    return spark.createDataFrame([(i, r.rule_type, json.dumps(r.config, sort_keys=True)) for i, r in enumerate(rules)], "place int, rule_type string, config string")


def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What penalties are learned from: by label, in how many documents a rule fires."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    r = RULE_TYPES[0]()
    hits = prepared(documents(spark, sf_dir).join(labels, "doc_id"), "text", [r]).select("label", held(r.delta()).alias("hits"))
    return hits.groupBy("label").agg(F.count_if(F.col("hits") > 0).alias("matched"), F.count(F.lit(1)).alias("total"))


def payload_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the payload, over all rules but keyword bold: the sum of the violations' penalties, and the rounded ones."""
    found = analyze(documents(spark, sf_dir).select("doc_id", "text"), "text", [r() for r in CORE], spans=False)
    return found.select("doc_id", F.col("total_penalty").cast("long"), "weighted_sum", "density")


def advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of advice in their order, each once per document."""
    found = analyze(dealt(spark, sf_dir).select("doc_id", "text"), "text", spans=False)
    return found.select("doc_id", held(F.col("advice")).alias("advice")).select("doc_id", F.posexplode("advice").alias("place", "advice"))


def slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines of the greatest quantity, the two return flags with the greatest mean price."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("price"))
    return analytics.slowest_at_longest(lines, "l_returnflag", "l_quantity", "price", 2).select("l_returnflag", F.round("mean_price", 4).alias("mean_price"))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which not all documents are labelled: their numbers before and after."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    count = lambda df: df.groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    return analytics.changed(count(docs), count(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f"c{i + 1:02d}_{r.count_key}": _count_query(r) for i, r in enumerate(RULE_TYPES)}
    found |= {
        "a07_code_views": code_views,
        "b04_plain_sentences": plain_sentences,
        "b12_named_words": _count_query(SlopWord, MARKED_SNIPPETS),
        "b23_bold_keywords": _count_query(KeywordBold, MARKED_SNIPPETS),
        "b01_word_counts": word_counts,
        "b07_reused_phrases": reused_phrases,
        "d08_core_scores": core_scores,
        "d08_scores": full_scores,
        "d15_payload": full_payload,
        "d15_violations": violations,
        "e01_fit": fitted_rules,
        "e10_hit_rates": hit_rates,
        "h03_band_counts": lambda s, d: analytics.band_counts(_core(s, d)),
        "h04_histogram": lambda s, d: analytics.histogram(_core(s, d)).select("bin_start", "bin_end", "n"),
        "h05_summary": lambda s, d: analytics.summary(_core(s, d).withColumn("score", F.col("score").cast("long"))),
        "h06_regression": regression,
        "h08_samples": lambda s, d: analytics.samples(_core(s, d), "doc_id", 25).select(F.col("index").cast("long"), "doc_id", F.col("score").cast("long"), F.col("word_count").cast("long"), "band"),
        "h09_mean_by_source": mean_by_source,
        "h01_roles": by_role,
        "d16_payload_numbers": payload_numbers,
        "d10_advice": advice,
        "h10_slowest_at_longest": slowest,
        "h11_changed": changed,
        "h12_non_text": lambda s, d: analytics.non_text(s.read.parquet(f"{d}/documents.parquet")),
    }
    return found


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _listed(items) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]"


_M = f"d AS (SELECT doc_id, replace(coalesce(text, ''), '*', '') || chr(10) || chr(10) || ({_listed(MARKED_SNIPPETS)})[(doc_id % {len(MARKED_SNIPPETS)})::INT + 1] AS t FROM documents)"
_D = f"d AS (SELECT doc_id, source, coalesce(text, '') || chr(10) || chr(10) || ({_listed(SNIPPETS)})[(doc_id % {len(SNIPPETS)})::INT + 1] AS t FROM documents)"
_WORD = r"[\p{L}\p{N}_]"


def _n(pattern: str, of: str = "t") -> str:
    return f"len(regexp_extract_all({of}, {_quoted(pattern)}))"


def _phrases(items) -> str:
    return f"list_sum(list_transform({_listed(items)}, lambda p: (length(lower(t)) - length(replace(lower(t), p, ''))) // length(p)))"


_SENTENCES = "list_filter(list_transform(regexp_split_to_array(t, '[.!?][\"''”’)\\]]*(?:\\s+|$)'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '')"
_SIZES = f"list_transform({_SENTENCES}, lambda s: {_n(r'[^\s]+', 's')})"
_PARAGRAPHS = f"list_transform(list_filter(regexp_split_to_array(t, '\\n\\s*\\n'), lambda p: regexp_matches(p, '\\S')), lambda p: {_n(r'[^\s]+', 'p')})"
_LINES = "string_split(t, chr(10))"
_FLAGS = "array_to_string(list_transform(" + _LINES + ", lambda x: CASE WHEN regexp_matches(x, {}) THEN '1' ELSE '0' END), '')"
_WORDS = _n(r"[^\s]+")
_VAR = "sqrt(list_sum(list_transform(x, lambda v: (v - list_avg(x)) * (v - list_avg(x)))) / len(x)) / list_avg(x)"
_RES = r"[.;:,]\s*(?:it's|they're|that's|he's|she's|we're|it\s+is|they\s+are|that\s+is|this\s+is|these\s+are|those\s+are|%swhat's|what\s+is|the\s+real|the\s+actual|instead|rather)"
_NEG = r"isn't|aren't|wasn't|weren't|doesn't|don't|didn't|hasn't|haven't|won't|can't|couldn't|shouldn't|is\s+not|are\s+not|was\s+not|were\s+not|does\s+not|do\s+not|did\s+not|has\s+not|have\s+not|will\s+not|cannot|could\s+not|should\s+not"
_LAST = f"({_SENTENCES})[-1]"
_APHORISMS = (r"(?i)^sometimes\b", r"(?i)\bisn't\b.{1,40}\bit's\b", r"(?i)\bnot\b.{1,30}\bit's\b.{1,40}$", r"(?i)^the (?:real|true|actual|biggest|greatest|most important)\b", r"(?i)^(?:in the end|ultimately|at the end of the day)\b", r"(?i)\bwe (?:bring|carry|create|make|build|choose)\b", r"(?i)^that's (?:the |what |where |why |how )", r"(?i)^it (?:all )?(?:comes|boils) down to\b")

#: Expressions over t, by the rules' counters.
HITS = {
    "slop_words": f"len(list_filter(regexp_extract_all(lower(t), '{_WORD}+'), lambda w: list_contains({_listed([w for w in L.WORDS if '-' not in w])}, w))) + {_phrases([w for w in L.WORDS if '-' in w])}",
    "slop_phrases": f"{_phrases(L.PHRASES)} + CASE WHEN contains(t, ',') AND list_has_all(regexp_extract_all(lower(t), '{_WORD}+'), ['not', 'but']) THEN {_n('(?i-s)not (?:just|only) .{1,40}, but (?:also )?')} ELSE 0 END",
    "structural": f"({_n(r'\*\*[^*]+[.:]\*\*\s+\S')} >= 3)::INT + {_n('1{6,}', _FLAGS.format(_quoted(r'^\s*(?:[-*]\s|\d+[.)]\s)')))} + least(5, {_n(rf'(?i){_WORD}+, {_WORD}+, and {_WORD}+')})",
    "tone": f"{_phrases(L.META + L.NARRATIVITY)} + {_n('(?im)(?:^|[.!?]\\s+)certainly[,! ]')} + {_n('(?im)(?:^|[.!?]\\s+)absolutely[,! ]')}",
    "weasel": _phrases(L.WEASEL),
    "ai_disclosure": f"{_phrases(L.DISCLOSURES)} + {_n(r'(?i)\bas of my (?:last |knowledge )?cutoff\b')} + {_n(chr(40) + '?i)' + chr(92) + 'bi' + chr(39) + 'm just an? ai' + chr(92) + 'b')}",
    "placeholder": _n(r"(?i)\[insert [^\]]*\]|\[describe [^\]]*\]|\[url [^\]]*\]|\[your [^\]]*\]|\[todo[^\]]*\]"),
    "rhythm": f"(SELECT coalesce(len(x) >= 5 AND list_avg(x) > 0 AND {_VAR} < 0.3, false)::INT FROM (SELECT {_SIZES} AS x))",
    "em_dash": f"({_WORDS} > 0 AND {_n('—| -- ')}::DOUBLE / {_WORDS} * 150.0 > 1.0)::INT",
    "contrast_pairs": f"least(5, {_n(rf'{_WORD}+, not {_WORD}+')} + {_n(r'(?i)\bnot (?:only|just|merely)\b[^.!?\n]{1,80}?\bbut(?: also)?\b[^.!?\n,;:]{1,80}?(?:[,.;:!?\n]|$)')})",
    "setup_resolution": f"{_n(rf'(?i-s)\b(?:this|that|these|those|it|they|we)\s+(?:{_NEG})\b.{{0,80}}' + _RES % r'he\s+is|she\s+is|we\s+are|')} + {_n(r'(?i-s)\b(?:it' + chr(39) + 's|that' + chr(39) + r's|this\s+is|they' + chr(39) + 're|he' + chr(39) + 's|she' + chr(39) + 's|we' + chr(39) + r're)\s+not\b.{0,80}' + _RES % '')}",
    "colon_density": f"({_WORDS} > 0 AND list_sum(list_transform(list_filter({_LINES}, lambda x: NOT starts_with(x, '#')), lambda x: {_n(': [a-z]', 'x')} - {_n('https?: [a-z]', 'x')} - {_n(': (?:true|false|null)', 'x')}))::DOUBLE / {_WORDS} * 150.0 > 1.5)::INT",
    "pithy_fragment": f"len(list_filter({_SENTENCES}, lambda s: {_n(r'[^\s]+', 's')} <= 6 AND regexp_matches(s, '(?i),\\s+(?:but|yet|and|not|or)(?:[^\\p{{L}}\\p{{N}}_]|$)')))",
    "bullet_density": f"(len(list_filter({_LINES}, lambda x: regexp_matches(x, '\\S'))) > 0 AND len(list_filter({_LINES}, lambda x: regexp_matches(x, '^\\s*(?:[-*]\\s|\\d+[.)]\\s)')))::DOUBLE / len(list_filter({_LINES}, lambda x: regexp_matches(x, '\\S'))) > 0.4)::INT",
    "blockquote_density": f"(len(list_filter({_LINES}, lambda x: starts_with(x, '>'))) >= 3)::INT",
    "bold_bullet_list": _n("1{3,}", _FLAGS.format(_quoted(r"^\s*(?:[-*]|\d+[.)])\s+\*\*"))),
    "horizontal_rules": f"({_n('(?m)^\\s*(?:---+|\\*\\*\\*+|___+)\\s*$')} >= 4)::INT",
    "copula_chain": f"(len({_SENTENCES}) >= 6 AND len(list_filter({_SENTENCES}, lambda s: regexp_matches(array_to_string((regexp_split_to_array(s, '\\s+'))[1:6], ' '), '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:is|are|was|were)(?:[^\\p{{L}}\\p{{N}}_]|$)')))::DOUBLE / len({_SENTENCES}) >= 0.5)::INT",
    "extreme_sentence": f"len(list_filter({_SIZES}, lambda n: n >= 140))",
    "closing_aphorism": f"(len({_SENTENCES}) >= 4 AND {' + '.join(f'regexp_matches({_LAST}, {_quoted(p)})::INT' for p in _APHORISMS)} >= 2)::INT",
    "paragraph_balance": f"(len({_PARAGRAPHS}) >= 4 AND list_min(({_PARAGRAPHS})[2:])::DOUBLE / list_max(({_PARAGRAPHS})[2:]) > 0.7)::INT",
    "paragraph_cv": f"(SELECT coalesce(len(x) >= 5 AND list_avg(x) > 0 AND {_VAR} < 0.45, false)::INT FROM (SELECT {_PARAGRAPHS} AS x))",
}

_REUSE = f"""tok AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\s+'), lambda w: lower(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g'))), lambda w: w <> '') AS w FROM d),
g AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM tok, (SELECT unnest([4, 5, 6, 7, 8]) AS n) WHERE len(w) >= n)),
often AS (
  SELECT doc_id, n, array_to_string(g, ' ') AS phrase, count(*) AS c, min(i) AS pos FROM g GROUP BY doc_id, n, g
  HAVING count(*) >= 3 AND len(list_filter(g, lambda x: NOT list_contains({_listed(L.STOPWORDS)}, x))) > 0),
reuse AS (
  SELECT * FROM often a WHERE NOT EXISTS (
    SELECT 1 FROM often b WHERE b.doc_id = a.doc_id AND (b.n > a.n OR (b.n = a.n AND b.pos < a.pos)) AND b.c >= a.c AND contains(b.phrase, a.phrase)))"""

#: Penalty per counted hit of the rules that have only one.
_PENALTY = {r.count_key: abs(r.DEFAULTS["penalty"]) for r in RULE_TYPES if "penalty" in r.DEFAULTS}


def _scored() -> str:
    """CTEs that end in s(doc_id, source, word_count, score, band), for all rules but keyword bold."""
    keys = [r.count_key for r in CORE]
    hits = ", ".join(f"({HITS[k]})::BIGINT AS {k}" for k in keys if k != "phrase_reuse")
    weight = {k: f"{k} * {_PENALTY[k]}" for k in keys if k in _PENALTY}
    weight["structural"] = f"bold * 5 + bruns * 3 + (structural - bold - bruns)"
    weight["tone"] = "(tone - openers) * 3 + openers * 2"
    weight["blockquote_density"] = "CASE WHEN quotes >= 3 THEN least(quotes - 2, 4) * 3 ELSE 0 END"
    for k, cap in (("setup_resolution", 5), ("pithy_fragment", 3)):
        weight[k] = f"least({k}, {cap}) * {_PENALTY[k]}"
    amplified = ("contrast_pairs", "setup_resolution", "pithy_fragment")
    total = " + ".join(f"({weight[k]}) * (CASE WHEN {k} > 1 THEN 1 + 2.5::DOUBLE * ({k} - 1) ELSE 1::DOUBLE END)" if k in amplified else f"({weight[k]})" for k in keys)
    structural = HITS["structural"].split(" + ")
    return f"""WITH {_D}, {_REUSE},
h AS (SELECT doc_id, source, ({_WORDS})::BIGINT AS word_count, {hits}, ({structural[0]})::BIGINT AS bold, ({structural[1]})::BIGINT AS bruns,
  ({_n('(?im)(?:^|[.!?]\\s+)certainly[,! ]')} + {_n('(?im)(?:^|[.!?]\\s+)absolutely[,! ]')})::BIGINT AS openers, len(list_filter({_LINES}, lambda x: starts_with(x, '>'))) AS quotes FROM d),
h2 AS (SELECT h.*, least(5, coalesce(r.k, 0)) AS phrase_reuse FROM h LEFT JOIN (SELECT doc_id, count(*) AS k FROM reuse GROUP BY doc_id) r USING (doc_id)),
w AS (SELECT *, ({total})::DOUBLE AS weighted, ({' + '.join(weight[k] if k not in weight or ' ' not in weight[k] else f'({weight[k]})' for k in keys)})::BIGINT AS penalties FROM h2),
s0 AS (SELECT doc_id, source, word_count, CASE WHEN word_count < 10 THEN 100 ELSE greatest(0, least(100, round_even(100 * exp(-0.04::DOUBLE * (weighted / (word_count / 1000.0::DOUBLE))), 0)::BIGINT)) END::BIGINT AS score FROM w),
s AS (SELECT *, CASE WHEN score >= 80 THEN 'clean' WHEN score >= 60 THEN 'light' WHEN score >= 40 THEN 'moderate' WHEN score >= 20 THEN 'heavy' ELSE 'saturated' END AS band FROM s0)"""


def oracle_sql() -> dict[str, str]:
    found = {f"c{i + 1:02d}_{r.count_key}": f"WITH {_D} SELECT doc_id, ({HITS[r.count_key]})::BIGINT AS hits FROM d" for i, r in enumerate(RULE_TYPES) if r.count_key in HITS}
    s = _scored()
    bands = _listed(["clean", "light", "moderate", "heavy", "saturated"])
    found |= {
        "c19_phrase_reuse": f"WITH {_D}, {_REUSE} SELECT d.doc_id, least(5, count(r.phrase)) AS hits FROM d LEFT JOIN reuse r USING (doc_id) GROUP BY d.doc_id",
        "b01_word_counts": f"WITH {_D} SELECT doc_id, ({_WORDS})::BIGINT AS words, len({_SENTENCES})::BIGINT AS sentences, len({_PARAGRAPHS})::BIGINT AS paragraphs, coalesce(list_max({_SIZES}), 0)::BIGINT AS longest FROM d",
        "b07_reused_phrases": f"WITH {_D}, {_REUSE} SELECT doc_id, phrase, c AS count, n::BIGINT AS n FROM reuse",
        "d08_core_scores": f"{s} SELECT doc_id, score, band, word_count FROM s",
        "h03_band_counts": f"{s} SELECT b.band, count(s.doc_id) AS n FROM (SELECT unnest({bands}) AS band) b LEFT JOIN s USING (band) GROUP BY b.band",
        "h04_histogram": f"{s} SELECT b * 2.0::DOUBLE AS bin_start, (b + 1) * 2.0::DOUBLE AS bin_end, count(s.doc_id) AS n FROM (SELECT unnest(range(50)) AS b) x LEFT JOIN s ON x.b = least(49, floor(s.score / 100.0 * 50)::INT) GROUP BY b",
        "h05_summary": f"{s} SELECT count(*) AS n, round(avg(score), 3) AS mean, round(quantile_cont(score, 0.5), 3) AS median, min(score) AS min, max(score) AS max, round(quantile_cont(score, 0.1), 3) AS p10, round(quantile_cont(score, 0.25), 3) AS p25, round(quantile_cont(score, 0.75), 3) AS p75, round(quantile_cont(score, 0.9), 3) AS p90 FROM s",
        "h06_regression": f"{s} SELECT count(*) AS n, round(regr_slope(score, word_count), 6) AS slope, round(regr_intercept(score, word_count), 6) AS intercept, round(corr(word_count, score), 6) AS correlation FROM s",
        "h08_samples": f"{s} SELECT row_number() OVER (ORDER BY doc_id) AS index, doc_id, score, word_count, band FROM s ORDER BY doc_id LIMIT 25",
        "e10_hit_rates": f"WITH {_D} SELECT l.quality AS label, count(*) FILTER (WHERE ({HITS['slop_words']}) > 0) AS matched, count(*) AS total FROM d JOIN labels l USING (doc_id) GROUP BY l.quality",
        "a07_code_views": f"WITH {_M}, u AS (SELECT doc_id, t, regexp_replace(t, '```[^`]*```\\n?', '', 'g') AS f FROM d) SELECT doc_id, {_n(r'[^\s]+', "regexp_replace(f, '`+[^`]+`+', ' ', 'g')")}::BIGINT AS words, length(f)::BIGINT AS chars, {_n('```[^`]*```', 't')}::BIGINT AS fences FROM u",
        "b04_plain_sentences": f"WITH {_M.replace('d AS (', 'm AS (', 1)}, d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '```[^`]*```\\n?', chr(10) || '.' || chr(10), 'g'), '(?:\\|[^\\n]*\\|\\n){{4}}', '.' || chr(10), 'g') AS t FROM m) SELECT doc_id, len({_SENTENCES})::BIGINT AS sentences, list_max({_SIZES})::BIGINT AS longest FROM d",
        "b12_named_words": f"WITH {_M.replace('d AS (', 'm AS (', 1)}, d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '```[^`]*```|`+[^`]+`+', ' ', 'g'), '(?:Crucial|Robust) [A-Z][a-z]+', ' ', 'g') AS t FROM m) SELECT doc_id, ({HITS['slop_words']})::BIGINT AS hits FROM d",
        "b23_bold_keywords": f"WITH {_M} SELECT doc_id, {_n('[a-z] [*][*][^*\\n]+[*][*] [a-z]')}::BIGINT AS hits FROM d",
        "d16_payload_numbers": f"{s}, z AS (SELECT *, CASE WHEN word_count < 10 THEN 0 ELSE penalties END AS p, CASE WHEN word_count < 10 THEN 0 ELSE weighted END AS x FROM w) SELECT doc_id, -p::BIGINT AS total_penalty, round_even(x, 2) AS weighted_sum, CASE WHEN word_count > 0 THEN round_even(x / (word_count / 1000.0::DOUBLE), 2) ELSE 0::DOUBLE END AS density FROM z",
        "h10_slowest_at_longest": "SELECT l_returnflag, round(avg(l_extendedprice::DOUBLE), 4) AS mean_price FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem) GROUP BY l_returnflag ORDER BY avg(l_extendedprice::DOUBLE) DESC, l_returnflag LIMIT 2",
        "h11_changed": "SELECT d.source AS key, count(*) AS before, nullif(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)), 0) AS after FROM documents d GROUP BY d.source HAVING before IS DISTINCT FROM after",
        "h12_non_text": "SELECT count(text) AS kept, count(*) - count(text) AS dropped FROM documents",
        "h09_mean_by_source": f"{s} SELECT source, round(avg(score), 6) AS mean_score FROM s GROUP BY source",
    }
    return found
