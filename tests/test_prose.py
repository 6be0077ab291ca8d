"""The analysis over small texts, each made to show one thing."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from verbascope.operators.rules import RULE_TYPES, default_rules
from verbascope.plans import analytics, phrases, resolve
from verbascope.plans.analysis import Hyperparameters, analyze, score
from verbascope.sources import readers, sinks

PAD = " plain words that say nothing at all stand here for length"
#: counter -> (text in which it counts, how often, text in which it doesn't)
CASES = {
    "slop_words": ("They delve into a crucial matter with a game-changing plan." + PAD, 3, "They met Grace Robust and the Robust Systems team. ```crucial``` words." + PAD),
    "slop_phrases": ("It's worth noting that we adapt, and not just now, but also later." + PAD, 2, "It is noted that we stay." + PAD),
    "structural": ("**One.** Go on. **Two:** Go on. **Three.** Go on. Red, green, and blue." + PAD, 2, "**One.** Go on. Red and green." + PAD),
    "tone": ("Certainly! It works. Let me know if it fails." + PAD, 2, "It certainly works." + PAD),
    "weasel": ("Many believe it and studies show it." + PAD, 2, "Few believe it." + PAD),
    "ai_disclosure": ("As an AI I stop. As of my last cutoff, I'm just an AI." + PAD, 3, "As a person I go on." + PAD),
    "placeholder": ("Write to [insert name] and [todo]." + PAD, 2, "Write to [name]." + PAD),
    "rhythm": ("One two three four. " * 6, 1, "One. Two three four five six seven. Eight nine. Ten one two three four five six. Done now then."),
    "em_dash": ("It moved — slowly — on." + PAD, 1, "It moved on." + PAD),
    "contrast_pairs": ("Choose speed, not luck. Not only did it run but it also won." + PAD, 2, "Choose speed over luck." + PAD),
    "intrasentence_keyword_bold": ("The plan has a **very bold** word in it." + PAD, 1, "**Bold** begins this. It costs **40%** of it. `a **b** c`" + PAD),
    "setup_resolution": ("This isn't about speed. It's about trust." + PAD, 1, "This is about speed." + PAD),
    "colon_density": ("Note: this matters: always here." + PAD, 1, "See https: here: true." + PAD),
    "pithy_fragment": ("Short, but sweet." + PAD, 1, "It was short, but it went on and on." + PAD),
    "bullet_density": ("- one two three\n- four five six\n- seven eight nine\nlast line here", 1, "one\ntwo\n- three\nfour five six seven eight nine ten"),
    "blockquote_density": ("> one\n> two\n> three\n" + PAD, 1, "```\n> one\n> two\n> three\n```\n" + PAD),
    "bold_bullet_list": ("- **A** x\n- **B** y\n- **C** z\n" + PAD, 1, "- **A** x\n- **B** y\n- plain\n" + PAD),
    "horizontal_rules": ("a\n---\nb\n***\nc\n___\nd\n---\n" + PAD, 1, "a\n---\nb\n---\n" + PAD),
    "phrase_reuse": ("the quick red fox ran. the quick red fox sat. the quick red fox hid." + PAD, 1, "the quick red fox ran." + PAD),
    "copula_chain": ("It is one. It was two. They are three. It is four. It was five. It is six." + PAD, 1, "We ran. We sat. We hid. We ate. We won. We left." + PAD),
    "extreme_sentence": ("word " * 140, 1, "```\n" + "word " * 150 + "\n```\n" + PAD),
    "closing_aphorism": ("We ran home now. We sat. We ate. In the end, we build what lasts.", 1, "We ran home now. We sat. We ate. Then we went to sleep in our beds."),
    "paragraph_balance": ("\n\n".join(["one two three four five"] * 5), 1, "one two\n\nthree\n\nfour five six seven eight nine\n\nten"),
    "paragraph_cv": ("\n\n".join(["one two three four five"] * 5), 1, "one\n\ntwo three four five six seven\n\neight\n\nnine ten one two three four five\n\nsix"),
}


@pytest.fixture(scope="module")
def payloads(spark):
    rows = [(k, side, c[0] if side else c[2]) for k, c in CASES.items() for side in (1, 0)]
    rows += [("short", 1, "too short"), ("null", 1, None), ("empty", 1, ""), ("code", 1, "Here is `inline crucial` text.\n```\ncrucial fence\n```\nA crucial word ends it now, in prose.")]
    df = spark.createDataFrame(rows, "name string, side int, text string").coalesce(2)
    return {(r.name, r.side): r for r in analyze(df).collect()}


def test_every_rule_fires_and_rests(payloads):
    assert {r.count_key for r in RULE_TYPES} == CASES.keys()
    for key, (_, n, _) in CASES.items():
        assert (key, payloads[key, 1].counts[key]) == (key, n)
        assert (key, payloads[key, 0].counts[key]) == (key, 0)


def test_payload_of_special_texts(payloads):
    r = payloads["short", 1]
    assert (r.score, r.band, r.word_count, r.violations, set(r.counts.values()), r.advice) == (100, "clean", 2, [], {0}, [])
    r = payloads["null", 1]
    assert all(r[c] is None for c in ("score", "band", "word_count", "violations", "counts", "advice"))
    assert payloads["empty", 1].score == 100
    r = payloads["code", 1]
    assert r.word_count == 11 and [r.text[v.start : v.end] for v in r.violations if v.rule == "slop_word"] == ["crucial"] and r.violations[0].start == r.text.rindex("crucial")


def test_spans_scores_and_advice(payloads):
    for r in payloads.values():
        if r.text is None:
            continue
        assert all(0 <= v.start <= v.end <= len(r.text) for v in r.violations)
        assert r.total_penalty == sum(v.penalty for v in r.violations) and len(r.advice) == len(set(r.advice))
        weight = 0.0
        for v in r.violations:
            key = next((k for k in (v.rule, v.rule + "s") if k in Hyperparameters().amplified), None)
            c = r.counts.get(key, 0) if key else 0
            weight += abs(v.penalty) * (1 + 2.5 * (c - 1) if c > 1 else 1)
        assert weight == r.weighted_sum
    v = next(v for v in payloads["bullet_density", 1].violations if v.rule == "bullet_density")
    assert (v.start, v.end) == (0, len(CASES["bullet_density"][0]))


def test_score_alone_agrees(spark, payloads):
    df = spark.createDataFrame([(*k, r.text) for k, r in payloads.items()], "name string, side int, text string").coalesce(2)
    got = {(r.name, r.side): (r.score, r.band, r.word_count) for r in score(df).collect()}
    assert got == {k: (r.score, r.band, r.word_count) for k, r in payloads.items()}


def test_reports(spark):
    df = spark.createDataFrame([(i, s, 10 * i, "clean" if s >= 80 else "light", "x") for i, s in enumerate([100, 90, 61, 80, 60])] + [(9, None, None, None, "x")], "id int, score int, word_count int, band string, k string")
    assert {r.band: r.n for r in analytics.band_counts(df).collect()} == {"clean": 3, "light": 2, "moderate": 0, "heavy": 0, "saturated": 0}
    bins = {r.bin_start: r.n for r in analytics.histogram(df, 10).collect()}
    assert bins == {0: 0, 10: 0, 20: 0, 30: 0, 40: 0, 50: 0, 60: 2, 70: 0, 80: 1, 90: 2}
    r = analytics.summary(df).first()
    assert (r.n, r["mean"], r["median"], r["min"], r["max"]) == (5, 78.2, 80.0, 60, 100)
    r = analytics.regression(df.limit(1)).first()
    assert (r.slope, r.intercept, r.correlation) == (0.0, 100.0, None)
    assert [(r["index"], r.id) for r in analytics.samples(df, "id", 2).collect()] == [(1, 0), (2, 1)]
    assert analytics.non_text(df.selectExpr("band text")).first().asDict() == {"kept": 5, "dropped": 1}
    a, b = (spark.createDataFrame(x, "key string, value string") for x in ([("p", "1"), ("q", "2")], [("p", "1"), ("q", "3"), ("r", "4")]))
    assert sorted((r.key, r.before, r.after) for r in analytics.changed(a, b).collect()) == [("q", "2", "3"), ("r", None, "4")]


def test_repeated_phrases_relational_and_in_row_agree(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "of", "fox", "ran", "Sat,", "hid"]) for _ in range(60)) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {}
    for r in phrases.repeated_phrases(df, "id", "text").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.phrase, r["count"], r.n))
    clean = lambda t: [w for w in (re.sub(r"^\W+|\W+$", "", x).lower() for x in t.split()) if w]
    want = {i: phrases.maximal_repeats(clean(t), 4, 8, 3) for i, t in enumerate(texts)}
    assert got == {i: x for i, x in want.items() if x}


def test_places_prefer_unused():
    text = "red fox. red fox. end"
    v = {"rule": "r", "match": "red fox", "context": resolve.snippet(text, 0, 7, 60), "penalty": -1, "start": None, "end": None}
    assert [(x["start"], x["end"]) for x in resolve.places(text, [v, v, v], 60)] == [(0, 7), (9, 16), (0, 7)]


def test_rules_file_round_trip(tmp_path):
    rules = default_rules()
    rules[0].config["penalty"] = -7
    path = str(tmp_path / "rules.jsonl")
    readers.save_rules(rules, path)
    back = readers.load_rules(path)
    assert [(r.rule_type, r.config) for r in back] == [(r.rule_type, r.config) for r in rules]
    for bad, error in (("", ValueError), ("{", ValueError), ("[]", TypeError), ('{"rule_type": "NoRule", "config": {}}', ValueError), ('{"rule_type": "RhythmRule", "config": {"x": 1}}', TypeError)):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(error):
            readers.load_rules(str(tmp_path / "bad.jsonl"))


def test_labelled_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "label": 0}\n\n{"text": "y"}\n')
    (tmp_path / "b.md").write_text("whole\nfile")
    paths = readers.expand([str(tmp_path / "*.jsonl"), str(tmp_path / "b.md")])
    assert sorted(map(tuple, readers.labelled(spark, paths).collect())) == [("whole\nfile", 1), ("x", 0), ("y", 1)]
    assert {r.label for r in readers.labelled(spark, paths, force_label=0).collect()} == {0}
    (tmp_path / "c.jsonl").write_text('{"text": "x", "label": true}\n')
    with pytest.raises(Exception, match="label"):
        readers.labelled(spark, [str(tmp_path / "c.jsonl")]).collect()
    with pytest.raises(FileNotFoundError):
        readers.expand([str(tmp_path / "*.none")])


def test_sinks(payloads, spark):
    df = spark.createDataFrame([("a", 90, "clean", 12, {"tone": 2, "weasel": 0})], "source string, score int, band string, word_count int, counts map<string,int>")
    assert df.select(sinks.summary_line("source")).first()[0] == "a: 90/100 [clean] (12 words) ."
    assert df.select(sinks.summary_line("source", True)).first()[0] == "a: 90/100 [clean] (12 words) .  (tone=2)"
    assert json.loads(sinks.as_json(df).first()[0])["score"] == 90
    assert sinks.any_below(df, 91) and not sinks.any_below(df, 90)


def test_hits_are_found_once(spark):
    """A rule's pattern stands in the plan for counting and for one search (three expressions), and the text is bared once."""
    from verbascope.functions import patterns as P

    df = spark.createDataFrame([("a", "b")], "id string, text string")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000000")
    try:
        plan = analyze(df).select("violations", "advice")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert 0 < plan.count(P.X_NOT_Y) <= 4
    assert plan.count("AS v_bare") == 1


def test_signs_at_word_ends(spark):
    """The tokens of random texts against their definition, word by word."""
    from verbascope.functions.views import ngram_tokens

    rng = random.Random(8)
    texts = ["".join(rng.choices("aZé9_.'—!Σσ\u0301\u2003 \n\x1c", k=rng.randrange(40))) for _ in range(400)]

    def plain(text):
        words = [re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in text.split()]
        return [w.lower() for w in words if w]

    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", ngram_tokens(F.col("text")).alias("t")).collect()
    assert {r.i: r.t for r in found} == {i: plain(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["d15_payload", "d10_advice"])
def test_one_row_group_is_read_by_many_tasks(spark, tmp_path, name):
    """A table whose rows are all in one group of one file is analysed by more than one task."""
    import __spark_entry__ as entry

    spark.range(40).selectExpr("id AS doc_id", "'x' AS source", "concat('Many believe in plan ', id, '.') AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join so few rows again
    try:
        found = entry.queries()[name](spark, str(tmp_path))
        assert found.select("doc_id", F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0] > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
