"""Command lines, readers, sinks, streams and the small report operators."""

import json

import pytest
from pyspark.sql import functions as F

from verbascope import cli
from verbascope.functions.numbers import exact_round
from verbascope.operators.rules import ContrastPair, SlopWord
from verbascope.plans import analytics
from verbascope.plans.analysis import analyze
from verbascope.sources import readers, sinks, synthetic

PLAIN = "The river was cold that day. We walked along the bank and counted boats until it got dark, then went home by bus."
SLOPPY = "It is a crucial and robust landscape, and they delve into a seamless journey. Choose speed, not luck. Take care, not risk."


@pytest.fixture
def few_rules(tmp_path):
    path = tmp_path / "rules.jsonl"
    readers.save_rules([SlopWord(), ContrastPair()], str(path))
    return str(path)


def test_scores_inputs(spark, tmp_path, capsys, few_rules):
    file = tmp_path / "plain.txt"
    file.write_text(PLAIN, encoding="utf-8")
    assert cli.main(["-c", few_rules, "--counts", "-v", str(file), SLOPPY, "missing.txt"]) == 0
    out, err = capsys.readouterr()
    lines = out.splitlines()
    assert lines[0] == f"{file}: 100/100 [clean] (23 words) ." and lines[1].startswith("<text:2>: ") and "missing.txt: No such file" in err
    assert "(slop_words=" in lines[1] and "contrast_pairs=2)" in lines[1] and any(x.startswith("  slop_word: crucial (-2)  ") for x in lines)
    assert any("slogans of one thing, not another" in x for x in lines)
    assert cli.main(["-c", few_rules, "-q", "-s", "-t", "90", PLAIN, SLOPPY]) == 1
    assert len(capsys.readouterr().out.splitlines()) == 1
    assert cli.main(["-c", few_rules, "-j", SLOPPY]) == 0
    payload = json.loads(capsys.readouterr().out)
    assert payload["source"] == SLOPPY and all(SLOPPY[v["start"] : v["end"]].lower() == v["match"].lower() for v in payload["violations"])
    assert set(payload) == {"source", "score", "band", "word_count", "violations", "counts", "total_penalty", "weighted_sum", "density", "advice"}


def test_refuses_what_it_cannot_use(tmp_path, capsys):
    assert cli.main([""]) == 2 and "input 1 is empty" in capsys.readouterr().err
    assert cli.main(["nowhere.txt"]) == 2 and cli.main(["-c", str(tmp_path), "a b"]) == 2
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert capsys.readouterr().out.strip()
    assert cli.main(["fit", "only-one"]) == 2 and "CORPUS OUTPUT" in capsys.readouterr().err
    assert cli.main(["fit", str(tmp_path / "*.jsonl"), "out"]) == 2 and "no file matches" in capsys.readouterr().err
    for bad in ("", str(tmp_path), str(tmp_path / "none")):
        with pytest.raises(readers.UnreadableFile):
            readers.tool_file(bad)


def test_fits_from_files(spark, tmp_path, capsys, few_rules):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"text": f"{PLAIN} {i}"}) + "\n" for i in range(3)), encoding="utf-8")
    (tmp_path / "b.md").write_text(PLAIN, encoding="utf-8")
    (tmp_path / "n.txt").write_text(SLOPPY, encoding="utf-8")
    out = tmp_path / "fitted.jsonl"
    assert cli.main(["fit", "--init", few_rules, "--output", str(out), "--negative-dataset", str(tmp_path / "n.txt"), "--no-calibration", str(tmp_path / "a*.jsonl"), str(tmp_path / "b.md")]) == 0
    assert "fitted 5 samples (positive=4, negative=1) from 2 train files and 1 negative files" in capsys.readouterr().out
    assert [r.rule_type for r in readers.load_rules(str(out))] == ["SlopWordRule", "ContrastPairRule"]
    assert cli.main(["fit", few_rules, str(out)]) == 2 and "text must be a string" in capsys.readouterr().err


def test_reports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "n int, x double")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.report_csv(spark, str(tmp_path / "c"), "n int, x double").collect())) == [(1, 0.5), (2, 1.5)]
    times = spark.createDataFrame([("A", "word", 10, 0, 1.0), ("B", "word", 10, 0, 3.0), ("B", "word", 5, 0, 9.0)], "rule string, level string, word_count int, run int, time_ms double")
    sinks.write_json(times, str(tmp_path / "t"))
    again = readers.timings(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in analytics.slowest_at_longest(again, "rule", "word_count", "time_ms", 1).collect()] == [("B", 3.0)]
    with pytest.raises(ValueError):
        readers.timings(spark, str(tmp_path / "c"))
    pairs = lambda *x: spark.createDataFrame(list(x), "key string, value int")
    assert sorted(map(tuple, analytics.changed(pairs(("a", 1), ("b", 2), ("c", None)), pairs(("a", 1), ("b", 3), ("c", None), ("d", 4))).collect())) == [("b", 2, 3), ("d", None, 4)]
    assert tuple(analytics.non_text(spark.createDataFrame([("x",), (None,)], "text string")).first()) == (1, 1)
    df.write.parquet(str(tmp_path / "p"))
    assert readers.parquet_first(spark, str(tmp_path / "p"), 1, "x").count() == 1
    with pytest.raises(ValueError):
        readers.parquet_first(spark, str(tmp_path / "p"))


def test_synthetic_texts_and_timings(spark):
    assert synthetic.lengths(1, 4) == [1, 2, 3, 4] and synthetic.lengths(1, 100, "log", 3) == [1, 10, 100] and synthetic.lengths(10, 30, "linear", 3) == [10, 20, 30]
    rows = synthetic.texts(spark, [1, 12, 130]).collect()
    assert [len(r.text.split()) for r in rows] == [1, 12, 130] and rows[2].text.count("\n\n") == 2 and all(r.text.endswith(".") for r in rows)
    assert synthetic.time_rules(spark, [12], [SlopWord()], repeats=2, warm_up=0).where("time_ms > 0 and word_count = 12").count() == 2


def test_rounds_by_exact_values(spark):
    values = [k / 8 for k in range(60)] + [k / 1000 for k in range(0, 9000, 5)] + [1.115, 2.675, 1.005, 0.285]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert all(r.y == round(r.x, 2) for r in df.select("x", exact_round(F.col("x"), 2).alias("y")).collect())


def test_code_and_bold_places(spark):
    text = "A plain line with **key** inside, and `**code**` too.\n\n**Label.** Text that follows.\n- a **bold** item\n> a **quoted** one\n\nIt said so. **Begin** here, and then **one** more with `crucial` code but crucial prose, **12%** up.\n```\ncrucial **fenced**\n```\n"
    from verbascope.operators.rules import KeywordBold

    got = analyze(spark.createDataFrame([(text,)], "text string"), "text", [SlopWord(), KeywordBold()]).first()
    found = [(v.rule, v.match, text[v.start : v.end]) for v in got.violations]
    assert found == [("slop_word", "crucial", "crucial"), ("intrasentence_keyword_bold", "**key**", "**key**"), ("intrasentence_keyword_bold", "**one**", "**one**")]
    assert got.violations[0].start == text.index("crucial prose")
    named = analyze(spark.createDataFrame([("We met Crucial Jones and the Crucial Band at a crucial time in the old town hall.",)], "text string"), "text", [SlopWord()]).first()
    assert [v.start for v in named.violations] == [47]


def test_streams_score_like_tables(spark, tmp_path):
    from verbascope.streaming import scores

    spark.createDataFrame([(PLAIN,), (SLOPPY,), (None,)], "text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    query = scores.scored_stream(source, rules=[SlopWord(), ContrastPair()]).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.text, r.band) for r in spark.table("scored").collect()} >= {(PLAIN, "clean"), (None, None)}
