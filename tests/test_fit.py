"""Fitting: the arithmetic, and a corpus whose cohorts differ in known ways."""

import math

from verbascope.plans import fit as fitting


def test_arithmetic():
    assert fitting.blend(4.0, 8.0, 12) == 6.0 and fitting.blend(4.0, 8.0, 0) == 4.0
    assert fitting.penalty_by_support(-4, 0, 10) == -6 and fitting.penalty_by_support(-4, 10, 10) == -2 and fitting.penalty_by_support(-4, 0, 0) == -4
    assert fitting.fitted_penalty(-4, (5, 10), (5, 10)) == 0 and fitting.fitted_penalty(-4, (0, 10), (10, 10)) < -6
    assert fitting.scaled({"penalty": -5, "x_penalty": -1, "cap": 4, "rate": 0.5}, 0.5) == {"penalty": -2, "x_penalty": -1, "cap": 4, "rate": 0.5}
    assert fitting.scaled({"penalty": -5, "penalty_step": -3}, 0.0) == {"penalty": 0, "penalty_step": 0}


def test_threshold_and_cap(spark):
    rows = [(True, float(i % 3)) for i in range(30)] + [(False, float(5 + i % 4)) for i in range(30)]
    values = fitting.Values(spark.createDataFrame(rows, "pos boolean, x double"))
    assert values.percentiles([(True, 0.5), (False, 1.0), (None, 0.0)]) == [1.0, 8.0, 0.0]
    t = fitting.threshold(values, 1.0, 0.0, 100.0, 0.9, 0.1, 18, "gt")
    assert 1.0 < t < 5.0
    assert fitting.cap(values, 3, 1, 64, 0.9, 0.75, 18) > 3
    same = fitting.Values(spark.createDataFrame([(True, 1.0), (False, 1.0)], "pos boolean, x double"))
    assert fitting.threshold(same, 0.7, 0.0, 1.0, 0.9, 0.1, 18, "gt") == 0.7
    none = fitting.Values(spark.createDataFrame([(False, 1.0)], "pos boolean, x double"))
    assert fitting.threshold(none, 3.0, 0.0, 1.0, 0.9, 0.1, 18, "ge") == 1.0 and math.isclose(fitting.cap(none, 5, 1, 4, 0.9, 0.9, 20), 4)


def test_fit_corpus(spark):
    good = "They walked along the river and talked about the weather for a while. Nobody was in a hurry. The boats passed."
    bad = "It is a crucial and robust landscape. Many believe it. - yes -- no -- maybe -- so it goes on and on here."
    rows = [(good, 1)] * 6 + [(bad, 0)] * 6 + [(None, 1), (good, None)]
    got = {r.rule_type: r.config for r in fitting.fit(spark.createDataFrame(rows, "text string, label int").coalesce(2))}
    assert got["SlopWordRule"]["penalty"] < -2 and got["WeaselPhraseRule"]["penalty"] < -2
    assert got["AIDisclosureRule"]["penalty"] == 0 and got["PlaceholderRule"]["penalty"] == 0
    assert len(got) == 24
