"""Synthetic texts of given lengths, and the time that each rule takes over them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Rule, default_rules
from ..plans.analysis import prepared

WORDS = ("river", "table", "window", "quiet", "market", "seven", "paper", "garden", "engine", "letter", "winter", "signal", "because", "under", "carry", "often")
SENTENCE, PARAGRAPH = 12, 5


def lengths(least: int, most: int, mode: str = "all", points: int = 80) -> list[int]:
    """Numbers of words: every one, or so many in even steps or in even ratios."""
    if least < 1 or most < least:
        raise ValueError("lengths must run from 1 or more upwards")
    if mode == "all":
        return list(range(least, most + 1))
    if mode not in ("linear", "log"):
        raise ValueError(f"unknown mode {mode!r}")
    at = [k / max(1, points - 1) for k in range(points)]
    return sorted({round(least + (most - least) * x) if mode == "linear" else round(least * (most / least) ** x) for x in at})


def texts(spark: SparkSession, sizes: list[int], seed: int = 7) -> DataFrame:
    """word_count, text: words chosen by a hash of the seed and their place, in sentences of twelve and paragraphs of five sentences."""
    place = F.sequence(F.lit(0), F.col("word_count") - 1)
    vocabulary = F.array(*map(F.lit, WORDS))

    def written(i):
        word = F.element_at(vocabulary, (F.pmod(F.xxhash64(F.lit(seed), i), F.lit(len(WORDS))) + 1).cast("int"))
        last = i == F.col("word_count") - 1
        ends = last | (i % SENTENCE == SENTENCE - 1)
        gap = F.when(last, "").when(i % (SENTENCE * PARAGRAPH) == SENTENCE * PARAGRAPH - 1, "\n\n").otherwise(" ")
        return F.concat(F.when(i % SENTENCE == 0, F.initcap(word)).otherwise(word), F.when(ends, ".").otherwise(""), gap)

    rows = spark.createDataFrame([(n,) for n in sizes], "word_count int")
    return rows.select("word_count", F.array_join(F.transform(place, written), "").alias("text"))


def time_rules(spark: SparkSession, sizes: list[int], rules: list[Rule] | None = None, repeats: int = 3, warm_up: int = 1, seed: int = 7) -> DataFrame:
    """rule, level, word_count, run, time_ms: each rule's count over a text of each length, whole jobs timed on the driver."""
    found = []
    for n in sizes:
        text = texts(spark, [n], seed).cache()
        text.count()
        for rule in rules or default_rules():
            counted = prepared(text, "text", [rule]).select(F.coalesce(rule.delta(), F.lit(0)).alias("hits"))
            for run in range(-warm_up, repeats):
                began = time.perf_counter()
                counted.collect()
                if run >= 0:
                    found.append((rule.rule_type, rule.level, n, run, (time.perf_counter() - began) * 1000))
        text.unpersist()
    return spark.createDataFrame(found, "rule string, level string, word_count int, run int, time_ms double")
