"""Document views: what the rules read, as columns derived from a text column.

Views are plain expressions. materialise() puts them into projections of their own and holds them there, so that a plan
computes each once, however many rules or lambdas read it; those that no rule asks for don't appear in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import BOLD_BULLET, BULLET, NS, SENTENCE_END, SIGN, SP, WS, WS_IN_LINE, W

_FENCE = rf"(?<=(?:\A|\n)[{WS_IN_LINE}]{{0,3}})(`{{3,}}+)(?:[^\n]*\n(?:[\s\S]*?\n)?? {{0,3}}\1`*[{WS_IN_LINE}]*(?:\n|\z)|[\s\S]*\z)"
_INLINE = r"(?<!`)(`++)[^\n]*?(?<!`)\2(?!`)"
CODE_TOKENS = f"{_FENCE}|{_INLINE}|`+|[^`]+"


def held(x: Column) -> Column:
    """x, computed where it stands: the optimizer moves no expression that isn't deterministic into filters, lambdas or later projections, where it would run again and again."""
    return F.when(F.spark_partition_id() >= 0, x)


def word_count(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.regexp_count(text, F.lit(f"{NS}+"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SP}+|{SP}+\z", "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END, -1), strip), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, rf"\n{SP}*\n", -1), lambda p: F.regexp_like(p, F.lit(f"{NS}")))


def counts_of(parts: Column) -> Column:
    return F.transform(parts, word_count)


def bare_words(text: Column) -> Column:
    """The text without the signs at its words' ends."""
    return F.regexp_replace(text, rf"(?={SIGN})(?:(?<!{NS}){SIGN}++|(?<={W}){SIGN}++(?!{NS}))", "")


def ngram_tokens(text: Column) -> Column:
    """Words without the signs at their ends, in lower case."""
    return lower_words(bare_words(text))


def lower_words(bare: Column) -> Column:
    # A capital sigma's lower case depends on where its word ends.
    lower = F.lower(bare)
    each = F.transform(F.split(bare, f"{SP}+"), F.lower)
    return F.filter(F.when(F.contains(bare, F.lit("Σ")), each).otherwise(F.split(lower, f"{SP}+")), lambda t: t != "")


def code_tokens(text: Column) -> Column:
    """The text in pieces: struct(t, fence, code). A fence runs to its closer or to the end; other runs of backticks pair up on their line."""
    tokens = F.regexp_extract_all(text, F.lit(CODE_TOKENS), F.lit(0))
    n = F.length(text)

    def piece(t: Column) -> Column:
        ticks = F.startswith(t, F.lit("```"))
        # A fence without a line end can only be the last piece, and begins a line.
        alone = ticks & F.endswith(text, t) & F.regexp_like(F.substring(text, F.lit(1), n - F.length(t)), F.lit(rf"(?:\A|\n)[{WS_IN_LINE}]{{0,3}}\z"))
        fence = ticks & (F.contains(t, F.lit("\n")) | alone)
        return F.struct(t.alias("t"), fence.alias("fence"), (fence | F.regexp_like(t, F.lit(r"^`+[^`]"))).alias("code"))

    return F.transform(tokens, piece)


def _with_code(text: Column, tokens: Column, piece) -> Column:
    return F.when(F.contains(text, F.lit("`")), F.array_join(F.transform(tokens, piece), "")).otherwise(text)


def table_breaks(text: Column) -> Column:
    """Each pipe table becomes one line with a full stop."""
    lines = F.split(text, "\n", -1)

    def cells(line: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+\z", ""), r"\|", -1), strip)

    def row(line: Column) -> Column:
        c = cells(line)
        return F.contains(line, F.lit("|")) & (F.size(c) >= 2) & F.exists(c, lambda x: x != "")

    def delimiter(line: Column) -> Column:
        c = cells(line)
        return F.contains(line, F.lit("|")) & (F.size(c) >= 2) & F.forall(c, lambda x: F.regexp_like(x, F.lit(r"^:?-{3,}:?$")))

    kinds = F.transform(lines, lambda x: F.struct(x.alias("x"), row(x).alias("row"), delimiter(x).alias("delim")))
    pairs = F.zip_with(kinds, F.concat(F.slice(kinds, 2, F.greatest(F.size(kinds) - 1, F.lit(0))), F.array(F.struct(F.lit("").alias("x"), F.lit(False).alias("row"), F.lit(False).alias("delim")))), lambda a, b: F.struct(a["x"].alias("x"), a["row"].alias("row"), (a["row"] & b["delim"]).alias("head")))
    # State: 0 in prose, 1 before a delimiter row, 2 in a table's body.
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        prose = F.struct(F.lit(0).alias("s"), F.concat(acc["out"], F.array(p["x"])).alias("out"))
        head = F.struct(F.lit(1).alias("s"), F.concat(acc["out"], F.array(F.lit("."))).alias("out"))
        body = F.struct(F.lit(2).alias("s"), acc["out"].alias("out"))
        return F.when(acc["s"] == 1, body).when((acc["s"] == 2) & p["row"], body).when(p["head"], head).otherwise(prose)

    folded = F.aggregate(pairs, start, step, lambda acc: F.array_join(acc["out"], "\n"))
    return F.when(may_hold_table(text), folded).otherwise(text)


def may_hold_table(text: Column) -> Column:
    """A line with a bar before one with three dashes."""
    return F.contains(text, F.lit("|")) & F.contains(text, F.lit("---")) & F.regexp_like(text, F.lit(r"\|[^\n]*+\n[^\n]*?---"))


def broken_up(text: Column) -> Column:
    """Whether fences or tables may break its sentences."""
    return F.contains(text, F.lit("`")) | may_hold_table(text)


#: name -> (what it is read from, expression)
VIEWS = {
    "v_tokens": (("v_text",), lambda: F.when(F.contains("v_text", F.lit("`")), code_tokens(F.col("v_text")))),
    "v_masked": (("v_text", "v_tokens"), lambda: _with_code(F.col("v_text"), F.col("v_tokens"), lambda x: F.when(x["code"], F.regexp_replace(x["t"], r"[^\n]", " ")).otherwise(x["t"]))),
    "v_unfenced": (("v_text", "v_tokens"), lambda: _with_code(F.col("v_text"), F.col("v_tokens"), lambda x: F.when(x["fence"], F.lit("")).otherwise(x["t"]))),
    "v_broken": (("v_text", "v_tokens"), lambda: _with_code(F.col("v_text"), F.col("v_tokens"), lambda x: F.when(x["fence"], F.lit("\n.\n")).otherwise(x["t"]))),
    "v_words": (("v_masked",), lambda: word_count(F.col("v_masked"))),
    "v_lower": (("v_text",), lambda: F.lower("v_text")),
    "v_lines": (("v_text",), lambda: F.split("v_text", "\n", -1)),
    "v_bullets": (("v_lines",), lambda: F.transform("v_lines", lambda x: F.when(F.regexp_like(x, F.lit(BULLET)), "1").otherwise("0"))),
    "v_bold_bullets": (("v_lines",), lambda: F.transform("v_lines", lambda x: F.when(F.regexp_like(x, F.lit(BOLD_BULLET)), "1").otherwise("0"))),
    "v_sentences": (("v_text",), lambda: sentences(F.col("v_text"))),
    "v_sentence_words": (("v_sentences",), lambda: counts_of(F.col("v_sentences"))),
    "v_plain_sentences": (("v_text", "v_broken", "v_sentences"), lambda: F.when(broken_up(F.col("v_text")), sentences(table_breaks(F.col("v_broken")))).otherwise(F.col("v_sentences"))),
    "v_plain_sentence_words": (("v_text", "v_plain_sentences", "v_sentence_words"), lambda: F.when(broken_up(F.col("v_text")), counts_of(F.col("v_plain_sentences"))).otherwise(F.col("v_sentence_words"))),
    "v_paragraph_words": (("v_text",), lambda: counts_of(paragraphs(F.col("v_text")))),
    "v_bare": (("v_text",), lambda: bare_words(F.col("v_text"))),
    "v_ngrams": (("v_bare",), lambda: lower_words(F.col("v_bare"))),
}


def materialise(df: DataFrame, names: set[str]) -> DataFrame:
    """Adds the views named and those that they are read from, level by level."""
    todo = set()

    def need(name: str) -> None:
        if name in VIEWS and name not in todo:
            todo.add(name)
            for x in VIEWS[name][0]:
                need(x)

    for name in names:
        need(name)
    done = {"v_text"}
    while todo:
        level = sorted(n for n in todo if all(x in done for x in VIEWS[n][0]))
        df = df.withColumns({n: held(VIEWS[n][1]()) for n in level})
        done |= set(level)
        todo -= set(level)
    return df
