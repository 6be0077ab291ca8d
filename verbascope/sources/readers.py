"""Reading corpora and settings."""

from __future__ import annotations

import glob
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import BY_NAME, Rule


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Inline strings: source, text."""
    return spark.createDataFrame([(t, t) for t in texts], "source string, text string")


def text_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files as documents: source, text. A file that isn't UTF-8 stops the query."""
    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    return raw.select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"), F.is_valid_utf8(F.col("content").cast("string")).alias("_ok")).select(
        "source", F.when(F.col("_ok"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("source")))).alias("text")
    )


def parquet_first(spark: SparkSession, path: str, first: int | None = None, text_col: str = "text") -> DataFrame:
    """The text column of a shard, or of its first rows; a missing column is an error."""
    df = spark.read.parquet(path)
    if text_col not in df.columns:
        raise ValueError(f"{path} has no column {text_col!r}; it has {', '.join(df.columns)}")
    df = df.select(F.col(text_col).alias("text"))
    return df if first is None else df.limit(first)


def labelled(spark: SparkSession, paths: list[str], default_label: int = 1, force_label: int | None = None) -> DataFrame:
    """text, label from .jsonl (rows {"text", "label"?: 0 or 1}), .txt and .md files (one row each). Other suffixes and invalid rows are errors."""
    parts = []
    for path in paths:
        suffix = Path(path).suffix.lower()
        if suffix == ".jsonl":
            raw = spark.read.text(path).where(F.trim("value") != "")
            row = F.from_json("value", "text string, label string", {"mode": "FAILFAST"})
            label = F.get_json_object("value", "$.label")
            given = F.when(label.isNull(), F.lit(default_label)).when(label.isin("0", "1"), label.cast("int")).otherwise(F.raise_error(F.concat(F.lit("label must be 0 or 1: "), F.col("value"))).cast("int"))
            text = F.coalesce(row["text"], F.raise_error(F.concat(F.lit("text must be a string: "), F.col("value"))))
            parts.append(raw.select(text.alias("text"), (F.lit(force_label) if force_label is not None else given).cast("int").alias("label")))
        elif suffix in (".txt", ".md"):
            parts.append(text_files(spark, [path]).select("text", F.lit(default_label if force_label is None else force_label).cast("int").alias("label")))
        else:
            raise ValueError(f"unknown kind of file: {path}")
    if not parts:
        raise ValueError("no input files")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expand(patterns: list[str]) -> list[str]:
    """Recursive globs to sorted paths, each once; a pattern without match is an error."""
    found: dict[str, None] = {}
    for p in patterns:
        matches = sorted(glob.glob(p, recursive=True)) if glob.has_magic(p) else [p]
        if not matches:
            raise FileNotFoundError(f"no file matches {p}")
        for m in matches:
            found.setdefault(str(Path(m).resolve()))
    return list(found)


def load_rules(path: str) -> list[Rule]:
    """Rules from JSON lines {"rule_type", "config"}; the order is that of evaluation. Dotted names are taken by their last part."""
    rules = []
    for n, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        if not line.strip():
            continue
        try:
            row = json.loads(line)
        except json.JSONDecodeError as e:
            raise ValueError(f"line {n}: {e}") from e
        if not isinstance(row, dict) or not isinstance(row.get("rule_type"), str) or not isinstance(row.get("config"), dict):
            raise TypeError(f"line {n}: rule_type and config are needed")
        kind = BY_NAME.get(row["rule_type"].rpartition(".")[2])
        if kind is None:
            raise ValueError(f"line {n}: unknown rule {row['rule_type']}; known: {', '.join(BY_NAME)}")
        rules.append(kind(row["config"]))
    if not rules:
        raise ValueError("no rules")
    return rules


def save_rules(rules: list[Rule], path: str) -> None:
    Path(path).write_text("".join(json.dumps({"config": r.config, "rule_type": r.rule_type}, sort_keys=True) + "\n" for r in rules), encoding="utf-8")


class UnreadableFile(ValueError):
    """What a caller of a tool is told about a file."""


def tool_file(path: str) -> str:
    """The text of one file for a tool's caller; what is wrong with a path is an UnreadableFile."""
    if not path:
        raise UnreadableFile("the path is empty")
    try:
        if Path(path).is_dir():
            raise UnreadableFile(f"a folder, not a file: {path}")
        if not Path(path).is_file():
            raise UnreadableFile(f"no such file: {path}")
        return Path(path).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise UnreadableFile(f"can't read {path}: {getattr(e, 'strerror', None) or e}") from e


def report_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report as write_csv wrote it, by its header; rows that don't parse are left out."""
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").option("enforceSchema", False).schema(schema).csv(path)


#: The columns that timings need.
TIMING = ("rule", "level", "word_count", "time_ms")


def timings(spark: SparkSession, path: str) -> DataFrame:
    """Timing records as JSON lines; a missing column is an error."""
    df = spark.read.json(path)
    if missing := [c for c in TIMING if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df
