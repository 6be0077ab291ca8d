"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix and becomes one regular expression. Its literal tokens are the labels of its host and
those path segments that the rule gives in full; the one that the fewest URLs hold becomes its key in the index. A URL
looks up its own tokens in the index, and only the rules found there run their expressions.

A short list stands in the plan: each expression is compiled once and runs only where the rule's key is among the URL's
tokens. A list of any length is a table: URLs' tokens are counted against it, and fetch their rules by a join on the key,
with hot keys dealt over salts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

#: Lists of at most so many rules stand in the plan; longer ones are joined.
INLINE_RULES = 64
#: The URLs that hold one token are dealt over so many keys of the join.
SALTS = 16


@dataclass(frozen=True)
class UrlRule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every fitting URL holds: the last path segment may go on in the URL, unless a slash ends it."""
        return [f"h:{x}" for x in self.host.split(".")] + [f"p:{x}" for x in self.path.split("/")[1:-1] if x]

    @property
    def regex(self) -> str:
        """Against host and path put together: no host holds a slash, and a path is empty or begins with one."""
        return f"(?s)^(?:[^/]*\\.)?{_quoted(self.host)}(?=/|\\z){_quoted(self.path)}"


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


#: The production rules.
RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict. rules: a few UrlRules, or a table (action, host, path) of any length.

    Host and path of a null url or one without :// are empty, and no rule fits them. The longest fitting rule wins, by
    the length of host and path together; ties go to the longer host, then to block, then to the first by text.
    Without a fitting rule, rule is null and the verdict is default. Ids aren't looked at: repeated and null ones give
    one row each. Rules with a null are left out. An empty table gives no rows; other columns are ignored.
    """
    if isinstance(rules, tuple | list) and len(rules) > INLINE_RULES:
        rules = pages.sparkSession.createDataFrame([(r.action, r.host, r.path) for r in rules], "action string, host string, path string")
    if isinstance(rules, DataFrame):
        return _joined(pages, rules, id_col, url_col, default)
    parsed = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"))
    index = build_index(parsed, rules)
    found = parsed.withColumn("_tokens", _tokens(F.col("_host"), F.col("_path"))).withColumn("_at", F.concat("_host", "_path"))
    entries = [F.when(F.array_contains("_tokens", t) & F.col("_at").rlike(r.regex), _entry(F.lit(r.action), F.lit(r.host), F.lit(r.path))) for t, fetched in sorted(index.items()) for r in fetched]
    best = F.array_min(F.array_compact(F.array(*entries))) if entries else F.lit(None).cast("struct<rule:string,verdict:string>")
    return _judged(found.withColumn("_best", best), id_col, default)


def _entry(action: Column, host: Column, path: Column) -> Column:
    """The least of a URL's entries is that of the rule that wins."""
    text = F.concat(host, path)
    return F.struct((-F.length(text)).alias("a"), (-F.length(host)).alias("b"), (action != "block").alias("c"), text.alias("rule"), action.alias("verdict"))


def _judged(found: DataFrame, id_col: str, default: str) -> DataFrame:
    return found.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))


def build_index(parsed: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, list[UrlRule]]:
    """token -> rules whose rarest token it is. Counts cover all URLs; what comes back is bounded by the rules' tokens."""
    tokens = sorted({t for r in rules for t in r.tokens})
    if not tokens:
        return {}
    held = parsed.select(F.explode(F.filter(_tokens(F.col("_host"), F.col("_path")), lambda t: t.isin(*tokens))).alias("_t"))
    counts = {r["_t"]: r["n"] for r in held.groupBy("_t").agg(F.count(F.lit(1)).alias("n")).collect()}
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
    return index


def _joined(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str) -> DataFrame:
    """Each different URL fetches the rules of its tokens by a join and keeps the best that fits; rows meet theirs at the end, a URL that many rows have dealt over salts."""
    parsed = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"))
    salt = lambda: F.pmod(F.spark_partition_id() + F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    urls = stored(parsed.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_rows")), "url-distinct")
    held = urls.select(F.explode(_tokens(F.col("_host"), F.col("_path"))).alias("_t"), "_rows").groupBy("_t").agg(F.sum("_rows").alias("_n"))
    rules = rules.select("action", "host", "path").dropna().distinct()
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split("path", "/")
    whole = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x != "")
    tokens = rules.withColumn("_t", F.explode(F.concat(labels, F.transform(whole, lambda x: F.concat(F.lit("p:"), x)))))
    rarest = tokens.join(held, "_t", "left").groupBy("action", "host", "path").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), "_t")).alias("_key"))
    quoted = lambda c: F.regexp_replace(c, r"([^\p{L}\p{Nd}])", r"\\$1")
    regex = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(F.col("host")), F.lit(r"(?=/|\z)"), quoted(F.col("path")))
    index = stored(rarest.select(F.col("_key._t").alias("_t"), regex.alias("_regex"), _entry(F.col("action"), F.col("host"), F.col("path")).alias("_entry")), "url-rules")
    salted = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = urls.select("_host", "_path", F.explode(_tokens(F.col("_host"), F.col("_path"))).alias("_t")).withColumn("_salt", salt())
    fits = asked.join(salted, ["_t", "_salt"]).where(F.regexp_like(F.concat("_host", "_path"), F.col("_regex")))
    best = stored(fits.groupBy("_host", "_path").agg(F.min("_entry").alias("_best")), "url-verdicts")
    rows = parsed.withColumn("_salt", salt())
    return _judged(rows.join(best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_host", "_path", "_salt"], "left"), id_col, default)


def fits(rule: UrlRule, host: str, path: str) -> bool:
    """What a rule means, for tests and small jobs."""
    return re.match(rule.regex.replace(r"\z", r"\Z"), host + path) is not None


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = {
    "op5_url_filter": """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
}
