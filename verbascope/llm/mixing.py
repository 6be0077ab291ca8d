"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, up to three passes long. A document's virtual finish time
is the words of its queue up to and with it, divided by the source's weight. All items are sorted globally, by ranges of
finish time, and the mix is cut where its words reach the budget. A source whose passes run out leaves the rest to the
others by weight, so the cut also shares out again what a capped target leaves.

Orders are total and dealt over tasks by ranges: the queues by source and shuffle key, so that a source of any size
takes as many tasks as it has rows, then all items by finish time. Running sums are those of the ranges before, one row
per range, plus the range's own. Sources are a table like others; only totals and the place of the cut reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RANGE, ROW, WORD, counted_rows, join_hot, numbered, ranged, running, stored, text_or_empty

WEIGHTS = (5, 2, 1)
PASSES = 3
SEED = "mix-1"


def word_size(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def _name(source: Column) -> Column:
    """Sources in their order: by code point, null last."""
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def fair_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, share: float = 1.0) -> tuple[DataFrame, int]:
    """sizes: _name, _total, one row per source. Adds _rank, _w and _target; with it comes the budget.

    Sources take the weights in their order. A target stops at passes times its source's size, and the excess is shared
    again by weight until no target is above: sources are filled in the order of what they can take per weight, and the
    first that can't be filled from its share of what is left gives the level of all after it.
    """
    ranked = running(ranged(sizes.withColumn("_one", F.lit(1)), ["_name"], "mix-names"), ["_name"], "_one", "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    ranked = ranked.drop("_one", RANGE).withColumns({"_w": weight, "_most": F.col("_total") * passes})
    by = ["_ratio", "_rank"]
    filled = ranged(ranked.withColumn("_ratio", F.col("_most") / F.col("_w")), by, "mix-sources")
    filled = running(running(filled, by, "_most", "_full"), by, "_w", "_weights")
    total, all_weights = sizes.agg(F.sum("_total")).first()[0] or 0, filled.agg(F.sum("_w")).first()[0]
    budget = total if share == 1.0 else int(total * share)
    level = (F.lit(budget) - (F.col("_full") - F.col("_most"))).cast("double") / (F.lit(all_weights) - (F.col("_weights") - F.col("_w"))).cast("double")
    first = filled.withColumn("_level", level).where(F.col("_most") > F.col("_level") * F.col("_w")).agg(F.min(F.struct(*by, "_level")).alias("x")).first()[0]
    part = F.lit(first["_level"]) * F.col("_w") if first else F.lit(float("inf"))
    return filled.select("_name", "_total", "_w", "_rank", F.least(F.col("_most").cast("double"), part).alias("_target"), *[c for c in sizes.columns if c not in ("_name", "_total")]), budget


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, and virtual_finish, that of its first pass.

    Size is the number of words; taken is size times the passes that lie before the cut, so a document is taken whole or
    not at all in each pass. Null text has size 0 and takes nothing. Null sources form one queue, the last. Ties of the
    shuffle key go by id, then by size, then by a stored row number, so that also many equal rows spread over tasks; rows
    equal in all else are interchangeable, so reruns agree. An empty table gives no rows; other columns are ignored.
    """
    return _mix(docs, id_col, text_col, source_col, weights, passes, share, seed, F.monotonically_increasing_id()).withColumnRenamed("_id", id_col).drop(ROW)


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], passes: int, share: float, seed: str, row: Column) -> DataFrame:
    """The plan, with the id as _id and the row's number."""
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    sized = stored(docs.select(F.col(id_col).alias("_id"), _name(F.col(source_col)).alias("_name"), word_size(text_col).alias("_size"), key.alias("_key"), row.alias(ROW)), "mix-sizes")
    plan, budget = fair_targets(stored(sized.groupBy("_name").agg(F.sum("_size").alias("_total"), F.count(F.lit(1)).alias("_rows")), "mix-totals"), weights, passes, share)
    order = ["_rank", "_key", "_id", "_size", ROW]
    queued = join_hot(sized, stored(plan, "mix-plan"), "_name", "_rows").drop("_name", "_rows")
    queued = stored(running(ranged(queued, order, "mix-queues"), order, "_size", "_end", ["_rank"]).drop(RANGE), "mix-ends")
    cut = _cut(queued, budget, passes)
    taken = sum((F.when(F.lit(True) if cut is None else F.struct(_finish(p).alias("_finish"), *_TIES) < cut, 1).otherwise(0) for p in range(passes)), F.lit(0))
    return queued.select(
        "_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * taken).cast("long").alias("taken"), _finish(0).alias("virtual_finish"), ROW
    )


#: What decides between items of one finish time.
_TIES = ("_rank", "_key", "_id", ROW)


def _finish(p: int | Column) -> Column:
    return (F.col("_end") + F.lit(p) * F.col("_total")).cast("double") / F.col("_w")


def _cut(queued: DataFrame, budget: int, passes: int) -> Column | None:
    """The first item of the global order whose running total passes the budget, None if none does."""
    items = queued.where("_size > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).select(_finish(F.col("_pass")).alias("_finish"), *_TIES, "_size")
    order = ["_finish", *_TIES]
    over = running(ranged(items, order, "mix-items"), order, "_size", "_run").where(F.col("_run") > budget)
    first = over.agg(F.min(F.struct(*order)).alias("x")).first()[0]
    kinds = dict(items.dtypes)
    return first and F.struct(*[F.lit(first[c]).cast(kinds[c]).alias(c) for c in order])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: each row as many times as it is taken, with the columns of docs, in no order. Ids may repeat or be null: rows have a number of their own. Rows without words are part of no queue and go."""
    rows = numbered(docs, "mix-rows")
    plan = _mix(rows, id_col, "text", "source", WEIGHTS, PASSES, 1.0, SEED, F.col(ROW)).where("taken > 0")
    plan = plan.select(F.col(ROW), (F.col("taken") / F.col("size")).cast("int").alias("__mix_times"))
    mixed = counted_rows(rows, plan, "__mix_times", PASSES, "mix-copies")
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("__mix_times"))).alias("__mix_copy")).drop("__mix_copy")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op4_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, ''))), 1, 15))::BIGINT AS k
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s0),
s2 AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM s1),
s3 AS (
  SELECT *, sum(total) OVER ()
            - coalesce(sum(3 * total) OVER (ORDER BY 3 * total / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY 3 * total / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wrest
  FROM s2),
lv AS (
  SELECT rest::DOUBLE / wrest::DOUBLE AS level FROM s3
  WHERE 3 * total > rest::DOUBLE / wrest::DOUBLE * w ORDER BY 3 * total / w, rnk LIMIT 1),
s AS (
  SELECT source, total, w, rnk, CASE WHEN 3 * total <= level * w THEN (3 * total)::DOUBLE ELSE level * w END AS target
  FROM s2, lv),
q AS (
  SELECT d.doc_id, d.size, s.total, s.w, s.rnk, s.target, d.k,
         sum(d.size) OVER (PARTITION BY s.rnk ORDER BY d.k, d.doc_id, d.size) AS e
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
i AS (
  SELECT q.*, p, (e + p * total)::DOUBLE / w::DOUBLE AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS p) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, rnk, k, doc_id) AS run FROM i),
t AS (SELECT doc_id, count(*) AS times FROM r WHERE run <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.total AS source_size, q.target,
       (q.size * coalesce(t.times, 0))::BIGINT AS taken, e::DOUBLE / w::DOUBLE AS virtual_finish
FROM q LEFT JOIN t ON q.doc_id = t.doc_id
"""
}
