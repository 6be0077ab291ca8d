"""Exact deduplication with skew-safe combining.

Equal texts are found in three steps, each of which compares whole contents and not only digests: every map task
combines its own copies (partial aggregation), salted groups combine what the tasks have left, and the winners of the
salts meet in one row per text. A group of copies of any size therefore arrives as one row per task, then as one row
per salt. The last step stops the query should two texts share a digest, so from there on a digest is its text, and rows
are marked by joining the small table of winners back on it; the rows of large groups are dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, join_hot, lower_az, numbered, rows_in, stored, text_or_empty

SALTS = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest id of a group stays.
    Null text counts as empty, so null and empty texts form one group. A null id never wins over another; in a group
    of null ids keep_id is null and the rows are kept. Rows that repeat id and text are all marked alike and all count
    in group_size. An empty table gives no rows; other columns, whatever their names, are ignored.
    Two texts with one SHA-256 digest would stop the query instead of merging.
    """
    keyed = _keyed(docs, id_col, text_col)
    winners = _winners(keyed, salts, F.col("_id")).withColumnRenamed("_best", "keep_id")
    return join_hot(keyed.select("_id", "_digest"), winners, "_digest", "group_size").select(
        F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long"), F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, also: list[str] = ()) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), lower_az(text_or_empty(text_col)).alias("_text"), *also).select("_id", "_text", F.unhex(F.sha2("_text", 256)).alias("_digest"), *also)


def _winners(keyed: DataFrame, salts: int, best: Column) -> DataFrame:
    """_digest, _best (the largest one) and group_size of each text."""
    salted = keyed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("_salt", "_digest", "_text").agg(F.max(best).alias("_best"), F.count(F.lit(1)).alias("_n"))
    texts = salted.groupBy("_digest", "_text").agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"))
    winners = texts.groupBy("_digest").agg(F.max("_best").alias("_best"), F.max("_n").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
    one = F.when(F.col("_texts") == 1, F.col("_digest")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("binary"))
    return stored(winners.select(one.alias("_digest"), "_best", "group_size"), "exact-dedup")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of each group of equal texts, with all columns of docs: that with the largest id, a null id only where all are; of rows that repeat id and text the first by a stored number. An empty table gives no rows."""
    rows = numbered(docs, "exact-dedup-rows")
    winners = _winners(_keyed(rows, id_col, text_col, [ROW]), salts, F.struct("_id", (-F.col(ROW)).alias("_first")))
    return rows_in(rows, winners.select((-F.col("_best._first")).alias(ROW)), "exact-dedup-kept").select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op3_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
}
