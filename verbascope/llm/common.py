"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: The same separators for Python's bytes.split() and str.split(sep) callers.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_AZ = str.maketrans(UPPER, LOWER)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only; lower() alone would also change other letters, but is faster where all are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: str) -> list[str]:
    """The words of a text; str.split() would also split at other Unicode spaces."""
    if text.isascii() and not _has_separators(text):
        return text.split()
    return [w.decode("utf-8") for w in text.encode("utf-8").split()]


def _has_separators(text: str) -> bool:
    """str.split() takes U+001C-U+001F as spaces, bytes.split() doesn't."""
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='verbascope-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and losing an executor costs nothing before it.

    The shuffles behind the table go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _STORED.append(path)
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored_buckets(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """Like stored(), with rows of one key in files of its bucket: joins and groups on it don't shuffle the table again. df should have the rows of a key in one task, or there are many files."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    _STORED.append(f"{shared_folder(spark)}/{table}")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.bucketBy(buckets, by).option("path", f"{shared_folder(spark)}/{table}").option("compression", "zstd").saveAsTable(table)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.table(table)


#: A key is hot if it has more rows than this and than one in HOT_SHARE of all; so there are never more than HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE, SALTS = 10_000, 10_000, 32


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of rows with a table that has one row per key; weight is its column with the number of rows of the key.

    The rows of hot keys are dealt over SALTS tasks, and the table's row goes to each. Weights are read twice, so table
    should be stored. The set of hot keys is broadcast: it has HOT_SHARE rows at most.
    """
    total, most = table.agg(F.sum(weight), F.max(weight)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if (most or 0) <= least:
        return rows.join(table, key)
    hot = F.broadcast(table.where(F.col(weight) > least).select(key, F.lit(SALTS).alias("__salts")))
    salt = F.pmod(F.monotonically_increasing_id(), F.coalesce("__salts", F.lit(1)).cast("long"))
    dealt = rows.join(hot, key, "left").withColumn("__salt", salt).drop("__salts")
    copies = F.sequence(F.lit(0).cast("long"), F.when(F.col(weight) > least, F.lit(SALTS - 1)).otherwise(0).cast("long"))
    return dealt.join(table.withColumn("__salt", F.explode(copies)), [key, "__salt"]).drop("__salt")


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df dealt into ranges of a total order, with the number of its range as RANGE, stored. Rows that are equal in order must not be many."""
    rows, most = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = max(min(most, rows // LEAST_RANGE_ROWS + 1), -(-rows // RANGE_ROWS))
    return stored(df.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()), name)


RANGE, RANGE_ROWS, LEAST_RANGE_ROWS = "__range", 1_000_000, 4_096


def running(df: DataFrame, order: list[str], value: str, out: str, within: list[str] = ()) -> DataFrame:
    """The running sum of value in the order of ranged(), over all rows or within groups that order begins with.

    Sums of the ranges are added up first, one row per range and group; then each range is summed by itself.
    """
    sums = df.groupBy(*within, RANGE).agg(F.sum(value).alias("__sum"))
    before = sums.select(*[F.col(c).alias(f"__{c}") for c in within], F.col(RANGE).alias("__at"), (F.sum("__sum").over(Window.partitionBy(*within).orderBy(RANGE)) - F.col("__sum")).alias("__before"))
    here = F.sum(value).over(Window.partitionBy(RANGE, *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), within, F.col(RANGE) == F.col("__at"))
    return df.withColumn("__here", here).join(before, same).withColumn(out, F.col("__here") + F.col("__before")).drop("__here", "__at", "__before", *[f"__{c}" for c in within])


#: Where this driver has stored tables that are still there.
_STORED: list[str] = []


def dropped(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def cleaned(spark: SparkSession, left: list[str], operator: Callable, *args) -> DataFrame:
    """operator(*args). Tables that the last call with this list has stored for itself are deleted first: its result must have been written. The list then names those of this call."""
    while left:
        _delete(spark, left.pop())
    before = len(_STORED)
    result = operator(*args)
    left += _STORED[before:]
    return result


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: The column of numbered().
ROW = "__row_number"


#: The most files whose numbers are broadcast; the bits of a row's place in its file.
MOST_FILES, PLACE_BITS = 50_000, 40


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of its own for each row, the same wherever and however often it is read.

    Rows of a table of files are numbered by file and by place in the file, whatever tasks read them. Other rows, and
    those of more than MOST_FILES files, are stored with their numbers.
    """
    of_files = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns
    if of_files and "row_index" in df.select("_metadata.*").columns:
        meta = F.col("_metadata")
        files = df.select(meta["file_path"].alias("__path")).distinct().orderBy("__path").limit(MOST_FILES + 1)
        paths = [r[0] for r in files.collect()]
        if len(paths) <= MOST_FILES:
            table = df.sparkSession.createDataFrame(list(enumerate(paths)), "__file long, __path string")
            placed = df.select("*", meta["file_path"].alias("__path"), meta["row_index"].alias("__place")).join(F.broadcast(table), "__path")
            return placed.select(*df.columns, (F.shiftleft("__file", PLACE_BITS) + F.col("__place")).alias(ROW))
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), name)


#: The most blocks of 64 numbers that are broadcast.
MOST_BLOCKS = 1 << 19


def counted_rows(rows: DataFrame, counts: DataFrame, times: str, most: int, name: str) -> DataFrame:
    """numbered() rows that counts (ROW, once each, and times, from 1 to most) holds, with times.

    Rows stay where they are, however long: what goes to them is the counts' binary digits, packed by blocks of 64 row
    numbers. Only where there are more than MOST_BLOCKS of those, rows and counts are shuffled.
    """
    one, digits = F.lit(1).cast("long"), range(most.bit_length())
    place = F.col(ROW).bitwiseAND(F.lit(63)).cast("int")
    set_bits = [F.bit_or(F.call_function("shiftleft", F.shiftright(F.col(times).cast("long"), d).bitwiseAND(one), place)).alias(f"__bits{d}") for d in digits]
    blocks = stored(counts.groupBy(F.shiftright(ROW, 6).alias("__block")).agg(*set_bits), name)
    if blocks.count() > MOST_BLOCKS:
        return rows.join(counts.select(ROW, times), ROW).select(*[F.col(f"`{c}`") for c in [*rows.columns, times]])
    found = rows.withColumn("__block", F.shiftright(ROW, 6)).join(F.broadcast(blocks), "__block")
    bits = [F.call_function("shiftright", F.col(f"__bits{d}"), place).bitwiseAND(one) for d in digits]
    total = reduce(lambda a, b: a + b, (F.shiftleft(b, d) for d, b in zip(digits, bits)))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], total.cast("int").alias(times)).where(F.col(times) > 0)


def rows_in(rows: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    """numbered() rows whose number is in kept's column ROW, where it may repeat."""
    return counted_rows(rows, kept.select(ROW).distinct().withColumn("__times", F.lit(1)), "__times", 1, name).drop("__times")


def give_back() -> None:
    """Gives memory that earlier tasks of this Python worker are done with back to the system. A worker goes on to other tasks and operators; caches that refer to their owners would wait for a full collection, and freed pages stay with the worker."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


class Cache(dict):
    """Two generations of at most size entries each; what isn't found is made."""

    def __init__(self, make: Callable, size: int = 150_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
