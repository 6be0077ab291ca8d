"""Near copies by word shingles: what links every pair of texts whose shingle sets have a Jaccard similarity of 0.8 or more.

An exact join by prefixes. With all shingles in one global order, two sets that similar share a shingle among the first
fifth of either. Common shingles come last in the order, so few texts meet; where they meet, sizes and positions rule
most pairs out. Each text also has parity bits: how many of its shingles fall into each of many bins, modulo two. Sets
differ in at least as many shingles as their bits differ, which rules out nearly all of the rest. Pairs that may be
similar are compared in full, but not all of a crowd: the first rounds send on a spanning forest of pairs that are likely
to be similar and still apart, the last one what is then left. Counts of common shingles steer the order, not the result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ROW, UPPER, join_hot, stored
from .components import components, find, join

SHINGLE = 5
#: Similarity as a fraction, so that comparing needs no rounding.
PART, WHOLE = 4, 5
#: Shingles that a task counts at a time, and how often one must come to be called common; the most of them that the driver sees.
CHUNK, COMMON, MOST_COMMON = 1 << 20, 3, 100_000
BUCKET_ROWS = 250_000
#: Rounds that compare a spanning forest before the one that compares all: of pairs whose estimated difference is no more than these shares of what is allowed.
FORESTS = (0.85, 1.05)
#: The most parity bits of a text; there are two for each shingle at least, up to this. Fewer only rule out less.
MOST_BITS = 4_096
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, in order. A text with fewer words is one shingle, also one without any."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    data = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(data, 7)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    n = len(words) - shingle + 1
    return np.unique(np.fromiter((xxh64_intdigest(data[a:b], 7) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets' Jaccard similarity is at least PART / WHOLE."""
    return (PART + WHOLE) * len(np.intersect1d(a, b, assume_unique=True)) >= PART * (len(a) + len(b))


def parity(found: np.ndarray) -> bytes:
    bins = 64
    while bins < min(2 * len(found), MOST_BITS):
        bins *= 2
    return np.packbits(np.bincount((found & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which a differs from each row of b; the longer ones are folded to the shorter, as if they had fewer bins."""
    size = min(len(a), b.shape[1])
    fold = lambda x: np.bitwise_xor.reduce(x.reshape(*x.shape[:-1], -1, size), axis=-2)
    return np.bitwise_count(fold(a) ^ fold(b)).sum(axis=-1, dtype=np.int64)


def estimated(bits: np.ndarray, bins: int) -> np.ndarray:
    """How many shingles differ where so many of the parity bits do."""
    return -bins / 2 * np.log1p(-np.minimum(2 * bits / bins, 0.99))


def fingerprint(found: np.ndarray) -> int:
    """A SimHash of the set: a bit is set if it is in more than half of the shingles."""
    ones = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of the shingles in the global order: as many as may be missing from a similar set, and one."""
    often = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        often = np.where(common[at] == found, counts[at], 0)
    n = len(found)
    return found[np.lexsort((found, often))[: n - -(-PART * n // WHOLE) + 1]]


def may_match(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """False where texts of n and m shingles that first meet at these places of their orders can't be similar."""
    return (PART + WHOLE) * np.minimum(n - at, m - to) >= PART * (n + m)


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row with its number, id, digest of its shingle set, size, parity bits and fingerprint; and rows without number: a common shingle and its count in one chunk."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        kept, size = [], 0

        def counted():
            values, counts = np.unique(np.concatenate(kept), return_counts=True)
            many = counts >= COMMON
            k = int(many.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, id_type), pa.array(values[many].view(np.int64)), pa.nulls(k, pa.int64()), pa.array(counts[many]), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names=names)

        names = ["row", "id", "a", "b", "n", "bits", "fp"]
        id_type = pa.null()
        for batch in batches:
            id_type = batch.column(1).type
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                digests = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(map(parity, sets)), pa.binary()), pa.array(list(map(fingerprint, sets)), pa.int64())], names=names)
                kept += sets
                size += sum(map(len, sets))
                if size >= CHUNK:
                    yield counted()
                    kept, size = [], 0
        if kept:
            yield counted()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(ROW, F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"row long, id {kind}, a long, b long, n long, bits binary, fp long")


def _shared(texts: DataFrame, common: np.ndarray, counts: np.ndarray, buckets: int) -> DataFrame:
    """shingle, row, n, at for the prefixes' shingles that more than one text has."""

    def prefixes(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                heads = [prefix(s, common, counts) for s in sets]
                sizes = [len(h) for h in heads]
                every = np.concatenate(heads)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((every % np.uint64(buckets)).astype(np.int32)), pa.array(every.view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), sizes)),
                        pa.array(np.repeat([len(s) for s in sets], sizes).astype(np.int32)), pa.array(np.concatenate([np.arange(s) for s in sizes]).astype(np.int32)),
                    ],
                    names=["bucket", "shingle", "row", "n", "at"],
                )

    def repeated(table):
        _, where, times = np.unique(table.column("shingle").to_numpy(), return_inverse=True, return_counts=True)
        return table.drop_columns(["bucket"]).filter(times[where] > 1) if len(times) else table.drop_columns(["bucket"])

    heads = texts.mapInArrow(prefixes, "bucket int, shingle long, row long, n int, at int")
    return heads.groupBy("bucket").applyInArrow(repeated, "shingle long, row long, n int, at int")


def _candidates(shared: DataFrame, buckets: int, forest: float | None) -> DataFrame:
    """Pairs u < v of rows that meet in different components and may be similar: all, or for each bucket a spanning forest of those that are likely to be, by this share of the difference allowed."""

    def pairs(table):
        import pyarrow as pa

        shingle, row, n, at, comp = (table.column(c).to_numpy() for c in ("shingle", "row", "n", "at", "component"))
        bits = table.column("bits").to_pylist()
        n, at = n.astype(np.int64), at.astype(np.int64)
        length = np.fromiter(map(len, bits), np.int64, len(bits))
        place = np.zeros(len(bits), np.int64)  # in the matrix of all bits of one length
        byte = {}
        for size in np.unique(length).tolist():
            where = np.flatnonzero(length == size)
            place[where] = np.arange(len(where))
            byte[size] = np.frombuffer(b"".join(bits[i] for i in where.tolist()), np.uint8).reshape(-1, size)
        del bits

        def apart(x: int, others: np.ndarray) -> np.ndarray:
            """Those of others that may be similar to x and are not in its component."""
            others = others[find(root, label[others]) != find(root, label[x : x + 1])[0]]
            others = others[may_match(n[x], at[x], n[others], at[others])]
            if not len(others):
                return others
            differ = np.empty(len(others))
            for size in np.unique(length[others]).tolist():
                of = length[others] == size
                fewest = differing(byte[int(length[x])][place[x]], byte[size][place[others[of]]])
                differ[of] = estimated(fewest, 8 * min(size, int(length[x]))) / forest if forest else fewest
            return others[(PART + WHOLE) * differ <= (WHOLE - PART) * (n[x] + n[others])]

        _, label = np.unique(comp, return_inverse=True)
        root = np.arange(label.max() + 1 if len(label) else 0)
        order = np.lexsort((row, n, shingle))
        starts = np.nonzero(np.diff(shingle[order], prepend=shingle[order][:1] - 1))[0].tolist()
        seen, size = [np.empty((0, 2), np.int64)], 0
        for a, b in zip(starts, [*starts[1:], len(order)]):
            group = order[a:b]
            for h in range(len(group) - 1):
                others = apart(group[h], group[h + 1 :])
                if forest and len(others):  # one edge to each component
                    _, first = np.unique(find(root, label[others]), return_index=True)
                    others = others[first]
                    join(root, label[others], np.full(len(others), label[group[h]]))
                if len(others):
                    seen.append(np.stack([np.minimum(row[others], row[group[h]]), np.maximum(row[others], row[group[h]])], 1))
                    size += len(others)
            if size > 1_000_000:
                seen, size = [np.unique(np.concatenate(seen), axis=0)], 0
        found = np.unique(np.concatenate(seen), axis=0)
        return pa.table({"u": found[:, 0].copy(), "v": found[:, 1].copy()}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    keyed = shared.withColumn("bucket", F.pmod("shingle", F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").applyInArrow(pairs, "u long, v long").distinct()


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs u, v of row numbers whose texts are similar."""

    def compare(batches):
        import pyarrow as pa

        sets = lru_cache(256)(shingles)
        for batch in batches:
            u, v = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield batch.select(["u", "v"]).filter(pa.array([similar(sets(a), sets(b)) for a, b in zip(u, v)], pa.bool_()))

    one = _with_text(pairs, texts, "u", "x")
    return _with_text(one, texts, "v", "y").select("u", "v", "x", "y").mapInArrow(compare, "u long, v long")


def _with_text(pairs: DataFrame, texts: DataFrame, at: str, out: str) -> DataFrame:
    return pairs.join(texts.select(F.col(ROW).alias(at), F.col("text").alias(out)), at)


def links(texts: DataFrame, described: DataFrame, common: np.ndarray, counts: np.ndarray, total: int, edges: DataFrame) -> DataFrame:
    """node, component over the row numbers of texts (row number, text; no two shingle sets the same).

    described: rep, bits; total: all shingles; edges: u, v, similar pairs that are known already.
    """
    buckets = max(64, -(-total // WHOLE // BUCKET_ROWS))
    shared = stored(_shared(texts, common, counts, buckets), "near-shared")
    shared = stored(shared.join(described.select(F.col("rep").alias("row"), "bits"), "row"), "near-meetings")
    some = stored(texts.join(shared.select(F.col("row").alias(ROW)).distinct(), ROW, "left_semi"), "near-texts")
    found = components(edges)
    for forest in [*FORESTS, None]:
        now = shared.join(found, F.col("row") == F.col("node"), "left").select(*shared.columns, F.coalesce("component", "row").alias("component"))
        pairs = stored(_candidates(now, buckets, forest), "near-pairs")
        edges = edges.unionAll(stored(linked(pairs, some), "near-links"))
        found = components(edges)
    return found


def common_shingles(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, sorted, and their counts."""
    often = described.where("row is null").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(MOST_COMMON).toArrow()
    common, counts = often.column("a").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(common)
    return common[order], counts[order]
