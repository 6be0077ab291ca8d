"""SimHash near-duplicates by vantage-point trees.

Texts become 64-bit fingerprints of their word shingles. Equal fingerprints meet first, so a group of copies is one row.
A vantage-point tree, built on a bounded sample, partitions the distinct fingerprints by Hamming distance: each has one
home shard, and one that lies near a boundary is also sent across it as a query. In a shard a finer tree of the same
kind prunes by triangle bounds down to small blocks, which are compared in full. So every pair of fingerprints within
the radius is found, whatever the sample; the tree only decides how much is compared. Of the pairs of a shard only a
spanning forest leaves it, and the components of all forests together are the groups.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, ROW, UPPER, join_hot, numbered, stored
from . import near_copies
from .components import components, join

SHINGLE, RADIUS = 3, 2
#: Fingerprints that one shard of a small table holds at home, on average; the size that the finer trees go down to.
SHARD, BLOCK = 16_384, 192
#: Shards grow with the table, slower than it, as each border that a tree adds sends fingerprints to more shards.
SHARD_GROWTH = 0.75
#: The most fingerprints that the driver sees when it builds the coarse tree.
SAMPLE = 20_000
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_HASHES = 1 << 14


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in more than half of the shingles' hashes. A text with fewer words is one shingle; without words, zero."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _HASHES):
        part = hashes[at : at + _HASHES]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (long, the 64 bits as a signed number); one row per row of docs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = np.fromiter((fingerprint(t or "", shingle) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def build_tree(sample: np.ndarray, leaves: int, seed: int = 11) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, median distance, inner, outer); a child below zero is leaf -1 - child. The sample bounds its size."""
    rng, nodes, count = np.random.default_rng(seed), [], 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal count
        if want > 1 and len(points) > 1:
            vantage = points[rng.integers(len(points))]
            d = np.bitwise_count(points ^ vantage)
            mu = int(np.median(d))
            inner = d <= mu
            if 0 < inner.sum() < len(points):
                at = len(nodes)
                nodes.append((0, 0, 0, 0))
                a = grow(points[inner], want // 2)
                b = grow(points[~inner], want - want // 2)
                nodes[at] = (int(vantage), mu, a, b)
                return at
        count += 1
        return -count

    if grow(sample, leaves) < 0:
        return []
    return nodes


def route(nodes: list[tuple[int, int, int, int]], fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indexes at home there, indexes that only query there).

    Of two fingerprints that a node parts, the inner one goes to the outer side as a query; from there on it follows
    every branch that its ball reaches, so it arrives at the other's home.
    """
    if not nodes:
        return [(1, np.arange(len(fps)), np.arange(0))]
    out, todo = [], [(0, np.arange(len(fps)), np.arange(0))]
    while todo:
        at, home, query = todo.pop()
        if at < 0:
            out.append((-at, home, query))
            continue
        vantage, mu, inner, outer = nodes[at]
        dh = np.bitwise_count(fps[home] ^ np.uint64(vantage)).astype(np.int64)
        dq = np.bitwise_count(fps[query] ^ np.uint64(vantage)).astype(np.int64)
        crossing = home[(dh <= mu) & (dh + radius > mu)]
        todo.append((inner, home[dh <= mu], query[dq - radius <= mu]))
        todo.append((outer, home[dh > mu], np.concatenate([query[dq + radius > mu], crossing])))
    return out


def forest(home: np.ndarray, query: np.ndarray, radius: int = RADIUS, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Edges (index, smaller index) that join what pairs within radius join; indexes run over home, then query. No pair of queries counts."""
    fps = np.concatenate([home, query])
    root = np.arange(len(fps))
    rng = np.random.default_rng(5)
    todo = [(np.arange(len(home)), np.arange(len(home), len(fps)), 0)]
    while todo:
        h, q, depth = todo.pop()
        if not len(h):
            continue
        if len(h) > block and depth < 64:
            vantage = fps[h[rng.integers(len(h))]]
            d = np.bitwise_count(fps[h] ^ vantage).astype(np.int64)
            mu = int(np.median(d))
            inner = d <= mu
            if 0 < inner.sum() < len(h):
                dq = np.bitwise_count(fps[q] ^ vantage).astype(np.int64)
                crossing = h[inner & (d + radius > mu)]
                todo.append((h[inner], q[dq - radius <= mu], depth + 1))
                todo.append((h[~inner], np.concatenate([q[dq + radius > mu], crossing]), depth + 1))
                continue
        for at in range(0, len(h), block):  # pairs of home, then home with queries
            part = h[at : at + block]
            other = np.concatenate([h[at:], q])
            for k in range(0, len(other), 8192):
                near = np.bitwise_count(fps[part][:, None] ^ fps[other[k : k + 8192]][None, :]) <= radius
                a, b = np.nonzero(near)
                a, b = part[a], other[k : k + 8192][b]
                keep = a != b
                if keep.any():
                    join(root, a[keep], b[keep])
    root = _flat(root)
    moved = np.nonzero(root != np.arange(len(fps)))[0]
    return moved, root[moved]


def _flat(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root = up


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id (a whole number), fingerprint (16 hex digits), component_id.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest id reachable. Null and empty
    texts and those without words have fingerprint zero and are linked like others. Rows with a null id get their
    group's component_id, which is null where all of a group's ids are; repeated rows get one row each. An empty table
    gives no rows; other columns are ignored.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    heads = stored(_groups(fps, radius).select("fp", "component_id", "size"), "simhash-heads")
    out = join_hot(fps, heads, "fp", "size")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _groups(fps: DataFrame, radius: int) -> DataFrame:
    """fp, size (rows that have it), component, component_id of each fingerprint. Fingerprints themselves are the nodes, as ids may repeat or be null; component is the smallest one of the group."""
    distinct = stored(fps.groupBy("fp").agg(F.min("id").cast("long").alias("rep"), F.count(F.lit(1)).alias("size")), "simhash-distinct")
    nodes = _coarse_tree(distinct)
    edges = components(_shard_edges(distinct.select("fp", F.col("fp").alias("rep")), nodes, radius))
    heads = stored(distinct.join(edges, F.col("fp") == F.col("node"), "left").select("fp", "rep", "size", F.coalesce("component", "fp").alias("component")), "simhash-groups")
    groups = stored(heads.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("fps")), "simhash-components")
    return join_hot(heads.select("fp", "size", "component"), groups, "component", "fps").select("fp", "size", "component", "component_id")


def _coarse_tree(distinct: DataFrame) -> list:
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").collect()], np.int64).view(np.uint64)
    return build_tree(sample, math.ceil((distinct.count() / SHARD) ** SHARD_GROWTH))


def _shard_edges(usable: DataFrame, nodes: list, radius: int) -> DataFrame:
    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            fp, rep = (batch.column(i).to_numpy() for i in (0, 1))
            for leaf, home, query in route(nodes, fp.view(np.uint64), radius):
                at = np.concatenate([home, query])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf)), pa.array(fp[at]), pa.array(rep[at]), pa.array(np.arange(len(at)) < len(home))], names=["leaf", "fp", "rep", "home"])

    def search(table):
        import pyarrow as pa

        home = table.column("home").to_numpy()
        fp, rep = table.column("fp").to_numpy(), table.column("rep").to_numpy()
        order = np.concatenate([np.nonzero(home)[0], np.nonzero(~home)[0]])
        bits = np.ascontiguousarray(fp[order]).view(np.uint64)
        k = int(home.sum())
        a, b = forest(bits[:k], bits[k:], radius)
        return pa.table({"u": rep[order][a], "v": rep[order][b]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    shards = usable.select("fp", "rep").mapInArrow(assign, "leaf long, fp long, rep long, home boolean")
    return shards.groupBy("leaf").applyInArrow(search, "u long, v long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all columns of docs: that with the smallest id; among equal ids any one, an id before none.

    Near copies have a Jaccard similarity of near_copies.PART / WHOLE or more over shingles of near_copies.SHINGLE words.
    Words are as in the fingerprints; texts without words are equal. Rows are told apart by a number of their own, so ids
    may repeat or be null. An empty table gives no rows.

    Fingerprints within the radius, found by the trees, are compared in full first. That links copies that hardly differ.
    Of pairs at the similarity itself fingerprints differ in ten bits on average, a distance at which no tree prunes; the
    pairs that are still apart come from an exact join by prefixes (near_copies), so that no link is lost.
    """
    rows = numbered(docs, "near-rows")
    read = stored(near_copies.described(rows, id_col, text_col), "near-sets")
    sets = read.where("row is not null")
    groups = stored(sets.groupBy("a", "b").agg(F.min(F.struct("row", "n", "bits", "fp")).alias("x"), F.count(F.lit(1)).alias("rows")).select("a", "b", "rows", F.col("x.row").alias("rep"), "x.n", "x.bits", "x.fp"), "near-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    texts = rows.select(ROW, F.col(text_col).alias("text")).join(groups.select(F.col("rep").alias(ROW)), ROW, "left_semi")
    near = stored(_near_prints(groups.select("fp", "rep")), "near-prints")
    known = stored(near_copies.linked(near, texts), "near-links")
    found = near_copies.links(texts, groups, *near_copies.common_shingles(read), total, known)
    heads = stored(groups.join(found, F.col("rep") == F.col("node"), "left").select("a", "b", "rows", F.coalesce("component", "rep").alias("component")), "near-heads")
    whole = heads.withColumn("set", F.struct("a", "b")).select("set", "rows", "component")
    best = join_hot(sets.select(F.struct("a", "b").alias("set"), "id", "row"), whole, "set", "rows").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"))
    return rows.join(best.select(F.col("best.row").alias(ROW)), ROW, "left_semi").select(*docs.columns)


def _near_prints(prints: DataFrame) -> DataFrame:
    """u, v: edges that join all whose fingerprints lie within the radius. prints: fp, rep."""
    heads = stored(prints.groupBy("fp").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("size")), "near-heads-of-prints")
    same = join_hot(prints, heads, "fp", "size").where("rep <> head").select(F.col("head").alias("u"), F.col("rep").alias("v"))
    nodes = _coarse_tree(heads)
    return same.unionAll(_shard_edges(heads.select("fp", F.col("head").alias("rep")), nodes, RADIUS))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
