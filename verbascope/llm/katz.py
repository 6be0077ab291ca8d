"""Language-model scores by Katz backoff over bigrams.

    P(w | h) = d(c) c(h, w) / D(h)          where the pair was seen in training, c = c(h, w)
             = alpha(h) P(w)                elsewhere, and
    P(w)     = d(c) c(w) / N                where the word was seen,
             = what the seen words leave    for all unknown words together.

d are Good-Turing discounts; alpha(h) is what the seen pairs of h leave, over what their words leave in P, so that each
history sums to one exactly. A history of which no count is discounted has D(h) = c(h) + 1, else D(h) = c(h).

fit() counts the pairs of each batch of texts, sends them, packed, to the bucket of their word, and adds them up there. A
word that holds much of the corpus is spread over all buckets by its history. What alpha(h) needs is a sum over buckets:
each sends its part to the history's own bucket and gets the whole back. The model is two stored tables, one row per
bucket: by word the counts of words and pairs with their histories' sums, by history the sums alone. Both grow with the
corpus; the driver sees a few sums.

score() takes any documents. Tokens go to their word's bucket, where the pair's count, the word's count and, but for
rare histories, alpha(h) are at hand. Tokens that back off from a history that the bucket doesn't know go on to the
history's bucket. The model's tables are stored by bucket, so that only tokens are shuffled. Each bucket is a task of its
own, which unpacks the tokens of one batch of texts after the other.
"""

from __future__ import annotations

import pickle
from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, dropped, give_back, stored, stored_buckets

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Hashes of what stands for the start and the end of a text; no word is empty or holds a blank.
START, END = b" ", b""
#: Counts up to this are discounted.
K = 5
#: Tokens of a bucket, about, and the fewest buckets; bytes that a token takes in a text, about.
BUCKET_TOKENS, LEAST_BUCKETS, TOKEN_BYTES = 5_000_000, 24, 6
#: Tokens that a map task packs at once; bytes that Spark and Python hand to each other at once, about; pairs that a bucket adds up at once, about.
BATCH_TOKENS, SENT_BYTES, ADDED_PAIRS = 4_500_000, 4 << 20, 500_000
#: Rows, about, spread over the whole table, that are read to find words of a large share; they only steer how work is spread. A word with
#: HOT_SHARE of a bucket's share of the corpus is spread.
HOT_ROWS, HOT_SHARE = 4_000, 1 / 8
#: The sums of a history: its count, its words by pair count 1-5 and by word count 1-5, the sum of larger word counts.
PARTS = 12


def _hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, 1)


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(next(t for t, most in ((np.uint8, 1 << 8), (np.uint16, 1 << 16), (np.uint32, 1 << 32), (np.uint64, 1 << 65)) if top < most))


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def _unpack(data: bytes) -> tuple:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


@contextmanager
def _small_batches(spark: SparkSession):
    """Spark hands SENT_BYTES at once to Python in queries that run meanwhile; its default, 64 MB, stands in buffers outside the heap, once or twice over for each task, and again in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(SENT_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def is_held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


class _Words(dict):
    """Numbers words in the order in which they come; 0 and 1 are the start and the end of a text."""

    def __init__(self):
        super().__init__({START: 0, END: 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _batches(docs: DataFrame, flush, columns: list[Column], schema: str) -> DataFrame:
    """flush(hashes of the words, sorted, places of the words and of the words before them, text of each, other columns of each text) -> rows (bucket, data), for batches of BATCH_TOKENS; long texts are cut."""

    def run(batches):
        import pyarrow as pa

        words, ids, rows, n = _Words(), [], [], 0

        def out():
            hashes = np.fromiter(map(_hash, words), np.uint64, len(words))
            words.clear()
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            w, h = place[np.concatenate([x[1:] for x in ids])], place[np.concatenate([x[:-1] for x in ids])]
            d = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) - 1 for x in ids])
            ids.clear()
            found, held = [], 0
            for row in flush(hashes[order], w, h, d, rows):
                found.append(row)
                held += len(row[1])
                if held >= SENT_BYTES:
                    yield batch_of(found)
                    found, held = [], 0
            if found:
                yield batch_of(found)
            del w, h, d, found, row
            give_back()

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for text, *row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True):
                    found = [START, *(text or "").encode().translate(_LOWER).split(), END]
                    for k in range(0, len(found) - 1, BATCH_TOKENS):
                        ids.append(np.fromiter(map(words.__getitem__, found[k : k + BATCH_TOKENS + 1]), np.int32))
                        rows.append(row)
                        n += len(ids[-1]) - 1
                        if n >= BATCH_TOKENS:
                            yield from out()
                            words, ids, rows, n = _Words(), [], [], 0
        if n:
            yield from out()

    return docs.select(*columns).mapInArrow(run, schema)


def _bucket_of(hashes: np.ndarray, w: np.ndarray, h: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    """That of the word's hash; a hot word's pairs are dealt by both hashes."""
    own = (hashes % np.uint64(buckets)).astype(np.int32)
    b = own[w]
    spread = np.isin(hashes, hot)[w]
    if spread.any():
        mixed = hashes[w[spread]] ^ (hashes[h[spread]] * np.uint64(0x9E3779B97F4A7C15))
        b[spread] = ((mixed >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
    return b


def _slices(b: np.ndarray):
    """(value, slice) of each run of a sorted array."""
    edges = np.flatnonzero(np.diff(b)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)], strict=True):
        if hi > lo:
            yield int(b[lo]), slice(lo, hi)


def bucket_keys(spark: SparkSession, buckets: int) -> np.ndarray:
    """By number of a bucket, what stands for it in tables: Spark's hash sends each of these to a task of its own, where the numbers themselves would meet in some."""
    at = F.pmod(F.hash("id"), F.lit(buckets)).alias("at")
    found = dict(spark.range(64 * buckets).groupBy(at).agg(F.min("id")).collect())
    return np.array([found[i] for i in range(buckets)], np.int64)


def _dealt(hashes: np.ndarray, w: np.ndarray, h: np.ndarray, keys: np.ndarray, hot: np.ndarray):
    """(key of a bucket, places of its tokens, those places' words and histories as one sorted number) for each bucket."""
    b = _bucket_of(hashes, w, h, len(keys), hot)
    if len(keys) < 1 << 15:  # such are sorted in one pass
        b = b.astype(np.int16)
    order = np.argsort(b, kind="stable")
    for bucket, s in _slices(b[order]):
        at = order[s]
        key = (w[at].astype(np.int64) << 32) | h[at]
        by = np.argsort(key)
        yield int(keys[bucket]), at[by], key[by]


def _pair_blobs(docs: DataFrame, keys: np.ndarray, hot: np.ndarray, text_col: str) -> DataFrame:
    """bucket, data: the different pairs of a batch whose words fall into the bucket, by the hashes of word and history, and how often each comes."""

    def flush(hashes, w, h, _, rows):
        for bucket, _, key in _dealt(hashes, w, h, keys, hot):
            first = np.flatnonzero(np.diff(key, prepend=-1))
            count = np.diff(np.append(first, len(key)))
            wu, wn = np.unique(key[first] >> 32, return_counts=True)
            hu, hx = np.unique(key[first] & 0xFFFFFFFF, return_inverse=True)
            yield bucket, _pack(hashes[wu], _small(wn), hashes[hu], _small(hx), _small(count))

    return _batches(docs, flush, [F.col(text_col).alias("text")], "bucket long, data binary")


def _token_blobs(docs: DataFrame, keys: np.ndarray, hot: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """bucket, data: the tokens of a batch of texts whose words fall into the bucket, sorted by the hashes of word and history, and the text of each."""

    def flush(hashes, w, h, d, rows):
        row, doc, held_out = (np.array(x) for x in zip(*rows, strict=True))
        for bucket, at, key in _dealt(hashes, w, h, keys, hot):
            wu, wn = np.unique(key >> 32, return_counts=True)
            hu, hx = np.unique(key & 0xFFFFFFFF, return_inverse=True)
            du, dx = np.unique(d[at], return_inverse=True)
            yield bucket, _pack(hashes[wu], _small(wn), hashes[hu], _small(hx), row[du], doc[du], held_out[du], _small(dx))

    columns = [F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), is_held_out(F.col(id_col)).alias("held_out")]
    return _batches(docs, flush, columns, "bucket long, data binary")


#: Stands for a null id in the arrays.
NO_ID = -(1 << 63)


def _joined(parts: list[tuple], at: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """All hashes that the parts have at this place, sorted, and for each part where its own are."""
    whole = np.unique(np.concatenate([p[at] for p in parts]))
    return whole, [np.searchsorted(whole, p[at]).astype(np.int32) for p in parts]


def _where(whole: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each of asked is in the sorted array, -1 if it isn't there."""
    if not len(whole):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(whole, asked), len(whole) - 1)
    return np.where(whole[at] == asked, at, -1)


@dataclass
class _Bucket:
    """The training counts of a bucket: hashes of words and histories, sorted; pairs, sorted by word, then history."""

    words: np.ndarray
    word_count: np.ndarray
    histories: np.ndarray
    pair_word: np.ndarray
    pair_history: np.ndarray
    count: np.ndarray

    @classmethod
    def added(cls, blobs) -> _Bucket:
        """The sum of what batches have packed. Pairs are added up in ranges of words, about ADDED_PAIRS at a time."""
        parts = [_unpack(x) for x in blobs]
        words, ws = _joined(parts, 0)
        histories, hs = _joined(parts, 2)
        ends = [np.cumsum(p[1], dtype=np.int64) for p in parts]
        upto = np.cumsum(sum(np.bincount(w, weights=p[1], minlength=len(words)) for p, w in zip(parts, ws, strict=True)))
        cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1], ADDED_PAIRS)), len(words)))
        word_count, found = np.zeros(len(words), np.int64), []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            keys, counts = [], []
            for p, w, h, end in zip(parts, ws, hs, ends, strict=True):
                i, k = np.searchsorted(w, (lo, hi))
                if i < k:
                    s = slice(end[i] - p[1][i], end[k - 1])
                    keys.append((np.repeat(w[i:k], p[1][i:k]).astype(np.int64) << 32) | h[p[3][s]])
                    counts.append(p[4][s])
            key, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key)
            key, n = key[order], n[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            n = np.add.reduceat(n, first, dtype=np.int64)
            w, h = (key[first] >> 32).astype(np.int32), (key[first] & 0xFFFFFFFF).astype(np.int32)
            word_count[lo:hi] = np.bincount(w - lo, weights=n, minlength=hi - lo)
            found.append((_small(w), _small(h), _small(n)))
        del parts, ws, hs, ends
        return cls(words, word_count, histories, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def packed(self) -> bytes:
        return _pack(self.words, _small(self.word_count), self.histories, _small(self.pair_word), _small(self.pair_history), _small(self.count))

    @classmethod
    def read(cls, data: bytes) -> _Bucket:
        return cls(*_unpack(data))


def _parts(b: _Bucket) -> np.ndarray:
    """PARTS by history of the bucket, over its own pairs; word_count must be that of the corpus."""
    c, h, n = b.count, b.pair_history, len(b.histories)
    cw = b.word_count[b.pair_word]
    out = np.zeros((PARTS, n), np.uint64)
    out[0] = np.bincount(h, weights=c, minlength=n)
    for r in range(1, K + 1):
        out[r] = np.bincount(h[c == r], minlength=n)
        out[K + r] = np.bincount(h[cw == r], minlength=n)
    big = cw > K
    np.add.at(out[2 * K + 1], h[big], cw[big].astype(np.uint64))
    return out


def good_turing(n: list[int]) -> list[float]:
    """d(1) ... d(K) from n(1) ... n(K + 1), the numbers of items seen so often.

    The largest k up to K for which all discounts lie between 0 and 1 is used, larger counts aren't discounted; if there
    is none, half a count is taken from each.
    """
    for k in range(K, 0, -1):
        if all(n[: k + 1]):
            common = (k + 1) * n[k] / n[0]
            if common < 1:
                d = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d):
                    return d + [1.0] * (K - k)
    return [(r - 0.5) / r for r in range(1, K + 1)]


@dataclass(frozen=True)
class Katz:
    """A fitted model: sums on the driver, and the stored tables ngrams (bucket, data, sums) and histories (bucket, data)."""

    ngrams: DataFrame
    histories: DataFrame
    keys: np.ndarray
    hot: np.ndarray
    hot_counts: np.ndarray
    tokens: int
    words: int
    word_discounts: list[float]
    pair_discounts: list[float]
    unknown: float
    scale: float

    def word_prob(self, c: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.word_discounts])
        p = np.where(c <= K, d[np.minimum(c, K)], 1.0) * c * self.scale
        return np.where(c > 0, p, self.unknown)

    def weights(self, parts: tuple) -> tuple[np.ndarray, np.ndarray]:
        """log10 of D(h) and of alpha(h)."""
        count = parts[0].astype(np.float64)
        kept = count.copy()
        below = parts[2 * K + 1] * self.scale
        for r in range(1, K + 1):
            kept -= (1 - self.pair_discounts[r - 1]) * r * parts[r]
            below += self.word_discounts[r - 1] * r * self.scale * parts[K + r]
        total = np.where(count - kept > 0, count, count + 1)
        alpha = np.where(count > 0, (1 - kept / np.maximum(total, 1)) / np.maximum(1 - below, 1e-300), 1.0)
        return np.log10(np.maximum(total, 1)), np.log10(alpha)


def hot_words(docs: DataFrame, text_col: str, rows: int, share: float) -> np.ndarray:
    """Hashes, sorted, of the words that hold this share of a spread sample, and of the end of a text."""
    sample: Counter = Counter({END: 1})
    total = docs.count()
    for r in docs.select(text_col).sample(min(1.0, rows / max(total, 1)), 1).toLocalIterator():
        sample.update((r[0] or "").encode().translate(_LOWER).split())
        sample[END] += 1
    least = share * sum(sample.values())
    return np.array(sorted(_hash(w) for w, n in sample.items() if n >= least or w == END), np.uint64)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Katz:
    """Counts over the rows that are not held out. Null text counts as empty; a null id counts as not held out; without rows every word is unknown."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-(size // TOKEN_BYTES) // BUCKET_TOKENS))
    keys = bucket_keys(docs.sparkSession, buckets)
    hot = hot_words(docs, text_col, HOT_ROWS * buckets // LEAST_BUCKETS, HOT_SHARE / buckets)

    def added(table):
        import pyarrow as pa

        b = _Bucket.added(x.as_py() for x in table.column("data"))
        cw = b.word_count[~np.isin(b.words, hot)]
        at = _where(b.words, hot)
        hot_counts = np.where(at >= 0, b.word_count[at], 0) if len(b.words) else np.zeros(len(hot), np.int64)
        stat = [int(b.word_count.sum()), len(cw), *(int((cw == r).sum()) for r in range(1, K + 2)), *(int((b.count == r).sum()) for r in range(1, K + 2)), *hot_counts.tolist()]
        data = b.packed()
        del b, cw, at
        give_back()
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "stat": pa.array([stat], pa.list_(pa.int64())), "data": pa.array([data], pa.binary())})

    train = docs.where(~is_held_out(F.col(id_col)))
    counted = _pair_blobs(train, keys, hot, text_col).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(added, "bucket long, stat array<long>, data binary")
    with _small_batches(docs.sparkSession):
        pairs = stored_buckets(counted, "katz-pairs", "bucket", buckets)
    sums = pairs.agg(*[F.sum(F.col("stat")[i]).alias(f"s{i}") for i in range(2 + 2 * (K + 1) + len(hot))]).first()
    stat = [int(x or 0) for x in sums]
    tokens, hot_counts = stat[0], np.array(stat[2 + 2 * (K + 1) :], np.int64)
    n = [x + int((hot_counts == r).sum()) for r, x in enumerate(stat[2 : 2 + K + 1], 1)]
    dw = good_turing(n)
    unknown = sum((1 - d) * (r + 1) * n[r] for r, d in enumerate(dw)) / max(tokens, 1)
    scale = 1 / max(tokens, 1)
    if unknown <= 0:
        unknown, scale = 1 / (tokens + 1), 1 / (tokens + 1)
    with _small_batches(docs.sparkSession):
        ngrams, histories = _with_sums(pairs, keys, hot, hot_counts)
    dropped(pairs)
    return Katz(ngrams, histories, keys, hot, hot_counts, tokens, stat[1] + int((hot_counts > 0).sum()), dw, good_turing(stat[2 + K + 1 : 2 + 2 * (K + 1)]), unknown, scale)


def _with_sums(pairs: DataFrame, keys: np.ndarray, hot: np.ndarray, hot_counts: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The tables of the model: histories' sums over all buckets, at the history's own bucket and at each that has it."""
    row = "kind string, bucket long, part long, data binary"
    kinds = ["kind", "bucket", "part", "data"]
    buckets = len(keys)

    def sent(batches):
        import pyarrow as pa

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = _Bucket.read(data)
                at = _where(b.words, hot)
                b.word_count = b.word_count.astype(np.int64)
                b.word_count[at[at >= 0]] = hot_counts[at >= 0]
                parts, home = _parts(b), (b.histories % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                found = [(keys[to], _pack(b.histories[order[s]], *map(_small, parts[:, order[s]]))) for to, s in _slices(home[order])]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(found), pa.int64()), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "part", "data"])

    def whole(table):
        """The parts of a history are summed, and each bucket gets the sums of those that it has, in its order."""
        import pyarrow as pa

        part = table.column("part")[0].as_py()
        asked = [(b, _unpack(x)) for b, x in zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True)]
        ids, at = _joined([x for _, x in asked], 0)
        sums = np.zeros((PARTS, len(ids)), np.uint64)
        for (_, x), places in zip(asked, at, strict=True):
            for i in range(PARTS):
                sums[i, places] += x[1 + i].astype(np.uint64)
        rows = [("own", part, part, _pack(ids, *map(_small, sums)))]
        rows += [("sums", bucket, part, _pack(*map(_small, sums[:, places]))) for (bucket, _), places in zip(asked, at, strict=True)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=kinds)

    def put(left, right):
        """A bucket's counts, and the sums of its histories in their order."""
        import pyarrow as pa

        data = left.column("data")[0].as_py()
        b = _Bucket.read(data)
        home = (b.histories % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        places = {int(keys[to]): order[s] for to, s in _slices(home[order])}
        sums = np.zeros((PARTS, len(b.histories)), np.uint64)
        for part, x in zip(right.column("part").to_pylist(), right.column("data").to_pylist(), strict=True):
            for i, v in enumerate(_unpack(x)):
                sums[i, places[part]] = v
        return pa.table({"bucket": left.column("bucket"), "data": left.column("data"), "sums": pa.array([_pack(*map(_small, sums))], pa.binary())})

    parts = pairs.select("bucket", "data").mapInArrow(sent, "bucket long, part long, data binary")
    back = stored(parts.repartition(buckets, "part").groupBy("part").applyInArrow(whole, row), "katz-sums", "kind")
    histories = stored_buckets(back.where("kind = 'own'").select("bucket", "data").repartition(buckets, "bucket"), "katz-histories", "bucket", buckets)
    sums = back.where("kind = 'sums'").select("bucket", "part", "data")
    ngrams = pairs.select("bucket", "data").groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(put, "bucket long, data binary, sums binary")
    ngrams = stored_buckets(ngrams, "katz-ngrams", "bucket", buckets)
    dropped(back)
    return ngrams, histories


def score(docs: DataFrame, model: Katz, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, whatever the model was fitted on: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text is its words, A-Z lower-cased, and one end. Null text counts as empty, long ones are cut for packing only. A
    null id counts as not held out; rows that repeat an id are scored each. An empty table gives no rows; other columns
    are ignored.
    """
    keys, fixed = model.keys, {k: v for k, v in vars(model).items() if k not in ("ngrams", "histories")}
    columns = "row long, doc long, held_out boolean, n long, known long, base double, score double, part long, data binary"
    names = ["row", "doc", "held_out", "n", "known", "base", "score", "part", "data"]

    def evaluate(left, right):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary()]
        known = _Known(Katz(None, None, **fixed), *(right.column(x)[0].as_py() if right.num_rows else None for x in ("data", "sums")))
        texts, away = [[np.empty(0, k.to_pandas_dtype())] for k in kinds[:7]], []
        for x in left.column("data"):  # one batch's tokens after the other
            found, lost = known.evaluated(_unpack(x.as_py()))
            for column, values in zip(texts, found, strict=True):
                column.append(values)
            away.append(lost)
        del known
        # Histories that this bucket doesn't know: their weight comes from their own bucket.
        asked, row = (np.concatenate([x[i] for x in away]) if away else np.empty(0, np.int64) for i in (0, 1))
        home = (asked % np.uint64(len(keys))).astype(np.int64)
        order = np.argsort(home, kind="stable")
        blobs = [(keys[to], _pack(asked[order[s]], row[order[s]])) for to, s in _slices(home[order])]
        arrays = [pa.array(np.concatenate(x), k) for x, k in zip(texts, kinds, strict=False)]
        del texts, away
        give_back()
        n = len(arrays[0])
        own = pa.Table.from_arrays([*arrays, *(pa.nulls(n, k) for k in kinds[7:])], names=names)
        rest = pa.Table.from_arrays([*(pa.nulls(len(blobs), k) for k in kinds[:7]), pa.array([x for x, _ in blobs], kinds[7]), pa.array([x for _, x in blobs], kinds[8])], names=names)
        return pa.concat_tables([own, rest])

    def weigh(left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:  # a history without any pair weighs nothing
            return pa.table({"row": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        m = Katz(None, None, **fixed)
        ids, *sums = _unpack(right.column("data")[0].as_py())
        _, alpha = m.weights(sums)
        parts = [_unpack(x) for x in left.column("data").to_pylist()]
        at, row = _where(ids, np.concatenate([p[0] for p in parts])), np.concatenate([p[1] for p in parts])
        rows, back = np.unique(row[at >= 0], return_inverse=True)
        return pa.table({"row": rows, "score": np.bincount(back, weights=alpha[at[at >= 0]], minlength=len(rows))})

    blobs = _token_blobs(docs, keys, model.hot, id_col, text_col)
    with _small_batches(docs.sparkSession):
        found = stored(blobs.groupBy("bucket").cogroup(model.ngrams.groupBy("bucket")).applyInArrow(evaluate, columns), "katz-scores")
    asked = found.where("part is not null").select(F.col("part").alias("bucket"), "data")
    weights = asked.groupBy("bucket").cogroup(model.histories.groupBy("bucket")).applyInArrow(weigh, "row long, score double")
    own = found.where("row is not null").select("row", "doc", "held_out", "n", "known", "base", "score")
    rest = weights.select("row", *[F.lit(None).cast(t).alias(c) for c, t in (("doc", "long"), ("held_out", "boolean"), ("n", "long"), ("known", "long"), ("base", "double"))], "score")
    rows = own.unionAll(rest).groupBy("row").agg(F.max("doc").alias("doc"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n", "known", "base", "score")])
    per_token = float(np.log10(model.tokens + 0.1 * (model.words + 1)))
    return rows.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias(id_col), "held_out", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n") * F.lit(per_token)).alias("base_score"), "score",
    )


class _Known:
    """What a bucket knows of the model, to be asked about the tokens of one batch of texts after the other."""

    def __init__(self, model: Katz, data: bytes | None, sums: bytes | None):
        none = np.empty(0, np.int64)
        self.model = model
        self.bucket = b = _Bucket.read(data) if data else _Bucket(none.view(np.uint64), none, none.view(np.uint64), none, none, none)
        self.total, self.alpha = model.weights(_unpack(sums)) if data else (np.empty(0), np.empty(0))
        self.key = (b.pair_word.astype(np.int64) << 32) | b.pair_history
        b.pair_word = b.pair_history = none

    def evaluated(self, part: tuple) -> tuple[tuple, tuple]:
        """Of _token_blobs(): the texts' row, doc, held_out, and their sums here: n, known, base, score; hashes of the histories that aren't known here, and the row of each."""
        words, times, histories, hx, row, doc, held_out, d = part
        m, b = self.model, self.bucket
        word, history = _where(b.words, words), _where(b.histories, histories)
        cw = np.where(word >= 0, b.word_count[word].astype(np.int64), 0) if len(b.words) else np.zeros(len(words), np.int64)
        at = _where(words, m.hot)
        cw[at[at >= 0]] = m.hot_counts[at >= 0]
        pw = np.log10(m.word_prob(cw))
        # The recursion: the pair's own estimate where it was seen, else the history's weight and the word's estimate.
        token_word = np.repeat(np.arange(len(words)), times)
        first = np.flatnonzero((np.diff(token_word, prepend=-1) != 0) | (np.diff(hx.astype(np.int64), prepend=-1) != 0))
        w, h = word[token_word[first]], history[hx[first]]
        pair = _where(self.key, np.where((w >= 0) & (h >= 0), (w << 32) | h, -1))
        c = np.where(pair >= 0, b.count[pair].astype(np.int64), 0) if len(self.key) else np.zeros(len(pair), np.int64)
        by_count = np.array([0.0, *m.pair_discounts])
        seen = np.log10(np.where(c <= K, by_count[np.minimum(c, K)], 1.0) * c, where=c > 0, out=np.zeros(len(c)))
        seen -= self.total[h] if len(self.total) else 0
        backoff = pw[token_word[first]] + (np.where(h >= 0, self.alpha[h], 0.0) if len(self.alpha) else 0.0)
        value = np.repeat(np.where(c > 0, seen, backoff), np.diff(np.append(first, len(hx))))
        n = len(row)
        sums = np.bincount(d, minlength=n), np.bincount(d, weights=(cw > 0)[token_word], minlength=n).astype(np.int64), np.bincount(d, weights=np.log10(cw + 0.1)[token_word], minlength=n), np.bincount(d, weights=value, minlength=n)
        away = np.flatnonzero((history < 0)[hx])
        return (row, doc, held_out, *sums), (histories[hx[away]], row[d[away]])


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs))
