"""Quality classifier on supervised subword embeddings.

A document is the average of the embeddings of its words and of their character n-grams, hashed to a fixed number of
buckets; a softmax over two classes follows. Embeddings and output weights are learned together by stochastic gradient
descent in numpy, on a bounded sample of labelled rows. As average and output are both linear, scoring needs only one
number per bucket: the difference of the two outputs that its embedding makes.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, words_of

BUCKETS = 1 << 16
DIM = 12
NGRAMS = (2, 4)
EPOCHS = 6
RATE = 0.5
#: The most labelled rows of each class that are read for training, in the order of a hash of their ids.
TRAIN_ROWS = 1_200
THRESHOLD = 0.3
#: The word 2-gram of a word and itself has one bucket for all words, and counts as so many n-grams.
SAME, SAME_WEIGHT = zlib.crc32(b"\0same") % BUCKETS, 16


def repeats(words: list[str]) -> int:
    """Words that equal the one before them."""
    return sum(map(eq, words, words[1:]))


def features(word: str, buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS) -> list[int]:
    """The buckets of a word and of its n-grams, with marks at its ends."""
    marked = f"<{word}>".encode()
    found = [zlib.crc32(marked)]
    size = len(marked)
    for n in range(ngrams[0], ngrams[1] + 1):
        found += [zlib.crc32(marked[i : i + n]) for i in range(size - n + 1)]
    return [x % buckets for x in found]


@dataclass(frozen=True)
class Model:
    """margin: by bucket, the score for class 1 less that for class 0; bias likewise."""

    margin: bytes
    bias: float

    def scorer(self):
        """text -> score. Sums run per word over the word's own buckets, so a text's score doesn't depend on other texts."""
        margin = np.frombuffer(self.margin, dtype=np.float64)
        cache = Cache(lambda w: (float(margin[f := features(w)].sum()), len(f)), 150_000)

        def score(text: str) -> float:
            words = words_of(text)
            if not words:
                return 1 / (1 + math.exp(-self.bias))
            sums, counts = zip(*map(cache.__getitem__, words), strict=True)
            same = SAME_WEIGHT * repeats(words)
            mean = (math.fsum(sums) + same * float(margin[SAME])) / (sum(counts) + same)
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, mean + self.bias))))

        return score


def train(rows: list[tuple[str, int]], seed: int = 7, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Rows are (text, label 0 or 1). Without rows every score is one half."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((2, DIM)), np.zeros(2)
    cache = Cache(features, 100_000)
    docs = []
    for text, label in rows:
        counts: Counter = Counter()
        words = words_of(text)
        for w, k in Counter(words).items():
            for f in cache[w]:
                counts[f] += k
        if same := repeats(words):
            counts[SAME] += SAME_WEIGHT * same
        if counts:
            share = np.fromiter(counts.values(), float) / sum(counts.values())
            docs.append((np.fromiter(counts.keys(), np.int64), share, label))
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share, label = docs[k]
            hidden = share @ emb[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            now = rate * (1 - step / steps)
            back = out.T @ p
            out -= now * np.outer(p, hidden)
            bias -= now * p * 0.1
            emb[ids] -= now * 10 * share[:, None] * back[None, :]
            step += 1
    return Model((emb @ (out[1] - out[0])).tobytes(), float(bias[1] - bias[0]))


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """At most `most` rows of each class, whole texts, outside fold 0. Only these come to the driver. Rows without id or with another label than 0 and 1 are left out; an id labelled twice counts twice."""
    usable = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id")) != 0)
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = usable.where("quality = 0").orderBy(*order).limit(most).unionAll(usable.where("quality = 1").orderBy(*order).limit(most))
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "quality"))  # 2 * most rows of two numbers
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, F.col("doc_id") == F.col("_id"))
    return [(r[1], r[2]) for r in sorted(found.select("doc_id", "text", "quality").toLocalIterator(), key=lambda r: (r[0], r[2], r[1]))]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score. Null and empty texts get the score of the bias alone; ids aren't looked at; other columns are ignored."""

    def run(batches):
        import pyarrow as pa

        score = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([score(t or "") for t in part.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score")


def accepted_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns, whatever their names; a filter in place, without a join. Null and empty texts have the score of the bias; ids aren't looked at, repeated rows are judged each; an empty table gives no rows."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        score = model.scorer()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield part.filter(pa.array([score(t or "") >= threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    return train(training_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_documents(docs, fitted(spark, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
