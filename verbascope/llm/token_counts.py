"""Token counts by a linear longest-match automaton.

A trie of the vocabulary's pieces gets failure links: where a node has no child for the next letter, its link leads to
the node that stands for what greedy longest-match leaves over after its pieces are popped, and the node knows how many
those are. One pass over a word's letters then gives the number of pieces that greedy longest-match splits it into,
without building any piece; each letter is read once, and each link followed pops at least one piece.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import END, byte_letters, vocabulary_path
from .common import LOWER_AZ, Cache, words_of


class PieceCounter:
    """pieces may stand anywhere in a word. A word that they can't cover counts as one unknown token."""

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        whole = {0: False}
        for piece in pieces:
            if not piece:
                continue
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    whole[to] = False
                at = to
            whole[at] = True
        n = len(self.next)
        self.link, self.pops = [-1] * n, [0] * n
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                todo.append(v)
                if whole[v]:
                    self.link[v], self.pops[v] = 0, 1
                    continue
                z, popped = self.link[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    popped += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.next[z][c], popped

    def count(self, word: str) -> int:
        """Pieces of the word; 0 if they can't cover it."""
        following, link, pops, at, n = self.next, self.link, self.pops, 0, 0
        for c in word:
            while (to := following[at].get(c)) is None:
                n += pops[at]
                at = link[at]
                if at < 0:
                    return 0
            at = to
        while at:
            n += pops[at]
            at = link[at]
            if at < 0:
                return 0
        return n


def vocabulary_pieces(path: str) -> set[str]:
    """The tokens of a byte-level vocabulary file as text, without end marks; those that are no whole characters are left out."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    found = set()
    for t in vocab:
        try:
            found.add(bytes(byte_of[c] for c in t.removesuffix(END)).decode())
        except UnicodeDecodeError:
            continue
    return found


@lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    return PieceCounter(vocabulary_pieces(path))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_words, n_tokens, n_unknown.

    Words are runs without ASCII white space, A-Z lower-cased. An unknown word counts as one token and in n_unknown.
    Null and empty texts have zero of each; ids aren't looked at; an empty table gives no rows; other columns are ignored.
    """
    path = vocabulary or vocabulary_path()

    def run(batches):
        import pyarrow as pa

        counts = Cache(load(path).count)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for text in part.column(1).to_pylist():
                    found = [*map(counts.__getitem__, words_of((text or "").translate(LOWER_AZ) if text and not text.isascii() else (text or "").lower()))]
                    unknown = found.count(0)
                    rows.append((len(found), sum(found) + unknown, unknown))
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long")
    return out.withColumnRenamed("id", id_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
