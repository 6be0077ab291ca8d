"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

Whether a token boundary stands at some place depends on what follows only up to a distance that the merge list fixes.
MergeList computes a sufficient distance. WordEncoder then reads a word in pieces, emits each token as soon as that many
bytes follow it, and keeps no more than a fixed number of bytes. TextEncoder feeds it from a text read in blocks, so
that memory doesn't grow with the text or with the longest word. TextDecoder turns ids to text token by token: a state
machine over the bytes, which keeps those of an unfinished character.

Between words both machines are in one and the same state, so what they make of a word is remembered by the word; that
changes no result. Runs without white space that are longer than CUT go through both in parts and aren't remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, give_back

END = "</w>"
#: White space as the vocabulary's \s has it.
WS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WS}\p{{L}}\p{{N}}]+")
_GAP = regex.compile(f"[{WS}]+")
_CHUNK = regex.compile(f"[^{WS}]+")
#: No character below this, nor a CJK ideograph or Hangul syllable, ever joins the one before it in NFC.
_SAFE = regex.compile(r"[\x00-\u02ff\u4e00-\u9fff\uac00-\ud7a3]")
BLOCK, CUT = 1 << 16, 512
#: Words and runs that a task remembers, in each of two generations.
REMEMBERED = 250_000
#: A merge's rank and the id that it makes, in one number.
BITS = 24
MASK, NONE = (1 << BITS) - 1, 1 << 62


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeList:
    """Tokens, merges by rank, and the lookahead that suffices for them."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.vocab, self.tokens = vocab, {i: t for t, i in vocab.items()}
        letters = byte_letters()
        self.plain = [vocab[c] for c in letters]
        self.ending = [vocab[c + END] for c in letters]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.length = {i: len(t.removesuffix(END)) for t, i in vocab.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.codes = {p: rank << BITS | made for p, (rank, made) in self.pairs.items()}
        self.lookahead = self._lookahead()
        self.longest = max(self.length.values(), default=1)

    def _lookahead(self) -> int:
        """Bytes after a place that suffice to know whether a boundary stands there in the end.

        A merge (c, d) at a place needs d to form in time, which needs d's bytes, and needs that no earlier merge takes
        a last part of d away to its right: one whose left side is d itself, or a part on d's right edge before that
        part is used up. Each such merge has a lower rank, so one pass in order of rank finds the longest chain.
        """
        best: dict[int, int] = {}  # by left side, over the merges so far
        edge: dict[int, int] = {}  # by token: the most that parts on its right edge may need
        most = 0
        for (a, b), (_, made) in sorted(self.pairs.items(), key=lambda x: x[1][0]):
            need = self.length[b] + max(best.get(b, 0), edge.get(b, 0))
            most = max(most, need)
            edge[made] = max(edge.get(made, 0), best.get(b, 0), edge.get(b, 0))
            best[a] = max(best.get(a, 0), need)
        return most

    def merged(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost first among equals."""
        get = self.codes.get
        codes = [get(p, NONE) for p in zip(ids, ids[1:], strict=False)]
        while codes and (found := min(codes)) != NONE:
            i = codes.index(found)
            ids[i : i + 2] = [found & MASK]
            del codes[i]
            if i < len(codes):
                codes[i] = get((ids[i], ids[i + 1]), NONE)
            if i:
                codes[i - 1] = get((ids[i - 1], ids[i]), NONE)
        return ids

    def word(self, data: bytes) -> list[int]:
        return self.merged([*map(self.plain.__getitem__, data[:-1]), self.ending[data[-1]]])


class WordEncoder:
    """One word at a time, in pieces: feed() and end() return the ids that have become stable."""

    def __init__(self, merges: MergeList):
        self.merges, self.rest = merges, b""
        self.step = 2 * (merges.lookahead + merges.longest) + 64

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.step):
            self.rest += data[at : at + self.step]
            if len(self.rest) >= self.step:
                self._emit(out)
        return out

    def _emit(self, out: list[int]) -> None:
        m, at = self.merges, 0
        stable = len(self.rest) - 1 - m.lookahead  # the last byte may yet end the word
        for i in m.merged([m.plain[b] for b in self.rest]):
            if at + m.length[i] > stable:
                break
            out.append(i)
            at += m.length[i]
        self.rest = self.rest[at:]

    def end(self) -> list[int]:
        rest, self.rest = self.rest, b""
        return self.merges.word(rest) if rest else []

    def whole(self, word: str) -> tuple[int, ...]:
        return (*self.feed(word.encode()), *self.end())


class TextEncoder:
    """A text to ids: special tokens, normalisation (NFC, lower case), pieces, merges.

    view makes of the ids of a whole run without white space what encode() returns for it, and is remembered with it;
    part(ids, last) does so for a run that comes in parts, in order.
    """

    def __init__(self, merges: MergeList, special: dict[str, int], view: Callable = list, part: Callable = lambda ids, last: list(ids)):
        self.merges, self.special, self.view, self.part = merges, special, view, part
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = Cache(WordEncoder(merges).whole, REMEMBERED)
        self.chunks = Cache(self._chunk, REMEMBERED)

    def _chunk(self, raw: str):
        return self.view([i for p in _PIECE.findall(normal(raw)) for i in self.words[p]])

    def encode(self, text: str) -> Iterator[list]:
        """Lists of views, in order; each list is of one block."""
        parts = self.splitter.split(text) if self.splitter and any(s in text for s in self.special) else [text]
        for part in parts:
            if self.splitter and part in self.special:
                yield [self.view([self.special[part]])]
            else:
                yield from self._plain(part)

    def _plain(self, text: str) -> Iterator[list]:
        at, n, run = 0, len(text), _LongChunk(self.merges)
        while at < n:
            stop, whole = min(at + BLOCK, n), True
            if stop < n:  # a block ends before white space, or inside a run that fills it
                last = None
                for last in _GAP.finditer(text, max(at + 1, stop - 4 * CUT), stop):
                    pass
                stop, whole = (last.start(), True) if last else (stop, False)
            block, at = text[at:stop], stop
            if run.open and not _GAP.match(block, 0, 1):
                head = _CHUNK.match(block).end()
                ids = [i for found in run.feed(block[:head]) for i in found]
                if head == len(block) and not whole:
                    yield [self.part(ids, False)]
                    continue
                yield [self.part(ids + run.end(), True)]
                block = block[head:]
            elif run.open:
                yield [self.part(run.end(), True)]
            chunks = runs(block)
            if whole and max(map(len, chunks), default=0) <= CUT:
                yield [*map(self.chunks.__getitem__, chunks)]
                continue
            for i, c in enumerate(chunks):
                if i + 1 == len(chunks) and not whole:
                    yield [self.part([i for found in run.feed(c) for i in found], False)]
                elif len(c) <= CUT:
                    yield [self.chunks[c]]
                else:
                    yield [self.part([i for found in run.feed(c) for i in found] + run.end(), True)]
        if run.open:
            yield [self.part(run.end(), True)]


def runs(block: str) -> list[str]:
    """Runs without white space; str.split() would also split at U+001C-U+001F."""
    return _CHUNK.findall(block) if any(map(block.__contains__, "\x1c\x1d\x1e\x1f")) else block.split()


def normal(raw: str) -> str:
    """NFC, then lower case letter by letter: str.lower() alone would look at a sigma's neighbours."""
    if not raw.isascii():
        raw = unicodedata.normalize("NFC", raw).replace("Σ", "σ")
    return raw.lower()


class _LongChunk:
    """A run without white space, of any length, fed in parts. Its last piece stays open until the run goes on or ends."""

    def __init__(self, merges: MergeList):
        self.word, self.raw, self.tail, self.kind, self.open = WordEncoder(merges), "", "", "", False

    def feed(self, raw: str) -> Iterator[list[int]]:
        self.open = True
        self.raw += raw
        # What may still join the next part in NFC stays back.
        cut = len(self.raw) - 1
        while cut > 0 and not _SAFE.match(self.raw[cut]):
            cut -= 1
        ready, self.raw = self.raw[:cut], self.raw[cut:]
        yield from self._pieces(normal(ready), False)

    def end(self) -> list[int]:
        if not self.open:
            return []
        out = [i for ids in self._pieces(normal(self.raw), True) for i in ids]
        out += self.word.end()
        self.raw, self.tail, self.kind, self.open = "", "", "", False
        return out

    def _pieces(self, text: str, last: bool) -> Iterator[list[int]]:
        text = self.tail + text
        self.tail, at = "", 0
        if self.kind:  # a piece is open in the word encoder: its run goes on first
            m = (_LETTERS if self.kind == "L" else _SIGNS).match(text)
            if m:
                yield self.word.feed(m[0].encode())
                at = m.end()
            if at < len(text) or last:
                yield self.word.end()
                self.kind = ""
        if self.kind:
            return
        found = list(_PIECE.finditer(text, at))
        for k, m in enumerate(found):
            # Near the end a quote may still become a contraction, and a run may go on.
            if last or m.end() < len(text) - 3:
                yield self.word.feed(m[0].encode()) + self.word.end()
            elif k + 1 == len(found) and m.end() - m.start() > CUT:
                kind = "L" if _LETTERS.match(m[0]) else "S"
                yield self.word.feed(m[0].encode())
                self.kind = kind
                return
            else:
                self.tail = text[m.start() :]
                return


_LETTERS = regex.compile(r"\p{L}+")
_SIGNS = regex.compile(rf"[^{WS}\p{{L}}\p{{N}}]+")


class Spelling:
    """By id, the bytes of a token, with the blank that stands between it and the next."""

    def __init__(self, pieces: dict[int, bytes], gaps: set[int]):
        top = max(pieces, default=-1) + 1
        self.data = [pieces.get(i, b"") + (b" " if i in gaps else b"") for i in range(top)]
        self.gap = [i in gaps for i in range(top)]


class TextDecoder:
    """Ids to text, piece by piece. Bytes of a character that isn't complete wait, and so does a blank after the last token; what doesn't become a character is replaced."""

    def __init__(self, spelling: Spelling, gap: bool = False):
        self.spelling, self.gap = spelling, gap
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = b"".join(map(self.spelling.data.__getitem__, ids))
        if self.gap:
            data = b" " + data
        self.gap = self.spelling.gap[ids[-1]]
        return self.utf8.decode(data[:-1] if self.gap else data)

    def end(self) -> str:
        return self.utf8.decode(b"", True)


def spelled_text(merges: MergeList, special: dict[str, int]) -> Spelling:
    """Tokens as the bytes of the text that they stand for; a blank follows what ends a word."""
    own = {i: t.encode() for t, i in special.items()}
    plain = {i: bytes(map(merges.byte_of.__getitem__, t.removesuffix(END))) for i, t in merges.tokens.items() if i not in own}
    return Spelling(plain | own, {i for i, t in merges.tokens.items() if i not in own and t.endswith(END)})


def spelled_tokens(merges: MergeList, special: dict[str, int]) -> Spelling:
    """Tokens as they are named, with blanks between them: what a file that names no decoder decodes to."""
    names = {i: t.encode() for i, t in merges.tokens.items()} | {i: t.encode() for t, i in special.items()}
    return Spelling(names, set(names))


@lru_cache(maxsize=4)
def load(path: str) -> tuple[MergeList, dict[str, int]]:
    """The merge list and special tokens of a tokenizer file; once per Python process."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    return MergeList(spec["model"]["vocab"], [(a, b) for a, b in merges]), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: id, ids (array<int>), text (decoded from the ids). Null text counts as empty and gives no ids; ids may be null or repeat."""
    path = vocabulary or vocabulary_path()

    def run(batches):
        import pyarrow as pa

        give_back()
        merges, special = load(path)
        encoder = TextEncoder(merges, special)
        spelled = spelled_text(merges, special)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = [i for block in encoder.encode(text.as_py() or "") for run in block for i in run]
                decoder = TextDecoder(spelled)
                decoded = decoder.feed(ids) + decoder.end()
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], batch.schema.field(0).type), pa.array([ids], pa.list_(pa.int32())), pa.array([decoded])], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), "ids", F.col("decoded").alias("text"))


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256, n_text_chars.

    ids_sha256 is of the decimal ids joined by one blank. The file names no decoder, so its library decodes to the token
    strings joined by one blank: decoded_sha256 is of that. n_text_chars counts the code points of the text that the tokens stand
    for. The byte-to-text machine makes both. All are computed on the fly, in constant memory for each text. Null text counts as
    empty; ids aren't looked at; an empty table gives no rows; other columns are ignored.
    """
    path = vocabulary or vocabulary_path()

    def run(batches):
        import pyarrow as pa

        give_back()
        merges, special = load(path)
        digester = Digester(merges, special)
        encoder = TextEncoder(merges, special, digester.view, digester.part)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [digester.digest(encoder.encode(t or "")) for t in part.column(1).to_pylist()]
                n, a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(c, pa.int64())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_text_chars"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_text_chars long")
    return out.withColumnRenamed("id", id_col)


class Digester:
    """Digests of a stream of ids and of what it decodes to.

    A view holds of a run: its ids as text, what they decode to by name, how many they are, the code points that they
    decode to by meaning and whether a blank follows. Each text begins with a blank, as if a word stood before it.
    """

    def __init__(self, merges: MergeList, special: dict[str, int]):
        named, meant = spelled_tokens(merges, special), spelled_text(merges, special)
        self.number = [f" {i}".encode() for i in range(len(named.data))]
        self.named, self.meant, self.open = TextDecoder(named), TextDecoder(meant), TextDecoder(meant)

    def _view(self, ids: list[int], machine: TextDecoder, last: bool) -> tuple[bytes, bytes, int, int, bool]:
        chars = len(machine.feed(ids))
        gap = False
        if last:
            chars += len(machine.end())
            gap, machine.gap = machine.gap, False
        self.named.gap = True
        return b"".join(map(self.number.__getitem__, ids)), self.named.feed(ids).encode(), len(ids), chars, gap

    def view(self, ids: list[int]) -> tuple[bytes, bytes, int, int, bool]:
        return self._view(ids, self.meant, True)

    def part(self, ids: list[int], last: bool) -> tuple[bytes, bytes, int, int, bool]:
        return self._view(ids, self.open, last)

    def digest(self, blocks: Iterator[list]) -> tuple[int, str, str, int]:
        ids, text = hashlib.sha256(), hashlib.sha256()
        n = chars = 0
        gap = False
        for block in blocks:
            if block:
                numbers, pieces, counts, lengths, gaps = zip(*block, strict=True)
                a, b = b"".join(numbers), b"".join(pieces)
                ids.update(a if n else a[1:])
                text.update(b if n else b[1:])
                n += sum(counts)
                chars += sum(lengths) + sum(gaps)
                gap = gaps[-1]
        return n, ids.hexdigest(), text.hexdigest(), chars - gap


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
