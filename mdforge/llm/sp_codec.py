"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score (leftmost first among
equals) and merges its best pair until none is left. No piece joins a letter to a
following word mark, so a text falls into words (marks, then letters) that are encoded
one by one; a bounded cache per worker keeps the words met: two generations, so that a
full cache loses the words not met lately and keeps the frequent ones. A fixed share of the texts of
every Arrow batch is checked against the sentencepiece library: a batch that differs
anywhere is encoded by the library as a whole.
"""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdforge.llm.common import held, map_batches

MARK = "▁"
#: Words a worker keeps in each of two generations; words longer than the second number are not kept.
CACHE_WORDS, CACHE_LENGTH = 150_000, 64
# Bits of a symbol's number in that of a pair, and a place behind all others.
_SYMBOL, _NEVER = 20, 1 << 40
#: Characters up to which a word's agenda is a list.
SHORT_WORD = 48
#: One text in so many is compared with the library in each batch.
CHECK_EVERY = 97


class PieceCodec:
    """Encodes and decodes with the pieces of one merge-type model file."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        special = lambda i: lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)
        self.byte_id = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.pieces = {lib.id_to_piece(i): (-lib.get_score(i), i) for i in range(n) if not special(i) and not lib.is_byte(i)}
        self.surface = [None if special(i) else lib.id_to_piece(i) for i in range(n)]
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.unknown = lib.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece spans two words: words can't be encoded one by one")
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        # Symbols are numbers: a piece's id, or a number beyond for a character of a piece
        # that is none itself; 0 stands for the unknown, which merges with nothing.
        self.symbol = {p: i for p, (_, i) in self.pieces.items()}
        for c in sorted({c for p in self.pieces for c in p} - set(self.symbol)):
            self.symbol[c] = n + len(self.symbol)
        places = {x: k for k, x in enumerate(sorted({score for score, _ in self.pieces.values()}))}
        # A pair of symbols: the place of its score among all scores, and the merged symbol.
        splits = [(self.symbol[p[:k]] << _SYMBOL | self.symbol[p[k:]], places[score], i) for p, (score, i) in self.pieces.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        self.place = {pair: place for pair, place, _ in splits}
        self.merged = {pair: i for pair, _, i in splits}
        self.ids = {i for _, i in self.pieces.values()}
        self.width = {i: len(p) for p, (_, i) in self.pieces.items()}

    def merge(self, word: str) -> list[int]:
        """Ids of one word: symbols merged by the score-ordered agenda of adjacent pairs."""
        symbol = self.symbol
        symbols = [symbol[c] if c in symbol else 0 for c in word]
        if len(word) > SHORT_WORD:
            symbols = self._merged_by_heap(symbols)
        else:
            # A short word's agenda is a list beside its symbols: the least place is the best
            # pair, and the first of these the leftmost.
            place, pair_of = self.place.get, zip(symbols, symbols[1:])
            agenda = [place(a << _SYMBOL | b, _NEVER) for a, b in pair_of]
            while agenda and (best := min(agenda)) != _NEVER:
                i = agenda.index(best)
                symbols[i] = new = self.merged[symbols[i] << _SYMBOL | symbols[i + 1]]
                del symbols[i + 1], agenda[i]
                if i:
                    agenda[i - 1] = place(symbols[i - 1] << _SYMBOL | new, _NEVER)
                if i < len(agenda):
                    agenda[i] = place(new << _SYMBOL | symbols[i + 1], _NEVER)
        if self.ids.issuperset(symbols):
            return symbols
        out, at = [], 0
        for s in symbols:
            if s in self.ids:
                out.append(s)
                at += self.width[s]
            else:  # a character that is no piece
                out.extend([self.byte_id[b] for b in word[at].encode()] if self.byte_id else [self.unknown])
                at += 1
        return out

    def _merged_by_heap(self, symbols: list[int]) -> list[int]:
        """The same for a long word: the agenda is a heap of (place, where); an entry whose
        pair has changed since is stale."""
        n, place = len(symbols), self.place.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(p, i) for i in range(n - 1) if (p := place(symbols[i] << _SYMBOL | symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            p, i = heappop(agenda)
            j = after[i]
            if j >= n or symbols[i] < 0 or place(pair := symbols[i] << _SYMBOL | symbols[j]) != p:
                continue
            symbols[i], symbols[j] = self.merged[pair], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := place(symbols[i] << _SYMBOL | symbols[k])) is not None:
                    heappush(agenda, (p, i))
            if (h := before[i]) >= 0 and (p := place(symbols[h] << _SYMBOL | symbols[i])) is not None:
                heappush(agenda, (p, h))
        return [s for s in symbols if s >= 0]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: runs of byte pieces as UTF-8, marks as spaces."""
        if self.ids.issuperset(ids):
            return "".join([self.surface[i] for i in ids]).replace(MARK, " ")
        out, run = [], bytearray()
        for i in ids:
            if i in self.id_byte:
                run.append(self.id_byte[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append((self.surface[i] or "").replace(MARK, " "))
        return "".join(out) + run.decode(errors="replace")

    def word(self, word: str) -> tuple[str, int, str]:
        """Ids of a word joined by commas, their number, and the word decoded again."""
        found = self.young.get(word) or self.old.get(word)
        if found is None:
            ids = self.merge(word)
            found = ",".join(map(str, ids)), len(ids), self.decode(ids)
        if len(word) <= CACHE_LENGTH:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def text(self, text: str | None) -> tuple[str, int, str]:
        """Ids joined by commas, their number, and the decoded text of a whole text."""
        if not text:
            return "", 0, ""
        words = self.words.findall(MARK + text.replace(" ", MARK))
        parts = list(map(self.young.get, words))
        if None in parts:
            parts = [self.word(w) if p is None else p for w, p in zip(words, parts, strict=True)]
        return ",".join([p[0] for p in parts]), sum([p[1] for p in parts]), "".join([p[2] for p in parts])[1:]

    def by_library(self, text: str | None) -> tuple[str, int, str]:
        ids = self.library.encode(text or "")
        return ",".join(map(str, ids)), len(ids), self.library.decode(ids)

    def batch(self, texts: list[str | None]) -> list[tuple[str, int, str]]:
        """Whole texts of an Arrow batch, a share of them checked against the library."""
        out = [self.text(t) for t in texts]
        if any(self.by_library(texts[i]) != out[i] for i in range(len(texts) // 2 % CHECK_EVERY, len(texts), CHECK_EVERY)):
            return [self.by_library(t) for t in texts]
        return out


def codec(model: str) -> PieceCodec:
    """The worker's codec of a model file: made once, its cache serves all later tasks."""
    return held(f"codec {model}", lambda: PieceCodec(model))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_ids(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of every whole text and the text decoded from them.

    Null and empty texts have no ids and decode to an empty text; ids and repeated rows
    stay as they are, other columns are left out.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = codec(model).batch(b.column("text").to_pylist())
        ids = [[int(x) for x in g[0].split(",")] if g[0] else [] for g in got]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())], ["doc_id", "ids", "decoded"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>, decoded string", keeps=True)


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    The digests are taken in the same Arrow batch, so ids and decoded texts never leave
    the worker. Null texts count as empty.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = codec(model).batch(b.column("text").to_pylist())
        cols = [b.column("doc_id"), pa.array([g[1] for g in got], pa.int64()), pa.array([_sha(g[0]) for g in got]), pa.array([_sha(g[2]) for g in got])]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True)
