"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum, over all its segmentations into pieces, of the product of the
piece probabilities; a forward pass over the word's places gives that sum. A text's score
is the sum of its words' logarithms. The probabilities are fitted by expectation
maximisation on word counts of labelled texts (forward-backward expected piece counts).
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdforge.llm.common import held, map_batches, ready, settle

#: Labelled texts that fit the model, per language: chosen by a hash of the id.
FIT_TEXTS = 4_000
#: Rounds of expectation maximisation, and what every piece counts besides.
ROUNDS, PRIOR = 3, 0.05
#: Words longer than this are cut into stretches: no piece is longer than 16 characters.
STRETCH = 32
#: Words a worker keeps in each of two generations, and words of an EM round taken together.
CACHE_WORDS, ROUND_WORDS = 200_000, 50_000
UNKNOWN_LANGUAGE = "und"

_WORDS = re.compile(r"[^\W\d_]+")
# Substrings are hashed to 64 bits; the top 20 pick a place in the table of candidates.
_BASE, _MULTIPLIER, _SHIFT = "substring", 0x9E3779B97F4A7C15, np.uint64(44)


def vocabulary(model: str) -> dict[str, int]:
    """Lower-cased letter pieces of a public vocabulary file, numbered.

    A leading word mark is kept; all single letters that aren't pieces share number 0.
    """
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    found = {lib.id_to_piece(i).lower() for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
    return {p: k for k, p in enumerate(sorted(p for p in found if re.fullmatch(r"▁?[^\W\d_]*", p)), 1) if p}


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORDS.findall(text.lower())


class Lattice:
    """Forward (and backward) passes over all segmentations of many words at once."""

    def __init__(self, pieces: dict[str, int]) -> None:
        self.pieces, self.longest = pieces, max((len(p) for p in pieces), default=1)
        keys = np.array([self.key(p) for p in pieces], np.uint64)
        by = np.argsort(keys)
        self.keys, self.numbers = keys[by], np.fromiter(pieces.values(), np.int64, len(pieces))[by]
        self.maybe = np.zeros(1 << 20, bool)  # whether any piece has these top bits
        self.maybe[(self.keys >> _SHIFT).astype(np.int64)] = True

    @staticmethod
    def key(piece: str) -> int:
        h = len(_BASE)
        for c in piece:
            h = (h * _MULTIPLIER + ord(c)) * _MULTIPLIER & (1 << 64) - 1
        return h

    def grouped(self, words: list[str]):
        """For words of one length: (start, end, word numbers, pieces) by end.

        All substrings are hashed place by place and looked up among the pieces' hashes;
        0 stands for a letter that is no piece.
        """
        n = len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)
        m, out = np.uint64(_MULTIPLIER), []
        everyone = np.arange(len(words))
        for i in range(n):
            h = np.full(len(words), np.uint64(len(_BASE)))
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = (h * m + letters[:, j - 1]) * m
                who = np.nonzero(self.maybe[(h >> _SHIFT).astype(np.int64)])[0]
                at = np.minimum(np.searchsorted(self.keys, h[who]), max(0, len(self.keys) - 1))
                found = self.keys[at] == h[who] if len(self.keys) else np.zeros(0, bool)
                who, what = who[found], self.numbers[at[found]]
                if j == i + 1:
                    piece = np.zeros(len(words), np.int64)
                    piece[who] = what
                    who, what = everyone, piece
                if len(who):
                    out.append((i, j, who, what))
        return sorted(out, key=lambda x: x[1])

    def forward(self, words: list[str], probs: np.ndarray, arcs=None) -> np.ndarray:
        """alpha[word, place, language]; probs: pieces x languages."""
        n = len(words[0])
        alpha = np.zeros((len(words), n + 1, probs.shape[1]))
        alpha[:, 0] = 1
        for i, j, who, what in arcs or self.grouped(words):
            alpha[who, j] += alpha[who, i] * probs[what]
        return alpha

    def log_probability(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log of the summed probability of each word (marked here), words x languages."""
        out, by = np.zeros((len(words), probs.shape[1])), defaultdict(list)
        for w, word in enumerate(words):
            for s in stretches(word):
                by[len(s)].append((w, s))
        for group in by.values():
            for at in range(0, len(group), 4096):
                some = group[at : at + 4096]
                a = self.forward([s for _, s in some], probs)[:, -1]
                np.add.at(out, [w for w, _ in some], np.log(np.maximum(a, 1e-300)))
        return out

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces) of one language over words with their counts."""
        out, by = np.zeros(len(probs)), defaultdict(list)
        for word, c in zip(words, counts, strict=True):
            for s in stretches(word):
                by[len(s)].append((s, c))
        p = probs[:, None]
        for n, group in by.items():
            for at in range(0, len(group), 4096):
                some = [s for s, _ in group[at : at + 4096]]
                c = np.asarray([c for _, c in group[at : at + 4096]], dtype=float)
                arcs = self.grouped(some)
                alpha = self.forward(some, p, arcs)[:, :, 0]
                beta = np.zeros_like(alpha)
                beta[:, n] = 1
                for i, j, who, what in sorted(arcs, key=lambda x: -x[0]):
                    beta[who, i] += beta[who, j] * probs[what]
                scale = c / np.maximum(alpha[:, n], 1e-300)
                for i, j, who, what in arcs:
                    np.add.at(out, what, alpha[who, i] * probs[what] * beta[who, j] * scale[who])
        return out


def stretches(word: str) -> list[str]:
    """A marked word, cut where it is longer than any word of a language is."""
    word = "▁" + word
    return [word[i : i + STRETCH] for i in range(0, len(word), STRETCH)]


class Model:
    """Languages with their piece probabilities (pieces x languages) and priors.

    With ``background`` a text is also scored by a model that knows no language: all pieces
    are equally likely. ``predict`` then tells whether the best language does better.
    """

    def __init__(self, languages: list[str], pieces: dict[str, int], probs: np.ndarray, prior: np.ndarray, background: bool = False) -> None:
        self.languages, self.lattice, self.prior = languages, Lattice(pieces), prior
        self.probs = np.column_stack([probs, np.full(len(probs), 1.0 / len(probs))]) if background else probs
        self.numbers, self.logs = {}, np.empty((1 << 12, self.probs.shape[1]), dtype=np.float32)
        self.old_numbers, self.old_logs = {}, self.logs[:0]

    def learn(self, words: set[str]) -> None:
        """Scores words not met yet. A full cache becomes the old generation, from which words
        met again are taken over; what is not met until the next time goes."""
        new = sorted(w for w in words if w not in self.numbers)
        if not new:
            return
        if len(self.numbers) + len(new) > CACHE_WORDS and self.numbers:
            self.old_numbers, self.old_logs = self.numbers, self.logs
            self.numbers, self.logs = {}, np.empty((1 << 12, self.logs.shape[1]), dtype=np.float32)
            new = sorted(words)
        start = len(self.numbers)
        if start + len(new) > len(self.logs):
            more = max(len(new) + start, min(2 * len(self.logs), CACHE_WORDS))
            self.logs = np.concatenate([self.logs[:start], np.empty((more - start, self.logs.shape[1]), np.float32)])
        at = np.array([self.old_numbers.get(w, -1) for w in new])
        fresh = np.nonzero(at < 0)[0]
        self.logs[start + np.nonzero(at >= 0)[0]] = self.old_logs[at[at >= 0]]
        self.logs[start + fresh] = self.lattice.log_probability([new[k] for k in fresh], self.probs)
        self.numbers.update(zip(new, range(start, start + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its posterior probability, and whether it beats the background, for each text."""
        split = [words_of(t) if t else [] for t in texts]
        # Fractions, Roman numerals and the like are word characters, but no letters.
        empty = np.array([not any(w.isalpha() or any(map(str.isalpha, w)) for w in s) for s in split], bool)
        total = np.zeros((len(texts), self.probs.shape[1]))
        step = 200_000  # words scored together: a batch of long texts stays small
        at = 0
        while at < len(split):
            n, to = 0, at
            while to < len(split) and (to == at or n + len(split[to]) <= step):
                n, to = n + len(split[to]), to + 1
            for k in range(at, to):
                if len(split[k]) > step:  # one huge text: by stretches
                    for x in range(0, len(split[k]), step):
                        part = split[k][x : x + step]
                        self.learn(set(part))
                        total[k] += self.logs[[self.numbers[w] for w in part]].sum(0, dtype=float)
                    split[k] = None
            self.learn(set().union(*(s for s in split[at:to] if s)))
            get = self.numbers.__getitem__
            for k in range(at, to):
                if split[k]:
                    total[k] += self.logs[list(map(get, split[k]))].sum(0, dtype=float)
            at = to
        total, background = total[:, : len(self.languages)], total[:, len(self.languages) :]
        known = ~empty & (total.max(1, keepdims=True) >= background).all(1)
        total = total + np.log(self.prior)
        best = total.argmax(1) if len(self.languages) else np.zeros(len(texts), int)
        score = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
        score[empty] = 0.0
        return [UNKNOWN_LANGUAGE if e else self.languages[b] for e, b in zip(empty, best, strict=True)], score, known


def fit(labelled: DataFrame, model: str, fit_texts: int = FIT_TEXTS, rounds: int = ROUNDS) -> Model:
    """Fits piece probabilities to a table (doc_id, text, lang).

    About ``fit_texts`` texts of each language fit the model (a documented bound: the
    probabilities of some 30,000 pieces settle long before); they are chosen by a hash of
    the id. Word counts are made and combined by Spark; every round maps the word table
    to expected piece counts, whose sums (pieces x languages) reach the driver.
    """
    spark = labelled.sparkSession
    ready(spark)  # before the first worker: those of another environment would stay beside
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, pieces = sorted(sizes), vocabulary(model)
    place = {x: k for k, x in enumerate(languages)}
    share = F.lit(0.0)
    for x in languages:
        share = F.when(F.col("lang") == x, F.lit(min(1.0, fit_texts / sizes[x]))).otherwise(share)
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30))

    def count(batches):
        seen: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen[lang].update(words_of(text))
            if sum(map(len, seen.values())) > 500_000:
                yield from _counted(seen)
                seen.clear()
        yield from _counted(seen)

    def _counted(seen):
        for lang, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    words = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    words = settle(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    probs = np.full((len(pieces) + 1, max(1, len(languages))), 1.0 / (len(pieces) + 1))
    key = f"lattice-{uuid.uuid4().hex}"
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((pieces, probs))

        def expect(batches):
            pieces, probs = shared.value  # noqa: B023
            lattice = held(key, lambda: Lattice(pieces))
            by, size = defaultdict(list), 0

            def out() -> pa.RecordBatch:
                rows = ([], [], [])
                for lang, some in by.items():
                    e = lattice.expected([w for w, _ in some], [n for _, n in some], probs[:, place[lang]])
                    at = np.nonzero(e)[0]
                    for x, y in zip(rows, (np.full(len(at), place[lang]), at, e[at]), strict=True):
                        x.append(y)
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(rows, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["lang", "piece", "n"])

            for b in batches:
                for lang, word, n in zip(b.column("lang").to_pylist(), b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                    by[lang].append((word, n))
                size += b.num_rows
                if size >= ROUND_WORDS:
                    yield out()
                    by, size = defaultdict(list), 0
            if by:
                yield out()

        got = words.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        probs = np.full(probs.shape, PRIOR)
        probs[got.column("piece").to_numpy(), got.column("lang").to_numpy()] += got.column("n").to_numpy()
        probs /= probs.sum(0)
    prior = np.array([sizes[x] for x in languages], float)
    return Model(languages, pieces, probs, prior / max(1.0, prior.sum()))


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def predictor(docs: DataFrame, model: str, background: bool = False):
    """A function of texts: (languages, scores, known), the model fitted to ``docs``.

    Without any labelled text it gives no language, and no text is unknown to it.
    """
    spark = docs.sparkSession
    learnt = fit(docs.where(~held_out(F.col("doc_id"))), model)
    parts = learnt.languages, learnt.lattice.pieces, learnt.probs, learnt.prior, background
    shared = spark.sparkContext.broadcast(parts)
    key = f"language-{uuid.uuid4().hex}"

    def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not shared.value[0]:
            return [UNKNOWN_LANGUAGE] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        return held(key, lambda: Model(*shared.value)).predict(texts)

    return predict


def identify(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every whole text of ``docs``.

    Learns from the text and non-null lang of documents that aren't held out. A text that
    is null, empty or without a letter is ``und`` with score 0; without any labelled text
    all are. Repeated rows are predicted one by one; other columns are left out.
    """
    predict = predictor(docs.select("doc_id", "text", "lang"), model)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores, _ = predict(b.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(source, run, "doc_id long, held_out boolean, lang_pred string, score double", keeps=True)


def accepted(docs: DataFrame, model: str) -> DataFrame:
    """The rows of ``docs`` whose text is in a known language.

    A text is, if its best language makes it more likely than a background model in which
    all pieces are equally likely: both are sums over the same words, so the length of a
    text is no matter. Texts without a letter are in none. If no text has a language to
    learn from, nothing can be rejected and all rows stay.
    """
    predict = predictor(docs.select("doc_id", "text", "lang"), model, background=True)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(predict(b.column("text").to_pylist())[2]))

    return map_batches(docs, run, docs.schema, keeps=True)
