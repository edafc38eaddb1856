"""Token counts by a map-side two-tier lookup.

Tier one is a compact broadcast table of frequent pre-tokens and their token numbers;
tier two encodes what it misses with the tokenizers library and keeps the numbers in a
bounded cache per worker. Pre-tokens are never shuffled: a text is counted in its batch.
The table only saves work: any table, an empty one included, gives the same counts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdforge.llm.common import held, map_batches

#: Pre-tokens of the broadcast table, and texts of the sample that chooses them.
TABLE_WORDS, SAMPLE_TEXTS = 65_536, 4_000
#: Pre-tokens a worker keeps besides in each of two generations; longer ones than the second number are not kept.
CACHE_WORDS, CACHE_LENGTH = 150_000, 64

# Texts of these characters only are split by one plain pattern; their composed form is
# themselves. All others are normalised and split by the library itself.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")
_LETTER = "a-zß-öø-ÿ"
# The word pattern of the vocabulary, for lower-case plain characters.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s{_LETTER}0-9]+")


class _Numbers(dict):
    """pre-token -> number of tokens. What is missing is encoded and kept; when there is no more
    room, what was not met since the last time goes."""

    def __init__(self, tokenizer, table: dict[str, int]) -> None:
        super().__init__(table)
        self.tokenizer, self.table, self.old = tokenizer, table, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= len(self.table) + CACHE_WORDS:
                self.old = dict(self)
                self.clear()
                self.update(self.table)
            self[word] = n
        return n


class WordCounter:
    """Counts the tokens of texts for one vocabulary file."""

    def __init__(self, vocabulary: str, table: dict[str, int]) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.numbers = _Numbers(self.tokenizer, table)

    def pre_tokens(self, text: str) -> list[str] | None:
        """Pre-tokens of a plain text; None where the library has to take it as a whole."""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return None
        return _SPLIT.findall(text.lower())

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = self.pre_tokens(text)
        if words is None:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.numbers.__getitem__, words))


def unpacked(vocabulary: str, table: tuple[bytes, np.ndarray, np.ndarray]) -> WordCounter:
    """A counter that knows the numbers of a broadcast table."""
    blob, ends, lengths = table
    words = blob.decode().split("\n") if len(ends) else []
    return WordCounter(vocabulary, dict(zip(words, lengths.tolist(), strict=True)))


def frequent_table(docs: DataFrame, vocabulary: str, words: int = TABLE_WORDS, texts: int = SAMPLE_TEXTS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The compact table: pre-tokens as one blob, their ends, and their token numbers.

    The pre-tokens are the most frequent ones of about ``texts`` texts chosen by a hash
    of their ids in a parallel scan, counted in one task; at most ``words`` rows reach the driver.
    """
    docs = docs.select("doc_id", "text")
    share = int(min(1.0, texts / max(1, docs.count())) * (1 << 30))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share).select("text").repartition(1)

    def run(batches):
        own, seen = WordCounter(vocabulary, {}), Counter()
        for b in batches:
            seen.update(chain.from_iterable(own.pre_tokens(t) or () for t in b.column("text").to_pylist() if t))
            if len(seen) > 8 * words:
                seen = Counter(dict(seen.most_common(4 * words)))
        top = sorted(w for w, _ in seen.most_common(words) if len(w) <= CACHE_LENGTH)
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array([own.numbers[w] for w in top], pa.int32())], ["word", "n"])

    got = sample.mapInArrow(run, "word string, n int").toArrow()
    found = got.column("word").to_pylist()
    ends = np.cumsum([len(w.encode()) + 1 for w in found], dtype=np.int32) if found else np.empty(0, np.int32)
    return "\n".join(found).encode(), ends, np.asarray(got.column("n").to_pylist(), dtype=np.uint8 if all(n < 256 for n in got.column("n").to_pylist()) else np.int32)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, table_words: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; null counts as empty.

    Special strings inside a text are taken as the library takes them by default. Ids may
    be null or repeat; other columns are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(frequent_table(docs, vocabulary, table_words))
    key = f"tokens-{uuid.uuid4().hex}"

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        own = held(key, lambda: unpacked(vocabulary, shared.value))
        texts = b.column("text").to_pylist()
        n = [own.count(t) for t in texts]
        cols = [b.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", keeps=True)
