"""Language-model scoring with a log-frequency Bloom filter.

The filter holds the quantised counts of words and word pairs: an n-gram of level ``q`` is
entered once for each level 1..q, and its count is read by probing level after level until
one is missing. The filter is broadcast; a text's pairs get Dirichlet-smoothed
probabilities, ``(c(h, w) + mu p(w)) / (c(h) + mu)``, from those probes alone.

Counting: tasks fold the n-grams of their texts into sorted arrays of hashes and counts,
cut by hash into ranges; a range's arrays meet in one task and are added up. The filter
has one segment for each range, filled from the range's words and from its pairs.
The filter grows with the counted n-grams and holds all of them. It is broadcast while it has
at most ``max_bits``. A larger one stays in slices of consecutive ranges: the distinct words
and pairs of a bundle of texts go to the slices of their hashes once, are probed there, those
of many bundles together, and their levels come back. A bundle sends one row to a slice, so
bundles are large: rows grow with bundles times slices. The scores are those that the whole
filter would give.

Word counts besides are exact: the most frequent words are broadcast, the rest of a
text's words are joined to the table of counts. Only that rest is probed, and all pairs.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdforge.llm.common import map_batches, release, settle, trim, unsettle
from mdforge.llm.langid import held_out
from mdforge.llm.shingles import column_words, mix

#: Bits that are broadcast at most, growth of the levels, and mu.
MAX_BITS, BASE, MU = 1 << 30, 1.45, 100.0
#: Hash functions of the first level, where a false hit makes an n-gram out of nothing (one
#: in 128), of levels 2 and 3, where it makes a count of 1 or 2 larger by 1, and of the others,
#: where it makes a count a level too large.
HASHES, HASHES_LOW, HASHES_ABOVE = 7, 5, 4
#: Bits of a slice of a larger filter, and words and pairs probed by one task.
SLICE_BITS, PROBED = 1 << 26, 1 << 25
#: Words whose exact counts are broadcast.
FREQUENT = 1 << 19
#: n-grams folded at a time in a task, and training tokens for each hash range.
FOLD, TOKENS_A_RANGE = 4_000_000, 1 << 19
#: Tokens scored together (their pairs are sorted, and the more there are, the more probes meet
#: in a segment), and in a row of packed texts; keys probed together.
SCORED, PACKED, TOGETHER = 1 << 20, 1 << 19, 1 << 16
_START, _END = np.uint64(0x51ED270B7A2F1D35), np.uint64(0x2545F4914F6CDD1D)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _steps(base: float, most: int = 1 << 62) -> np.ndarray:
    """Smallest count of every level: each whole number at first, then ``base`` times the last."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * base)))
    return np.array(out, np.uint64)


_LEAST = _steps(BASE)


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: the last level whose smallest count is reached; 0 for none."""
    return np.searchsorted(_LEAST, counts.astype(np.uint64), "right")


def count_of(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of the counts it holds; 0 for level 0."""
    middle = (_LEAST[:-1].astype(float) + _LEAST[1:].astype(float) - 1) / 2
    return np.concatenate([[0.0], middle])[np.minimum(levels, len(middle))]


def hashes_of(levels: np.ndarray) -> int:
    """Bits that n-grams of these levels, 1 or more, set in the filter."""
    low = np.minimum(levels, 3) - 1
    return HASHES * len(levels) + HASHES_LOW * int(low.sum()) + HASHES_ABOVE * int((levels - 1 - low).sum())


def pairs_of(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the pairs (token before, token) of texts that begin at ``starts``."""
    before = np.roll(tokens, 1)
    before[starts] = _START
    return mix(before * _GOLD + tokens)


def _bundles(column: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts, until they have more than ``most`` tokens: the first's place, the
    word hashes of each text and its end, and the texts' numbers of tokens."""
    words, counts = column_words(column)
    tokens, lengths = np.insert(words, np.cumsum(counts), _END), counts + 1
    ends, first, at = np.cumsum(lengths), 0, 0
    while first < len(lengths):
        last = min(int(np.searchsorted(ends, at + most, "right")), len(lengths) - 1)
        yield first, tokens[at : ends[last]], lengths[first : last + 1]
        first, at = last + 1, int(ends[last])


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all: the high bytes compress to nothing."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(-1), dtype=np.uint64)


class Filter:
    """Bits in segments, one for each range of the n-grams' hashes, from range ``start`` on."""

    def __init__(self, bits: np.ndarray, ranges: int, segment: int, start: int = 0) -> None:
        self.bits, self.ranges, self.segment, self.start = bits, ranges, segment, start

    @staticmethod
    def _places(keys: np.ndarray, q: int, segment: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Probes of the level ``q``, the first's place in a segment, and the way to the next."""
        n = HASHES if q == 1 else HASHES_LOW if q <= 3 else HASHES_ABOVE
        h = mix(keys + np.uint64(q * int(_GOLD) & (1 << 64) - 1))
        kind = np.uint32 if segment < 1 << 31 else np.uint64  # twice a segment fits
        own, p, step = kind(segment), (h & np.uint64(0xFFFFFFFF)).astype(kind), (h >> np.uint64(32)).astype(kind) | kind(1)
        return n, p - p // own * own, step - step // own * own

    @staticmethod
    def _next(p: np.ndarray, step: np.ndarray, segment: int) -> np.ndarray:
        p = p + step
        return np.minimum(p, p - p.dtype.type(segment))  # what falls below 0 is large

    @classmethod
    def probes(cls, keys: np.ndarray, q: int, segment: int) -> Iterator[np.ndarray]:
        """Places in a segment of the keys' level ``q``."""
        n, p, step = cls._places(keys, q, segment)
        for i in range(n):
            p = cls._next(p, step, segment) if i else p
            yield p

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of every key: the last one before a probe misses."""
        return np.concatenate([np.zeros(0, np.int64), *(self._levels(keys[i : i + TOGETHER]) for i in range(0, len(keys), TOGETHER))])

    def _hit(self, at: np.ndarray) -> np.ndarray:
        return ((self.bits.take(at >> 3) >> (at & 7).astype(np.uint8)) & np.uint8(1)).view(bool)

    def _levels(self, keys: np.ndarray) -> np.ndarray:
        out, left, q = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        first = (_range(keys, self.ranges) - self.start) * self.segment
        while len(left):
            q += 1
            n, p, step = self._places(keys, q, self.segment)
            ok = self._hit(first + p.astype(np.int64))
            for i in range(1, n):
                p = self._next(p, step, self.segment)
                ok &= self._hit(first + p.astype(np.int64))
                # Most keys that lack the level have missed by the second probe.
                if i == n - 1 or i == 1 and np.count_nonzero(ok) < 0.9 * len(ok):
                    on = np.flatnonzero(ok)
                    keys, first, left = keys[on], first[on], left[on]
                    if i < n - 1:
                        p, step, ok = p[on], step[on], ok[on]
            out[left] = q
            if q > 200:
                break
        return out


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(at, append=len(keys))


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several sorted arrays, sorted, with the sums of their counts."""
    if len(keys) == 1:
        return keys[0], counts[0].astype(np.int64)
    k = _counted(np.concatenate(keys))[0]
    # Each array is in order, so a search begins near the last one's end.
    n = np.bincount(np.concatenate([np.searchsorted(k, x) for x in keys]), np.concatenate(counts), len(k))
    return k, n.astype(np.int64)


def _folded(docs: DataFrame, ranges: int, pairs: bool) -> DataFrame:
    """(part, keys, counts): a task's n-grams by range, sorted, with their counts."""

    def rows(keys, counts):
        counts = counts.astype(np.uint32)
        cut = np.searchsorted(_range(keys, ranges), np.arange(ranges + 1))
        own = [(r, squeezed(keys[i:j]), counts[i:j].tobytes()) for r, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
        for at in range(0, len(own), 64):
            some = own[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.binary()), pa.array([x[2] for x in some], pa.binary())], ["part", "keys", "counts"])

    def run(batches):
        held, folded, size = [], [], 0
        for b in batches:
            for _, tokens, lengths in _bundles(b.column("text"), FOLD):
                held.append(pairs_of(tokens, np.cumsum(lengths) - lengths) if pairs else tokens)
                size += len(tokens)
                if size >= FOLD:
                    keys, n = _added(*zip(*folded, _counted(np.concatenate(held)), strict=True))
                    held = []
                    if len(keys) > FOLD // 2:
                        yield from rows(keys, n)
                        folded, size = [], 0
                    else:
                        folded, size = [(keys, n)], len(keys)
        if held:
            folded.append(_counted(np.concatenate(held)))
        if folded:
            yield from rows(*_added(*zip(*folded, strict=True)))
        held, folded = [], []
        release()

    return docs.select("text").mapInArrow(run, "part int, keys binary, counts binary")


def _merged(folded: DataFrame, ranges: int) -> DataFrame:
    """(part, keys, counts, n): one row for each range with the sums of all tasks, and the bits
    that its n-grams set in the filter."""

    def run(batches):
        part, keys, counts = None, [], []

        def out():
            k, n = _added(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([squeezed(k)], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([hashes_of(level(n))], pa.int64())], ["part", "keys", "counts", "n"])

        for b in batches:
            for p, k, n in zip(b.column("part").to_pylist(), b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if p != part and keys:
                    yield out()
                    keys, counts = [], []
                part = p
                keys.append(unsqueezed(k))
                counts.append(np.frombuffer(n, np.uint32))
        if keys:
            yield out()
        keys, counts = [], []
        release()

    tasks = min(8192, max(min(ranges, 64), ranges // 4))
    return folded.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, "part int, keys binary, counts binary, n long")


class Counts:
    """Merged word and pair counts of the training texts."""

    def __init__(self, train: DataFrame) -> None:
        n = train.select(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n")).first()["n"] or 0
        self.ranges = max(16, int(n) // 6 // TOKENS_A_RANGE)
        self.words = settle(_merged(_folded(train, self.ranges, False), self.ranges), "words")
        self.pairs = settle(_merged(_folded(train, self.ranges, True), self.ranges), "pairs")
        self.table = settle(self._rows(), "counts")
        total = self.table.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.types = int(total["n"] or 0), int(total["v"] or 0)

    def _rows(self) -> DataFrame:
        """(word, c): exact counts of all training words and the end."""

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            keys = [unsqueezed(x).view(np.int64) for x in b.column("keys").to_pylist()]
            n = [np.frombuffer(x, np.int64) for x in b.column("counts").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(n))], ["word", "c"])

        return map_batches(self.words, run, "word long, c long")

    def frequent(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``n`` most frequent words, sorted by hash, with their counts."""
        got = self.table.orderBy(F.desc("c"), "word").limit(n).toArrow()
        words, c = got.column("word").to_numpy().view(np.uint64), got.column("c").to_numpy()
        by = np.argsort(words)
        return words[by], c[by].astype(np.int64)

    def segments(self) -> tuple[DataFrame, int]:
        """((part, bits) of the filter of all n-grams, bits of a segment).

        A segment comes twice, with the bits of the words and with those of the pairs.
        """
        ranges = self.ranges

        both = self.words.union(self.pairs)
        need = both.agg(F.sum("n").alias("n")).first()["n"] or 0
        # 1.45 bits a hash leave half of the bits unset; segments differ a little in load.
        segment = max(1024, (int(need * 1.45) // ranges + 7) // 8 * 8)

        def fill(batches):
            for b in batches:
                for p, keys, n in zip(b.column("part").to_pylist(), b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                    bits, k, q = np.zeros(segment, bool), unsqueezed(keys), level(np.frombuffer(n, np.int64))
                    for x in range(1, int(q.max()) + 1):
                        k, q = (k, q) if x == 1 else (k[q >= x], q[q >= x])
                        for at in Filter.probes(k, x, segment):
                            bits[at.astype(np.int64)] = True
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])
            release()

        segments = settle(both.select("part", "keys", "counts").mapInArrow(fill, "part int, bits binary"), "segments")
        unsettle(self.words, self.pairs)  # the filter and the table of words have them
        return segments, segment


def whole_filter(segments: DataFrame, ranges: int, segment: int) -> Filter:
    """All segments as one filter, for a broadcast."""
    bits = np.zeros(segment * ranges // 8, np.uint8)
    for r in segments.toLocalIterator():
        at = r["part"] * segment // 8
        bits[at : at + segment // 8] |= np.frombuffer(r["bits"], np.uint8)
    return Filter(bits, ranges, segment)


class Texts:
    """Texts scored together: their distinct words, each token's word, and lengths."""

    def __init__(self, words: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> None:
        self.words, self.at, self.lengths = words, at, lengths
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    @classmethod
    def of(cls, tokens: np.ndarray, lengths: np.ndarray) -> Texts:
        return cls(*np.unique(tokens, return_inverse=True), lengths)

    def pairs(self) -> np.ndarray:
        """Every token's pair with the token before."""
        return pairs_of(self.words[self.at], self.starts)


class Scorer:
    """Scores many texts at once: every distinct word is looked up once."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray], tokens: int, types: int, mu: float) -> None:
        (self.words, self.counts), self.tokens, self.types, self.mu = frequent, tokens, types, mu

    def _found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.words, words), max(0, len(self.words) - 1))
        found = self.words[place] == words if len(self.words) else np.zeros(len(words), bool)
        return found, self.counts[place[found]]

    def rare(self, texts: Texts) -> np.ndarray:
        """The texts' distinct words whose counts aren't at hand: the filter has to tell them."""
        return texts.words[~self._found(texts.words)[0]]

    def __call__(self, texts: Texts, word_levels: np.ndarray, pair_levels: np.ndarray):
        """For each text: frequent words, sum of log10(count + 1) over them, and log10
        probability of the text; then the hashes of all texts' other words. Levels are those
        of the texts' ``rare`` words and of every token's pair."""
        one, at, starts = texts.words, texts.at, texts.starts
        found, exact = self._found(one)
        logs, c1 = np.zeros(len(one)), np.empty(len(one))
        logs[found] = np.log10(exact + 1.0)
        c1[found], c1[~found] = exact, np.minimum(count_of(word_levels), self.tokens)
        c1 = c1[at]
        c_before = np.roll(c1, 1)
        c_before[starts] = c1[texts.ends - 1]  # the start is as frequent as the end, the last token of each text
        # A pair is no more frequent than its words.
        c2 = np.minimum(count_of(pair_levels), np.minimum(c_before, c1))
        p = np.log10((c2 + self.mu * (c1 + 1) / (self.tokens + self.types + 1)) / (c_before + self.mu))
        known = found[at]
        return np.add.reduceat(known, starts, dtype=np.int64), np.add.reduceat(logs[at], starts), np.add.reduceat(p, starts), one[at[~known]].view(np.int64)


_NAMES = ["doc_id", "text_hash", "held_out"]
_KINDS = (pa.int64(), pa.int64(), pa.bool_())
_SCORED = "doc_id long, text_hash long, held_out boolean, n_tokens long, n_frequent long, log_frequent double, score double, rare array<long>"


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple[list, ...], Texts]]:
    """Consecutive texts of a task, until they have more than ``most`` tokens, and their names."""
    names, tokens, lengths, size = ([], [], []), [], [], 0
    for b in batches:
        for first, t, n in _bundles(b.column("text"), most):
            for x, own in zip(_NAMES, names, strict=True):
                own.extend(b.column(x).slice(first, len(n)).to_pylist())
            tokens.append(t)
            lengths.append(n)
            size += len(t)
            if size > most:
                yield names, Texts.of(np.concatenate(tokens), np.concatenate(lengths))
                names, tokens, lengths, size = ([], [], []), [], [], 0
    if tokens:
        yield names, Texts.of(np.concatenate(tokens), np.concatenate(lengths))


def _scored_batch(names: list[pa.Array], lengths: np.ndarray, part: tuple) -> pa.RecordBatch:
    frequent, logs, p, rare = part
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths - frequent)]), pa.int32())
    out = pa.array(lengths, pa.int64()), pa.array(frequent), pa.array(logs), pa.array(p)
    return pa.RecordBatch.from_arrays([*names, *out, pa.ListArray.from_arrays(ends, pa.array(rare))], [*_NAMES, "n_tokens", "n_frequent", "log_frequent", "score", "rare"])


def _scored_at_once(docs: DataFrame, model: Filter, scorer) -> DataFrame:
    """Scores with a filter that is broadcast whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = scorer()
        for names, t in _gathered(batches, SCORED):
            model = shared.value
            pair, at = np.unique(t.pairs(), return_inverse=True)
            part = own(t, model.levels(own.rare(t)), model.levels(pair)[at])
            yield _scored_batch([pa.array(x, kind) for x, kind in zip(names, _KINDS, strict=True)], t.lengths, part)
        trim()

    return settle(docs.mapInArrow(run, _SCORED), "scored")


def _packed(docs: DataFrame) -> DataFrame:
    """A row for each bundle of texts: a number, the texts' names and lengths, words, and tokens."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for names, t in _gathered(batches, PACKED):
            at = t.at.astype(_wide(len(t.words))).view(np.uint8).reshape(len(t.at), -1).T.tobytes()
            lists = [pa.array([x], pa.list_(kind)) for x, kind in zip((*names, t.lengths), (*_KINDS, pa.int64()), strict=True)]
            own = [pa.array([number], pa.int64()), *lists, pa.array([squeezed(t.words)], pa.binary()), pa.array([pa.compress(at, "zstd", asbytes=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(own, ["bundle", *_NAMES, "lengths", "words", "at"])
            number += 1
        release()

    return docs.mapInArrow(run, "bundle long, doc_id array<long>, text_hash array<long>, held_out array<boolean>, lengths array<long>, words binary, at binary")


def _wide(words: int) -> np.dtype:
    return np.dtype(np.uint16 if words <= 1 << 16 else np.uint32)


def _unpacked(words: bytes, at: bytes, lengths: np.ndarray) -> Texts:
    words, n = unsqueezed(words), int(lengths.sum())
    wide = _wide(len(words))
    at = np.frombuffer(pa.decompress(at, n * wide.itemsize, "zstd", asbytes=True), np.uint8)
    return Texts(words, at.reshape(wide.itemsize, n).T.copy().view(wide).reshape(-1), lengths)


def _texts(b: pa.RecordBatch) -> Iterator[Texts]:
    """The packed texts of every row."""
    lengths = b.column("lengths")
    for k, (words, at) in enumerate(zip(b.column("words"), b.column("at"), strict=True)):
        yield _unpacked(words.as_py(), at.as_py(), lengths[k].values.to_numpy())


def _routed(packed: DataFrame, ranges: int, width: int, scorer) -> DataFrame:
    """(slice, bundle, words, keys): every bundle's distinct rare words and pairs by their
    slices; ``words`` is how many of the keys are words, which come first."""
    slices = -(-ranges // width)
    names = ["slice", "bundle", "words", "keys"]
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary())

    def run(batches):
        scores = scorer()
        for b in batches:
            for bundle, t in zip(b.column("bundle").to_pylist(), _texts(b), strict=True):
                both = scores.rare(t), _counted(t.pairs())[0]
                cuts = [np.searchsorted(_range(x, ranges) // width, np.arange(slices + 1)) for x in both]
                own = [(s, bundle, int(cuts[0][s + 1] - cuts[0][s]), squeezed(np.concatenate([x[c[s] : c[s + 1]] for x, c in zip(both, cuts, strict=True)]))) for s in np.flatnonzero(sum(np.diff(c) for c in cuts)).tolist()]
                for at in range(0, len(own), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own[at : at + 64], strict=True), types, strict=True)], names)
        release()

    return packed.select("bundle", "words", "at", "lengths").mapInArrow(run, "slice int, bundle long, words int, keys binary")


def _noted(packed: DataFrame, segments: DataFrame, ranges: int, segment: int, slice_bits: int, tokens: int, scorer) -> DataFrame:
    """(bundle, slice, words, levels): the levels of every bundle's rare words, first, and pairs.

    Keys meet the segments of their slice in the slice's tasks. A slice has as many tasks as
    its keys need, each with a copy of its segments. Keys of many bundles are probed together.
    """
    width = max(1, slice_bits // segment)
    slices = -(-ranges // width)
    copies = max(1, -(-2 * tokens // (slices * PROBED)))
    none = F.lit(None)
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    bits = segments.select(F.floor(F.col("part") / width).cast("int").alias("slice"), copy, "part", "bits", none.cast("long").alias("bundle"), none.cast("int").alias("words"), none.cast("binary").alias("keys"))
    keys = _routed(packed, ranges, width, scorer)
    keys = keys.select("slice", F.pmod(F.xxhash64("bundle"), F.lit(copies)).cast("int").alias("copy"), none.cast("int").alias("part"), none.cast("binary").alias("bits"), "bundle", "words", "keys")
    # Segments first: their part isn't null.
    dealt = bits.unionByName(keys).repartition(slices * copies, "slice", "copy").sortWithinPartitions("slice", "copy", F.col("part").isNull())

    names = ["bundle", "slice", "words", "levels"]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def probed(model, rows):
        keys = [x[-1] for x in rows]
        levels = model.levels(np.concatenate(keys)).astype(np.uint8)
        ends = np.cumsum([len(x) for x in keys])
        parts = [levels[j - len(x) : j].tobytes() for x, j in zip(keys, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*zip(*(x[:-1] for x in rows), strict=True), parts), types, strict=True)], names)

    def run(batches):
        own, at, rows, size = None, None, [], 0
        for b in batches:
            for s, c, part, bits, bundle, words, keys in zip(*(b.column(k).to_pylist() for k in ("slice", "copy", "part", "bits", "bundle", "words", "keys")), strict=True):
                if rows and (size > SCORED or (s, c) != at):
                    yield probed(own, rows)
                    rows, size = [], 0
                if (s, c) != at:
                    at, n = (s, c), min(width, ranges - s * width)
                    own = Filter(np.zeros(segment * n // 8, np.uint8), ranges, segment, s * width)
                if part is not None:
                    i = (part - s * width) * segment // 8
                    own.bits[i : i + segment // 8] |= np.frombuffer(bits, np.uint8)
                else:
                    rows.append((bundle, s, words, unsqueezed(keys)))
                    size += len(rows[-1][-1])
        if rows:
            yield probed(own, rows)
        own, rows = None, []
        release()

    return settle(dealt.mapInArrow(run, "bundle long, slice int, words int, levels binary"), "noted")


def _tidy(spark: SparkSession) -> None:
    """Let the driver forget what has been written: files of its shuffles go when it does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _scored_by_slices(docs: DataFrame, segments: DataFrame, ranges: int, segment: int, slice_bits: int, tokens: int, scorer) -> DataFrame:
    """Scores with a filter that stays in slices: slices are in the order of the hashes, so
    their levels, one after the other, are those of the sorted hashes."""
    spark = docs.sparkSession
    _tidy(spark)
    packed = settle(_packed(docs), "packed")
    noted = _noted(packed, segments, ranges, segment, slice_bits, tokens, scorer)
    unsettle(segments)
    _tidy(spark)
    notes = noted.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("slice", F.col("words").alias("n_words"), "levels"))).alias("notes"))
    notes = notes.select("bundle", F.col("notes.n_words"), F.col("notes.levels"))

    def run(batches):
        own = scorer()
        for b in batches:
            for k, t in enumerate(_texts(b)):
                n, levels = b.column("n_words")[k].as_py(), b.column("levels")[k].as_py()
                one, two = (np.frombuffer(b"".join(x), np.uint8) for x in ([x[:i] for i, x in zip(n, levels, strict=True)], [x[i:] for i, x in zip(n, levels, strict=True)]))
                part = own(t, one, two[np.unique(t.pairs(), return_inverse=True)[1]])
                yield _scored_batch([b.column(x)[k].values for x in _NAMES], t.lengths, part)
        release()

    scored = settle(packed.join(notes, "bundle").mapInArrow(run, _SCORED), "scored")
    unsettle(packed, noted)
    _tidy(spark)
    return scored


def score(docs: DataFrame, max_bits: int = MAX_BITS, mu: float = MU, slice_bits: int = SLICE_BITS) -> DataFrame:
    """One row for every row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Learns from all documents that aren't held out (crc32 of the id modulo 7 is not 2; a
    null id isn't held out). Null and empty texts are one token, the end. Without training
    texts every word is unknown. Other columns are left out. ``max_bits`` bounds
    what is broadcast, not what is counted: it doesn't change the scores.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    counts = Counts(docs.where(~F.col("held_out")))
    n, v = counts.tokens, counts.types
    frequent = spark.sparkContext.broadcast(counts.frequent(FREQUENT))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))

    def scorer() -> Scorer:
        return Scorer(frequent.value, n, v, mu)

    segments, segment = counts.segments()
    if segment * counts.ranges <= max_bits:
        scored = _scored_at_once(docs, whole_filter(segments, counts.ranges, segment), scorer)
    else:
        scored = _scored_by_slices(docs, segments, counts.ranges, segment, slice_bits, n, scorer)
    name = ["doc_id", "text_hash"]
    one = scored.where(F.size("rare") > 0).groupBy(*name).agg(F.first("rare").alias("rare"))
    joined = one.select(*name, F.explode("rare").alias("word")).groupBy(*name, "word").agg(F.count("*").alias("k")).join(counts.table, "word")
    more = joined.groupBy(*name).agg(F.sum("k").alias("n_rare"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("log_rare"))
    more = more.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    out = scored.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    base = F.col("log_frequent") + F.coalesce("log_rare", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
