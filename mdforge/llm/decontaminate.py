"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows.

Words are runs of letters A-Z (lower-cased), digits and all characters beyond ASCII. A
window is ``width`` consecutive words of a benchmark item; an item of fewer words is one
window. Tasks hash all windows of their texts at once, look them up in the set, compare
the words of every hit with the benchmark's, and mark the words that a true hit covers.
Nothing is shuffled: a text's hits are found in its batch.

The set is broadcast while the benchmark has at most ``MAX_WORDS`` words. Beyond that the
windows stay in a table: a Bloom filter of at most ``FILTER_BITS`` bits is broadcast
instead, and the windows that pass it are joined to the table on hash and words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdforge.llm.common import map_batches, settle
from mdforge.llm.shingles import _BYTE, _INVERSE, _STEP, _powers, mix

#: Words of a window, and words of a benchmark whose set is broadcast (some 32 bytes each).
WIDTH, MAX_WORDS = 10, 2_000_000
#: Bits of the filter that stands in for a larger set, and its hash functions.
FILTER_BITS, HASHES = 1 << 27, 3
#: Bytes of text whose words are hashed together.
BLOCK = 1 << 20

_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_MASK = np.uint64((1 << 64) - 1)
_powers_of: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    if len(_powers_of[0]) < n:
        _powers_of[0], _powers_of[1] = _powers(int(_STEP), n), _powers(_INVERSE, n)
    return _powers_of[which][:n]


@dataclass
class Words:
    """The words of some texts, one text after the other: hashes, places in ``data``, text ends."""

    data: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_ends: np.ndarray  # number of words up to the end of each text

    @classmethod
    def of(cls, texts: list[str | None]) -> Words:
        """Every text is followed by a byte that no word holds, so no word spans two texts."""
        raw = [(t or "").encode() for t in texts]
        data = b"\n".join(raw).lower() + b"\n"  # bytes: only A-Z change
        places = np.cumsum([len(x) + 1 for x in raw])
        parts = [cls._hashed(data, at, to) for at, to in _blocks(data)]
        hashes, starts, ends = (np.concatenate([p[k] for p in parts]) for k in range(3))
        return cls(data, hashes, starts, ends, np.searchsorted(starts, places))

    @staticmethod
    def _hashed(data: bytes, at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.frombuffer(data, np.uint8)[at:to]
        inside = _IN_WORD[b]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _power(0, len(b)), dtype=np.uint64)])
        hashes = mix((sums[ends] - sums[starts]) * _power(1, len(b) + 1)[starts] + (ends - starts).astype(np.uint64))
        return hashes, starts + at, ends + at

    def phrase(self, first: int, width: int) -> bytes:
        """Words from ``first`` on, joined by spaces."""
        return b" ".join([self.data[s:e] for s, e in zip(self.starts[first : first + width], self.ends[first : first + width], strict=True)])

    def windows(self, width: int, mask: np.uint64 = _MASK) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows that stay within a text."""
        n = len(self.hashes)
        if n < width:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.full(n - width + 1, np.uint64(width))
        for i in range(width):
            h = mix(h * _STEP + self.hashes[i : n - width + 1 + i])
        first = np.arange(n - width + 1)
        within = first + width <= self.text_ends[np.searchsorted(self.text_ends, first, "right")]
        return first[within], h[within] & mask


def _blocks(data: bytes) -> list[tuple[int, int]]:
    """Stretches of about BLOCK bytes that end outside of words."""
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data) and _IN_WORD[data[to - 1]]:
            to += 1
        out.append((at, to))
        at = to
    return out


class WindowSet:
    """The windows of a benchmark by hash, with their words and the items that hold them.

    Equal hashes of different words are kept apart: ``slots`` groups window numbers by
    hash. ``mask`` narrows the hashes, which only tests do.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], width: int, mask: int = int(_MASK)) -> None:
        self.mask = np.uint64(mask)
        words = Words.of([t for _, t in items])
        bounds = np.concatenate([[0], words.text_ends])
        found: dict[bytes, tuple[int, int, int, set[int]]] = {}  # words -> hash, width, first, items
        sizes = np.diff(bounds)
        for k in sorted({min(width, int(n)) for n in sizes if n}):
            first, h = words.windows(k, self.mask)
            item = np.searchsorted(words.text_ends, first, "right")
            own = (sizes[item] == k) | (k == width)
            for f, x, i in zip(first[own].tolist(), h[own].tolist(), item[own].tolist(), strict=True):
                found.setdefault(words.phrase(f, k), (x, k, f, set()))[3].add(i)
        by = sorted(found.values(), key=lambda x: x[:3])
        self.words = words
        self.keys, first = np.unique(np.array([x[0] for x in by], np.uint64), return_index=True)
        self.slots = np.append(first, len(by))
        self.widths = np.array([x[1] for x in by], np.int64)
        self.firsts = np.array([x[2] for x in by], np.int64)
        ids = [sorted({items[i][0] for i in x[3]} - {None}) for x in by]
        self.item_ends = np.cumsum([0, *map(len, ids)])
        self.items = np.array([i for x in ids for i in x], np.int64)
        self.maybe = np.zeros(1 << 20, bool)  # whether a window has these top bits
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Which words true windows cover, and (first word, window number) of each."""
        covered, true = np.zeros(len(words.hashes) + 1, np.int32), []
        for k in np.unique(self.widths).tolist():
            first, h = words.windows(k, self.mask)
            some = np.nonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])[0]
            at = np.searchsorted(self.keys, h[some])
            same = self.keys[np.minimum(at, len(self.keys) - 1)] == h[some]
            for f, x in zip(first[some[same]].tolist(), at[same].tolist(), strict=True):
                phrase = words.phrase(f, k)
                for w in range(self.slots[x], self.slots[x + 1]):
                    if self.widths[w] == k and self.words.phrase(self.firsts[w], k) == phrase:
                        true.append((f, w))
                        covered[f] += 1
                        covered[f + k] -= 1
        return np.cumsum(covered[:-1]) > 0, true

    def items_of(self, window: int) -> np.ndarray:
        return self.items[self.item_ends[window] : self.item_ends[window + 1]]


def _spans(words: Words, hit: np.ndarray, low: int, high: int, text_start: int) -> list[dict[str, int]]:
    """Byte spans, in its text, of the runs of hit words of one text (words low..high)."""
    edge = np.diff(np.concatenate([[0], hit[low:high].astype(np.int8), [0]]))
    first, last = np.nonzero(edge == 1)[0] + low, np.nonzero(edge == -1)[0] + low - 1
    return [{"start": int(words.starts[a] - text_start), "stop": int(words.ends[b] - text_start)} for a, b in zip(first, last, strict=True)]


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
SCAN = "doc_id long, text_hash long, n_words long, n_hit long, items array<long>, spans array<struct<start: long, stop: long>>"
_NAMES = ["doc_id", "text_hash", "n_words", "n_hit", "items", "spans"]


def _scanned(texts: list[str | None], windows: WindowSet) -> list[tuple[int, int, list[int], list[dict[str, int]]]]:
    """(words, hit words, items, spans) of every text."""
    words = Words.of(texts)
    hit, true = windows.hits(words)
    ends = words.text_ends
    starts = np.concatenate([[0], ends[:-1]])
    bytes_at = np.concatenate([[0], np.cumsum([len((t or "").encode()) + 1 for t in texts])])
    items: dict[int, set[int]] = {}
    for f, w in true:
        items.setdefault(int(np.searchsorted(ends, f, "right")), set()).update(windows.items_of(w).tolist())
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[ends] - total[starts]
    return [
        (int(b - a), int(n), sorted(items.get(k, ())), _spans(words, hit, a, b, bytes_at[k]) if n else [])
        for k, (a, b, n) in enumerate(zip(starts, ends, n_hit, strict=True))
    ]


def _groups(texts: list[str | None]) -> list[tuple[int, int]]:
    """Consecutive texts of some BLOCK bytes: the arrays of a batch stay within a few of these."""
    out, at, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK:
            out.append((at, k + 1))
            at, size = k + 1, 0
    return out + ([(at, len(texts))] if at < len(texts) else [])


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def _by_broadcast(docs: DataFrame, windows: WindowSet) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        got = [x for at, to in _groups(texts) for x in _scanned(texts[at:to], shared.value)]
        n, hit, items, spans = zip(*got, strict=True)
        cols = pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(_SPAN))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *cols], _NAMES)

    return map_batches(_named(docs), run, SCAN)


# -- a benchmark beyond the bound ---------------------------------------------------------


def _window_rows(df: DataFrame, ids: list[str], windows: Callable[[Words], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """A row for each of a text's ``windows`` (width, first words, hashes): the ``ids``, number
    of words of the text, first word, width, byte span in the text, words joined, and hash.
    Every text also has one row without a window."""
    types = dict(df.dtypes)
    names = ["first", "width", "start", "stop", "phrase", "h"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches):
        for b in batches:
            own = [b.column(x) for x in ids]
            for k, text in enumerate(b.column("text").to_pylist()):
                words = Words.of([text])
                rows: list[tuple] = [(None,) * len(names)]
                for width, first, h in windows(words):
                    for f, x in zip(first.tolist(), h.view(np.int64).tolist(), strict=True):
                        rows.append((f, width, int(words.starts[f]), int(words.ends[f + width - 1]), words.phrase(f, width), x))
                for at in range(0, len(rows), 50_000):
                    some = rows[at : at + 50_000]
                    same = [pa.array([c[k].as_py()] * len(some), c.type) for c in own]
                    cols = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array([len(words.hashes)] * len(some), pa.int64()), *cols], [*ids, "n_words", *names])

    schema = ", ".join(f"{x} {types[x]}" for x in ids)
    return df.select(*ids, "text").mapInArrow(run, schema + ", n_words long, first long, width int, start long, stop long, phrase binary, h long")


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(h + np.uint64(k * int(_STEP) & int(_MASK))) % np.uint64(bits)).astype(np.int64) for k in range(HASHES)]


def _filter(table: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the column ``h`` as 64-bit numbers: at most ``bits`` / 64 rows reach the driver."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        at = np.unique(np.concatenate(_probes(b.column("h").to_numpy().view(np.uint64), bits)))
        place, first = np.unique(at >> 6, return_index=True)
        own = np.bitwise_or.reduceat(np.left_shift(np.int64(1), at & 63), first)
        return pa.RecordBatch.from_arrays([pa.array(place), pa.array(own)], ["place", "bits"])

    got = map_batches(table.select("h"), run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("place").to_numpy()] = got.column("bits").to_numpy()
    return out


def _by_join(docs: DataFrame, bench: DataFrame, width: int, bits: int) -> DataFrame:
    """The rows of ``scan`` for a benchmark of any size, by a join on the windows' hashes and words.

    A result depends on id and text alone: results are made for each distinct (doc_id,
    text hash) and repeated for its rows.
    """
    spark = docs.sparkSession

    def of_item(words: Words):
        if k := min(width, len(words.hashes)):
            yield k, *words.windows(k)

    table = _window_rows(bench, ["item_id"], of_item).where("h is not null").select("h", "phrase", "width", "item_id")
    table = settle(table.distinct(), "windows")
    widths = [r["width"] for r in table.select("width").distinct().collect()]  # at most ``width`` numbers
    shared = spark.sparkContext.broadcast(_filter(table, bits))

    def of_document(words: Words):
        for k in widths:
            first, h = words.windows(k)
            ok = np.ones(len(h), bool)
            for p in _probes(h, bits):
                ok &= (shared.value[p >> 6] >> (p & 63)) & 1 > 0
            yield k, first[ok], h[ok]

    key = ["doc_id", "text_hash"]
    rows = settle(_window_rows(_named(docs), key, of_document), "candidates")
    sizes = rows.where("h is null").groupBy(*key).agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    true = rows.where("h is not null").join(table, ["h", "phrase", "width"]).select(*key, "first", "width", "start", "stop", "item_id")
    true = settle(true.distinct(), "hits")
    items = true.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))  # no more than there are items
    # Runs of hit words: a window that begins behind all words hit so far begins a new run.
    one = true.groupBy(*key, "first").agg(F.max("width").alias("width"), F.max("stop").alias("stop"), F.min("start").alias("start"))
    order = Window.partitionBy(*key).orderBy("first")  # the windows of one text
    after = F.max(F.col("first") + F.col("width")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("new", F.coalesce((F.col("first") > after).cast("int"), F.lit(1)))
    one = one.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = one.groupBy(*key, "run").agg((F.max(F.col("first") + F.col("width")) - F.min("first")).alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = runs.groupBy(*key).agg(F.sum("n").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    out = sizes
    for more in (items, runs):
        more = more.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
        out = out.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_id", "_hash")
    none = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(*key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans"))


# -- the operator --------------------------------------------------------------------------


def _window_set(bench: DataFrame, width: int, max_words: int) -> WindowSet | None:
    """The set of a benchmark that has at most ``max_words`` words."""
    n = F.regexp_count(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"))
    if (bench.agg(F.sum(n)).first()[0] or 0) > max_words:
        return None
    rows = bench.where(n > 0).toArrow()
    return WindowSet(list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True)), width)


def _items(bench: DataFrame) -> DataFrame:
    return bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())


def scan(docs: DataFrame, bench: DataFrame, width: int = WIDTH, max_words: int = MAX_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items, spans) of every row of ``docs``.

    ``n_hit`` counts the words inside any window of ``bench`` (item_id, text), ``items``
    are the sorted ids of items with such windows, ``spans`` the byte ranges of the runs of
    hit words. Null and empty texts have no words; items without words have no window; an
    item without an id hits words but isn't listed; rows that share an item id are one
    item; repeated documents are scanned alike; other columns are left out.
    """
    bench = _items(bench)
    windows = _window_set(bench, width, max_words)
    return _by_join(docs, bench, width, filter_bits) if windows is None else _by_broadcast(docs, windows)


def _without(text: str, spans: list[dict[str, int]]) -> str:
    raw, out, at = text.encode(), [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["stop"]
    return b"".join([*out, raw[at:]]).decode()


def _replaced(b: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    return b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(texts, b.schema.field("text").type))


def decontaminated(docs: DataFrame, bench: DataFrame, remove: str = "spans", width: int = WIDTH, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut out of the texts, or documents
    with a hit go (``remove`` is ``spans`` or ``documents``). Columns, and rows without a
    hit, stay as they are."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be 'spans' or 'documents'")
    windows = _window_set(_items(bench), width, max_words)
    if windows is not None:
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column("text").to_pylist()
            spans = [x[3] for at, to in _groups(texts) for x in _scanned(texts[at:to], shared.value)]
            if remove == "documents":
                return b.filter(pa.array([not s for s in spans]))
            return _replaced(b, [_without(t, s) if s else t for t, s in zip(texts, spans, strict=True)])

        return map_batches(docs, run, docs.schema)
    found = scan(docs, bench, width, max_words).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    found = settle(found.dropDuplicates(["_id", "_hash"]), "contaminated")
    same: Column = F.col("_id").eqNullSafe(F.col("_doc.doc_id").cast("long")) & (F.col("_hash") == F.xxhash64(F.coalesce("_doc.text", F.lit(""))))
    whole = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_doc"))
    if remove == "documents":
        return whole.join(found, same, "left_anti").select("_doc.*")

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        spans = b.column(b.num_columns - 1).to_pylist()
        return _replaced(b, [_without(t, s) if s else t for t, s in zip(b.column("text").to_pylist(), spans, strict=True)]).select(list(range(b.num_columns - 1)))

    return map_batches(whole.join(found, same, "left").select("_doc.*", "_spans"), cut, docs.schema)


def digests(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (ids sorted as strings, joined by commas), contaminated."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return scan(docs, bench).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
