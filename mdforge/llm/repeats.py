"""Removal of byte strings that repeat anywhere in a corpus.

Equal strings of ``length`` bytes hold the same anchor: the place where the hash of
``GRAM`` bytes is smallest (leftmost among equals). So

1. every text is scanned once; consecutive windows with one anchor form a run;
2. runs whose anchor occurs nowhere else hold no repeated window and go; runs that equal
   another run as a whole are repeated as a whole;
3. what is left (one run for each distinct text, next to differing ones) is split by the
   distance to the anchor into short runs of ``SHORT`` windows. The windows of a short run
   share a core, and short runs meet those with an equal core;
4. the differing short runs form collections of strings: the bytes before the core, one
   symbol for the core, the bytes after it. A collection's transform and common prefixes
   are built column by column; a window is ``SHORT`` symbols, repeated where a
   neighbouring suffix shares as many.

No task gets an unbounded group: equal runs and equal short runs are counted map-side, and
a core with more than ``GROUP`` different strings is resolved by counting its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdforge.llm.collection_bwt import repeated_suffixes
from mdforge.llm.common import map_batches, settle, unsettle
from mdforge.llm.shingles import _BYTE, _INVERSE, _STEP, _powers, mix

LENGTH, GRAM, SHORT = 400, 100, 25
#: Different strings of one core that are put into one collection; beyond, windows are counted.
GROUP = 4_000
#: Symbols and strings of a collection built at a time (cores take symbols 257..65535).
COLLECTION_SYMBOLS, COLLECTION_CORES = 500_000, 60_000
#: Bytes scanned at a time.
STRETCH = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)
_RUN = "doc_id long, text_hash long, anchor long, whole long, a int, i0 int, i1 int"


class _Scan:
    """Runs of windows with a common anchor in a buffer of several texts."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram = length, gram
        n = STRETCH * 2 + 2 * length + 1
        self.up, self.down = _powers(int(_STEP), n), _powers(_INVERSE, n)

    def runs(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray):
        """anchor hash, run hash, anchor place, first and last window of every run."""
        b = np.frombuffer(buffer, np.uint8)
        n, k, w = len(b), self.gram, self.length - self.gram + 1
        if len(self.up) < n + 1:
            self.up, self.down = _powers(int(_STEP), n + 1), _powers(_INVERSE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * self.up[:n], out=sums[1:])
        gram = mix((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        least = (gram & ~_PLACE) | np.arange(n - k + 1, dtype=np.uint64)
        size = 1
        while 2 * size <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < w:
            least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
        inside = np.zeros(n + 1, np.int8)
        long = ends - starts >= self.length
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, ends[long] - self.length + 1, -1)
        window = np.nonzero(np.cumsum(inside[: len(least)]))[0]
        place = (least[window] & _PLACE).astype(np.int64)
        new = np.nonzero(np.diff(place, prepend=-1))[0]
        first, last = window[new], window[np.append(new[1:], len(window)) - 1]
        a = place[new]
        whole = (sums[last + self.length] - sums[first]) * self.down[first]
        whole = mix(whole ^ mix(((last - first) * 4096 + (a - first)).astype(np.uint64)))
        return gram[a].view(np.int64), whole.view(np.int64), a, first, last


def _pieces(texts: list[bytes], length: int):
    """Buffers of about STRETCH bytes: (joined bytes, [(text number, start in it, bytes)])."""
    held, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), STRETCH):
            part = t[at : at + STRETCH + length - 1]
            if held and size + len(part) > STRETCH:
                yield held
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if held:
        yield held


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (together they name a text; equal rows are handled as one) and bytes."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes")
    )


def runs_of(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """All runs of all texts (see ``_RUN``)."""
    scan: list[_Scan] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not scan:
            scan.append(_Scan(length, gram))
        ids, hashes = b.column("doc_id").to_numpy(), b.column("text_hash").to_numpy()
        out = [[np.empty(0, np.int64)] for _ in range(6)]
        for held in _pieces(b.column("bytes").to_pylist(), length):
            sizes = np.array([len(p) for _, _, p in held])
            ends = np.cumsum(sizes)
            starts = ends - sizes
            anchor, whole, a, first, last = scan[0].runs(b"".join(p for _, _, p in held), starts, ends)
            of = np.searchsorted(ends, first, side="right")
            shift = np.array([at for _, at, _ in held])[of] - starts[of]
            for x, v in zip(out, (np.array([k for k, _, _ in held])[of], anchor, whole, a + shift, first + shift, last + shift), strict=True):
                x.append(v)
        of, anchor, whole, a, first, last = map(np.concatenate, out)
        cols = [ids[of], hashes[of], anchor, whole, a.astype(np.int32), first.astype(np.int32), last.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [x.split()[0] for x in _RUN.split(", ")])

    return map_batches(_keyed(docs), run, _RUN)


def short_runs(texts: DataFrame, length: int) -> DataFrame:
    """Short runs of texts with an array of runs: core, doc_id, text_hash, at, before, after.

    ``at``: place of the first window; ``before`` and ``after``: the bytes round the core.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [[] for _ in range(6)]
        for doc, h, t, runs in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("bytes").to_pylist(), b.column("runs").to_pylist(), strict=True):
            for r in runs:
                a = r["a"]
                for q in range((a - r["i1"]) // SHORT, (a - r["i0"]) // SHORT + 1):
                    i0, i1 = max(r["i0"], a - q * SHORT - SHORT + 1), min(r["i1"], a - q * SHORT)
                    c0, c1 = a - q * SHORT, a - q * SHORT - SHORT + 1 + length
                    core = xxhash.xxh3_64_intdigest(t[c0:c1], seed=q)
                    for x, v in zip(out, (core - (1 << 63), doc, h, i0, t[i0:c0], t[c1 : i1 + length]), strict=True):
                        x.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(out, types, strict=True)], ["core", "doc_id", "text_hash", "at", "before", "after"])

    return map_batches(texts, run, "core long, doc_id long, text_hash long, at int, before binary, after binary")


def _in_collections(batches):
    """Spans of repeated windows among short runs sorted by core."""
    held, cores, size, last = [], 0, 0, None

    def spans():
        symbols, ends, n = [], [], 0
        for g, (_, _, _, _, before, after) in held:
            s = np.frombuffer(before + b"\0" + after, np.uint8).astype(np.uint16) + 1
            s[len(before)] = 257 + g
            symbols.append(s)
            ends.append(n := n + len(s))
        again = repeated_suffixes(np.concatenate(symbols), np.array(ends), SHORT)
        out, at = [[], [], [], []], 0
        for (_, (_, doc, h, place, _, _)), end in zip(held, ends, strict=True):
            edge = np.diff(np.concatenate([[0], again[at:end].view(np.int8), [0]]))
            for x, y in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0], strict=True):
                for c, v in zip(out, (doc, h, place + int(x), place + int(y) - 1), strict=True):
                    c.append(v)
            at = end
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["doc_id", "text_hash", "i0", "i1"])

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("core", "doc_id", "text_hash", "at", "before", "after")), strict=True):
            if row[0] != last:
                if held and (size > COLLECTION_SYMBOLS or cores >= COLLECTION_CORES):
                    yield spans()
                    held, cores, size = [], 0, 0
                last, cores = row[0], cores + 1
            held.append((cores - 1, row))
            size += len(row[4]) + len(row[5]) + 1
    if held:
        yield spans()


def _by_windows(short: DataFrame) -> DataFrame:
    """The same for cores with very many different strings: windows are counted."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [[] for _ in range(4)]
        for core, doc, h, at, before, after in zip(*(b.column(c).to_pylist() for c in ("core", "doc_id", "text_hash", "at", "before", "after")), strict=True):
            n = len(before) + 1 + len(after)
            for x in range(n - SHORT + 1):
                key = xxhash.xxh3_64_intdigest(before[x:] + b"|" + after[: SHORT - 1 - len(before) + x], seed=core & (1 << 64) - 1)
                for c, v in zip(out, (key - (1 << 63), doc, h, at + x), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["key", "doc_id", "text_hash", "i0"])

    windows = map_batches(short, run, "key long, doc_id long, text_hash long, i0 int")
    again = settle(windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "windows")
    return windows.join(again, "key").select("doc_id", "text_hash", "i0", F.col("i0").alias("i1"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_hash, i0, i1) windows i0..i1 that are repeated, texts that hold any run to look at)."""
    name = ["doc_id", "text_hash"]
    every = settle(runs_of(docs, length, gram), "runs")
    # A table that is joined to the rows it was counted from is settled first: both sides
    # of the join are then plain exchanges, whose hot partitions Spark splits.
    met = settle(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    runs = settle(every.join(met, "anchor"), "met")
    unsettle(every, met)
    texts = runs.select(*name).distinct()
    texts = settle(_keyed(docs).join(texts, name, "left_semi"), "texts")

    # Equal runs are one row from here on: where it stands first, and how often.
    first = F.min(F.struct("doc_id", "text_hash", "i0", "i1", "a")).alias("x")
    equal = settle(runs.groupBy("anchor", "whole").agg(F.count("*").alias("n"), first), "equal")
    spans = runs.join(equal.where("n > 1").select("anchor", "whole"), ["anchor", "whole"]).select(*name, "i0", "i1")
    several = settle(equal.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "several")
    differing = equal.join(several, "anchor").select("x.*")
    per_text = differing.groupBy(*name).agg(F.collect_list(F.struct("a", "i0", "i1")).alias("runs"))
    short = short_runs(texts.dropDuplicates(name).join(per_text, name), length)
    short = settle(short, "short")

    # Equal short runs meet as one; those that occur more than once are repeated.
    key = ["core", "before", "after"]
    one = short.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "at")).alias("x"))
    one = settle(one, "one")
    windows = F.length("before") + F.length("after") + 1 - SHORT
    several = short.join(one.where("n > 1").select(*key), key).select(*name, F.col("at").alias("i0"), (F.col("at") + windows).alias("i1"))
    groups = settle(one.groupBy("core").agg(F.count("*").alias("k")).where("k > 1"), "cores")
    left = one.join(groups, "core").select("core", "x.doc_id", "x.text_hash", "x.at", "before", "after", "k")
    left = settle(left, "left")
    few = left.where(F.col("k") <= GROUP).drop("k").repartition("core").sortWithinPartitions("core")
    columns = "doc_id long, text_hash long, i0 int, i1 int"
    found = few.mapInArrow(_in_collections, columns).union(_by_windows(left.where(F.col("k") > GROUP).drop("k")))
    return spans.union(several).union(found), texts


def _cut(text: bytes, spans: list[dict], length: int) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, and maximal removed runs."""
    kept, n, at, gone = [], 0, 0, 0
    end = -1
    for i0, i1 in sorted((s["i0"], s["i1"]) for s in spans):
        if i0 > end:
            kept.append(text[at:i0])
            n += 1
            gone += i1 + length - i0
        else:
            gone += max(0, i1 + length - end)
        end = max(end, i1 + length)
        at = end
    kept.append(text[at:])
    return b"".join(kept), gone, n


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, bytes, n_removed, n_spans) of the texts that lose anything.

    ``bytes``: what is left. Rows with equal id and text are one row here.
    """
    spans, texts = repeated_spans(docs, length, gram)
    name = ["doc_id", "text_hash"]
    per_text = spans.groupBy(*name).agg(F.collect_set(F.struct("i0", "i1")).alias("spans"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [_cut(t, s, length) for t, s in zip(b.column("bytes").to_pylist(), b.column("spans").to_pylist(), strict=True)]
        cols = [b.column("doc_id"), b.column("text_hash"), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "bytes", "n_removed", "n_spans"])

    joined = texts.dropDuplicates(name).join(per_text, name)
    return map_batches(joined, run, "doc_id long, text_hash long, bytes binary, n_removed long, n_spans long")


def repeat_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Null and empty texts have no bytes; texts shorter than ``length`` lose nothing. Rows
    that are equal repeat each other's whole text. Other columns are left out.
    """
    cut = remove_repeats(docs, length, gram).select("doc_id", "text_hash", "n_removed", "n_spans", F.sha2("bytes", 256).alias("cut_sha256"))
    cut = settle(cut, "cut")
    whole = _keyed(docs).select("doc_id", "text_hash", F.length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256"))
    out = whole.join(cut, ["doc_id", "text_hash"], "left")
    return out.select(
        F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``; other columns stay.

    A character that a cut splits goes with it. Only texts that lose something are
    shuffled back to their rows.
    """
    cut = remove_repeats(docs, length, gram)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        left = [x.decode(errors="ignore") for x in b.column("bytes").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(left, pa.string())], ["_id", "_hash", "_left"])

    cut = settle(map_batches(cut.select("doc_id", "text_hash", "bytes"), run, "_id long, _hash long, _left string"), "cut")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    key = (F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(-(1 << 63))) == F.col("_id")) & (F.xxhash64("_row.text") == F.col("_hash"))
    joined = rows.join(cut, key, "left")
    return joined.select(*[F.coalesce("_left", "_row.text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
