"""Fill-in-middle transformation as a pyarrow.compute pipeline over Arrow batches.

A batch's texts become list arrays of units; the lists are flattened beside the indices
of their parents; a unit's ordinal in its text and the text's two cuts give its role
(prefix, middle or suffix); the units of a role are filtered, put into lists again and
joined to pieces; the pieces and marks are joined to the output. Units share the batch's
bytes, so splitting copies nothing. A batch is handled in stretches of at most ``BLOCK``
bytes, and a longer text in several, whose pieces are joined once more: the memory
beside the texts doesn't grow with a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdforge.llm.common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Of a hundred texts: those cut at all, and of these those written suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes split into units together.
BLOCK = 4 << 20
UNITS = ("char", "word")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def draws(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the sha256 of ``seed:doc_id``; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, and the n + 1 places where its texts begin and end."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), ends.astype(np.int64)


def _begins(data: np.ndarray, text_starts: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit begins at each byte: a code point, or a word with the spaces after it."""
    if unit == "char":
        return (data & 0xC0) != 0x80
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    first[text_starts[text_starts < len(data)]] = True
    return first


def _stretches(starts: np.ndarray, ends: np.ndarray, begins, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, ends) of the texts, or parts of a text cut where a unit begins, by ``block`` bytes."""
    row, n = 0, len(starts)
    while row < n:
        to = max(row + 1, int(np.searchsorted(ends, starts[row] + block, "right")))
        if to > row + 1 or ends[row] - starts[row] <= block:
            yield np.arange(row, to), starts[row:to], ends[row:to]
        else:
            at, end = int(starts[row]), int(ends[row])
            while at < end:
                cut = min(end, at + block)
                while cut < end and not begins(cut):
                    cut += 1
                yield np.array([row]), np.array([at]), np.array([cut])
                at = cut
        row = to


class Units:
    """The units of a batch of texts, stretch by stretch."""

    def __init__(self, texts: pa.StringArray, unit: str = "char", block: int = BLOCK) -> None:
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}")
        self.texts, self.unit, self.block = texts, unit, block
        self.data, bounds = _bytes(texts)
        self.starts, self.ends = bounds[:-1], bounds[1:]

    def _begins_at(self, at: int) -> bool:
        if self.unit == "char":
            return (self.data[at] & 0xC0) != 0x80
        return bool(not _SPACE[self.data[at]] and _SPACE[self.data[at - 1]])

    def lists(self) -> Iterator[tuple[np.ndarray, pa.ListArray]]:
        """(rows, list array of the units of each of these rows' texts or parts of a text)."""
        for rows, starts, ends in _stretches(self.starts, self.ends, self._begins_at, self.block):
            low, high = int(starts[0]), int(ends[-1])
            at = np.nonzero(_begins(self.data[low:high], starts - low, self.unit))[0]
            places = np.append(at, high - low).astype(np.int32)
            data = pa.py_buffer(self.data[low:high])
            units = pa.StringArray.from_buffers(len(at), pa.py_buffer(places), data)
            lists = np.searchsorted(at, np.append(starts, high) - low).astype(np.int32)
            yield rows, pa.ListArray.from_arrays(pa.array(lists, pa.int32()), units)

    def counts(self) -> np.ndarray:
        """Number of units of each text."""
        n = np.zeros(len(self.texts), np.int64)
        for rows, lists in self.lists():
            np.add.at(n, rows, pc.list_value_length(lists).to_numpy())
        return n

    def pieces(self, first_cut: np.ndarray, second_cut: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Prefix, middle and suffix of each text, cut after so many of its units."""
        seen = np.zeros(len(self.texts), np.int64)  # units of a text in earlier stretches
        parts, owners = ([], [], []), []
        for rows, lists in self.lists():
            flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
            length = pc.list_value_length(lists).to_numpy()
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            by_parent = lambda x: pc.take(pa.array(x), parent)  # noqa: B023, E731
            ordinal = pc.add(pc.subtract(pa.array(np.arange(len(flat))), by_parent(first)), by_parent(seen[rows]))
            after_first = pc.greater_equal(ordinal, by_parent(first_cut[rows]))
            after_second = pc.greater_equal(ordinal, by_parent(second_cut[rows]))
            for out, role in zip(parts, (pc.invert(after_first), pc.and_not(after_first, after_second), after_second), strict=True):
                of = pc.filter(parent, role).to_numpy()
                ends = np.searchsorted(of, np.arange(len(rows) + 1)).astype(np.int32)
                out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pc.filter(flat, role)), ""))
            owners.append(rows)
            seen[rows] += length
        if not owners:
            return tuple(pa.array([], pa.string()) for _ in parts)
        rows = np.concatenate(owners)
        joined = tuple(pa.concat_arrays(x) for x in parts)
        if len(rows) == len(self.texts):
            return joined
        ends = pa.array(np.searchsorted(rows, np.arange(len(self.texts) + 1)).astype(np.int32))
        return tuple(pc.binary_join(pa.ListArray.from_arrays(ends, x), "") for x in joined)


def transform(texts: pa.Array, h: list[np.ndarray], unit: str = "char", block: int = BLOCK) -> tuple[pa.Array, ...]:
    """(units, form, prefix units, middle units, output) of every text; ``h`` holds four draws a text.

    The prefix ends after the smaller and the middle after the larger of h1 and h2 modulo
    units + 1. A text stays ``plain`` if it is empty, holds a mark, or h3 says so.
    """
    texts = pc.fill_null(texts, "")
    units = Units(texts, unit, block)
    n = units.counts()
    cuts = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(*cuts), np.maximum(*cuts)
    marked = [pc.match_substring(texts, m).to_numpy(zero_copy_only=False) for m in MARKS]
    plain = (n == 0) | np.logical_or.reduce(marked) | (h[2] % 100 >= CUT)
    suffix_first = h[3] % 100 < SUFFIX_FIRST
    prefix, middle, suffix = units.pieces(low, high)
    p, s, m = (pa.scalar(x) for x in MARKS)
    join = pc.binary_join_element_wise
    psm = join(p, prefix, s, suffix, m, middle, "")
    spm = join(s, suffix, p, prefix, m, middle, "")
    output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(suffix_first), spm, psm))
    form = pa.array(np.where(plain, "plain", np.where(suffix_first, "spm", "psm")).tolist(), pa.string())
    return pa.array(n), form, pa.array(low, mask=plain), pa.array(high - low, mask=plain), output


def _halves(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What is before and after a mark that each text holds once."""
    both = pc.list_flatten(pc.split_pattern(texts, mark, max_splits=1))
    at = np.arange(len(texts)) * 2
    return both.take(pa.array(at)), both.take(pa.array(at + 1))


def restore(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that ``transform`` was given, from its outputs and forms alone."""
    forms = np.array(form.to_pylist(), dtype=object)
    restored, places = [output.filter(pa.array(forms == "plain"))], [np.nonzero(forms == "plain")[0]]
    for name, outer, inner in (("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX)):
        some = output.filter(pa.array(forms == name))
        rest, middle = _halves(some, MIDDLE)
        one, two = _halves(rest, inner)
        one = pc.binary_replace_slice(one.cast(pa.binary()), 0, len(outer), b"").cast(pa.string())
        pieces = (one, middle, two) if name == "psm" else (two, middle, one)
        restored.append(pc.binary_join_element_wise(*pieces, ""))
        places.append(np.nonzero(forms == name)[0])
    return pa.concat_arrays(restored).take(pa.array(np.argsort(np.concatenate(places))))


def _prepared(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *draws(F.col("doc_id"), seed))


def _transformed(b: pa.RecordBatch, unit: str) -> tuple[pa.Array, ...]:
    return transform(b.column("text"), [b.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)], unit)


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = "char") -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of every row of ``docs``.

    Null and empty texts are plain and empty; a null id draws as an empty one; repeated
    rows are transformed alike; other columns are left out. ``unit``: code points, or
    words with the white space after them.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *_transformed(b, unit)], ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    return map_batches(_prepared(docs, seed), run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts behind a table (doc_id, form, output) of ``fill_in_middle``."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), restore(b.column("output"), b.column("form"))], ["doc_id", "text"])

    return map_batches(outputs.select("doc_id", "form", "output"), run, "doc_id long, text string")


def _sha(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], pa.string())


def digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``fill_in_middle`` in code points with digests of the outputs and of the restored texts,
    taken in the same batch, so that no text leaves the worker."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, form, prefix, middle, output = _transformed(b, "char")
        return pa.RecordBatch.from_arrays([b.column("doc_id"), n, form, prefix, middle, _sha(output), _sha(restore(output, form))], names)

    return map_batches(_prepared(docs, seed), run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
