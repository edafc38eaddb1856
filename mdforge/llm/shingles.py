"""Word shingles of whole texts as 64-bit hashes, for all texts of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = _BYTE[np.frombuffer(bytes(range(256)).lower(), np.uint8)]
#: Bytes hashed together: bounds the memory of a batch of long texts.
CHUNK = 4 << 20
#: Bytes of the texts of a column that are hashed together: their sums stay in the cache.
BLOCK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


_INVERSE = pow(int(_STEP), -1, 1 << 64)


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word of a lower-cased text (words: runs of non-space bytes)."""
    b = np.frombuffer(text, np.uint8)
    inside = ~_SPACE[b]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(b)
    if len(_UP[0]) < n + 1:
        _UP[0], _UP[1] = _powers(int(_STEP), n + 1), _powers(_INVERSE, n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _UP[0][:n], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * _UP[1][starts] + (ends - starts).astype(np.uint64))


_UP = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def text_words(text: str | bytes | None) -> np.ndarray:
    """Word hashes of a whole text, hashed in stretches that end at a space."""
    if not text:
        return np.empty(0, np.uint64)
    low = (text.encode() if isinstance(text, str) else text).lower()  # bytes: only A-Z change
    if len(low) <= CHUNK:
        return word_hashes(low)
    parts, at = [], 0
    while at < len(low):
        to = at + CHUNK
        while to < len(low) and not _SPACE[low[to]]:
            to += 1
        parts.append(word_hashes(low[at:to]))
        at = to
    return np.concatenate(parts)


def column_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a column, one text after the other, and each text's number
    of words: those of ``text_words``, for the texts of a block at a time."""
    n = len(column)
    column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    words, counts, i = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
        if j == i + 1 and ends[j] - ends[i] > CHUNK:
            words.append(text_words(data[ends[i] : ends[j]].tobytes()))
            counts.append(np.array([len(words[-1])]))
        else:
            own, starts = _block_words(data[ends[i] : ends[j]], ends[i + 1 : j] - ends[i])
            words.append(own)
            counts.append(np.diff(np.searchsorted(starts, ends[i : j + 1] - ends[i])))
        i = j
    return np.concatenate(words), np.concatenate(counts)


def _block_words(b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of consecutive texts and the words' places; a new text begins at each cut."""
    n = len(b)
    inside = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[b], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # a word's start and end, in turn
    met = cuts[inside[cuts] & inside[cuts + 1]]  # a word ends where the next text's word starts
    if len(met):
        met = np.repeat(np.unique(met), 2)
        edges = np.insert(edges, np.searchsorted(edges, met), met)
    starts, ends = edges[::2], edges[1::2]
    if len(_UP[0]) < n + 1:
        _UP[0], _UP[1] = _powers(int(_STEP), n + 1), _powers(_INVERSE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOW[b] * _UP[0][:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _UP[1][starts] + (ends - starts).astype(np.uint64)), starts


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes, sorted. Fewer words than ``width``: the whole sequence."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    h = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        h = mix(h * _STEP + words[i : n - k + 1 + i])
    return np.unique(h)
