"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A batch of texts is one byte array plus offsets; words and their 64-bit hashes come out of a few
vectorised passes over slices of about a megabyte, so that memory does not follow the longest text
(beyond eight bytes a word).  Hashes do not depend on the batch, the slice or the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 15 << 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values whose output bits all depend on all input bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def seeds(n: int, seed: int = 0) -> np.ndarray:
    """``n`` fixed odd 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN + np.uint64(seed * 0x1000193 + 7)) | np.uint64(1)


def _table(excluded: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: ``[^\x20\x09-\x0D]``: bytes of a word between white space.
NOT_SPACE = _table([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` of lower-cased text: digits, letters and all beyond ASCII.
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Letters: A-Z, a-z and all beyond ASCII.
LETTERS = _table([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = seeds(256, 1)[_LOWER]
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _running_products(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


@lru_cache
def _kept_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _running_products(int(_BASE), n), _running_products(pow(int(_BASE), -1, 1 << 64), n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse; for most slices they are kept."""
    return _kept_powers(1 << max(8, (n - 1).bit_length())) if n <= 1 << 20 else _kept_powers.__wrapped__(n)


_POWERS = _powers(256)[0]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``len + 1`` offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return data, offsets


def _cuts(data: np.ndarray, low: int, high: int, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of about ``SLICE`` bytes that end outside words."""
    while low < high:
        end = min(low + SLICE, high)
        while end < high and is_word[data[end]]:
            gap = np.flatnonzero(~is_word[data[end : end + 4096]])
            end = min(end + (int(gap[0]) if len(gap) else 4096), high)
            if len(gap):
                break
        yield low, end
        low = end


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and length of each word, A-Z lower-cased, and the first word of each text (``len + 1``)."""
    hashes, starts, lengths = [], [], []
    byte = np.where(is_word, _BYTE, np.uint64(0))
    for low, high in _cuts(data, int(offsets[0]), int(offsets[-1]), is_word):
        part = data[low:high]
        inside = is_word[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > low) & (offsets < high)] - low
        first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
        at = np.flatnonzero(first)
        if not len(at):
            continue
        # powers run on through the slice; each word's sum is led back to a first power of one, and bytes between words add nothing
        powers, inverse = _powers(len(part))
        value = byte[part]
        value *= powers[: len(part)]
        hashes.append(np.add.reduceat(value, at) * inverse[at])
        starts.append(at + low)
        lengths.append(np.flatnonzero(last) + 1 - at)
    if not hashes:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return mix(np.concatenate(hashes)), start, np.concatenate(lengths), np.searchsorted(start, offsets)


def word_hashes(column: pa.Array, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the first word of each text (``len + 1``)."""
    hashes, _, _, first = spans(*flat(column), is_word)
    return hashes, first


_PLACE = seeds(64, 2)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words, over one array of word hashes."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    n = len(hashes) - k + 1
    out = hashes[:n] * _PLACE[0]
    for i in range(1, k):
        out += hashes[i : n + i] * _PLACE[i]
    return mix(out + np.uint64(k))


def inside_texts(first: np.ndarray, k: int) -> np.ndarray:
    """Which of ``runs`` over a whole batch lie within one text."""
    n = max(int(first[-1]) - k + 1, 0)
    keep = np.ones(n, bool)
    for back in range(1, k):
        at = first[1:] - back
        keep[at[(at >= 0) & (at < n)]] = False
    return keep


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles of one text; a text of fewer words, but not none, is one shingle."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(runs(hashes, min(k, len(hashes))))


def pieces(batches, rows: int = 2048):
    """Record batches cut to at most ``rows`` rows, so that arrays per word stay small beside the batch."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def edge_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int, end: bool = False) -> np.ndarray:
    """A hash of the first (or last) ``n`` bytes of each word, A-Z lower-cased; shorter words count whole."""
    out = np.minimum(sizes, n).astype(np.uint64)
    for i in range(n):
        at = starts + (sizes - 1 - i if end else i)
        out += np.where(i < sizes, _BYTE[data[np.clip(at, 0, max(len(data) - 1, 0))]] * _POWERS[i + 1], np.uint64(0))
    return mix(out + np.uint64(1000 * n + end))


def sum_rows(of: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """The sums of the rows of ``values`` that belong to each of ``rows`` groups."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    if len(of):
        if (of[1:] < of[:-1]).any():
            order = np.argsort(of, kind="stable")
            of, values = of[order], values.take(order, axis=0)
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        out[of[heads]] = np.add.reduceat(values, heads, axis=0)
    return out
