"""Vectorised words, word hashes and Rabin-Karp window hashes over Arrow text columns.

Everything here works on a run of whole documents at a time: the UTF-8 buffer of an Arrow
column is scanned once with numpy, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer document is a run of its own.
RUN_BYTES = 1 << 19
#: Rows that are cast together, so that a batch is never copied as a whole.
RUN_ROWS = 2000
#: Fixed odd multipliers of the polynomial hashes of words and of windows, and of second ones of both.
WORD_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
WORD_BASE_2, WINDOW_BASE_2 = 0xC2B2AE3D27D4EB4F, 0xAF251AF3B0F025B5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES_2 = np.random.default_rng(20240602).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_powers: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    """start, end: byte range of each word in the run; doc: row in the run; hash: uint64; first: first word of each row."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, RUN_BYTES + 1)
        steps = np.full(size, base & (2**64 - 1), np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 16 * RUN_BYTES:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (shift-xor-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(column: pa.Array | pa.ChunkedArray, limit: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about `limit` bytes; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for start in range(0, len(column), RUN_ROWS):
        part = column.slice(start, RUN_ROWS).cast(pa.large_string()).fill_null("")
        _, at, data = part.buffers()
        offsets = np.frombuffer(at, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(part):
            j = min(len(part), max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
            yield start + i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> Words:
    """Maximal runs of bytes other than space, tab, LF, VT, FF and CR; fold: A-Z count as a-z in the hash."""
    n = len(data)
    rows = len(offsets) - 1
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(doc, np.arange(rows + 1))
    return Words(start, end, doc, word_hash((_FOLDED if fold else _BYTES)[data], start, end, WORD_BASE), first)


def word_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of the values (one for each byte) of every word."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n)[:n], out=total[1:])
    return mix((total[end] - total[start]) * powers(pow(base, -1, 2**64), n)[start])


def second_hash(data: np.ndarray, w: Words) -> np.ndarray:
    """A hash of every word (unfolded) that is independent of the first."""
    return word_hash(_BYTES_2[data], w.start, w.end, WORD_BASE_2)


def windows(hashes: np.ndarray, k: int, base: int = WINDOW_BASE) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive values; those across documents are the caller's to leave out."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(base, n)[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(pow(base, -1, 2**64), n)[: n - k + 1])


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each k-word shingle, repeats included; a document of 1 to k-1 words has its whole sequence as one."""
    h = windows(w.hash, k)
    doc = w.doc[: len(h)]
    whole = doc == w.doc[k - 1 :] if len(h) else np.zeros(0, bool)
    doc, h = doc[whole], h[whole]
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([windows(w.hash[w.first[d] : w.first[d + 1]], int(counts[d]))[0] for d in short], np.uint64)
        extra = mix(extra + counts[short].astype(np.uint64))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, extra])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def lengths(w: Words, k: int) -> np.ndarray:
    """The bytes in the words of each shingle, in the order of shingles()."""
    total = np.append(0, np.cumsum(w.end - w.start))
    n = max(0, len(w.hash) - k + 1)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :]) if n else np.zeros(0, np.int64)
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    size = np.concatenate([total[at + k] - total[at], total[w.first[short + 1]] - total[w.first[short]]])
    return size[np.argsort(np.concatenate([w.doc[at], short]), kind="stable")]


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, sorted."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    if len(h):
        keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]
