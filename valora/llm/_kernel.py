"""Vectorised byte, word and window kernels over Arrow text columns.

Every kernel works on the UTF-8 bytes of a block of texts: ``data`` holds the
bytes one after the other, ``offs`` the start of each text and the end of the
last. A block has at least one text and about ``limit`` bytes; a single longer
text makes a block of its own, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
#: Bytes or words that are hashed at once; the tables of powers stay this long.
SEGMENT = 4 << 20
_MULT = 0x9E3779B97F4A7C1B  # odd, 3 mod 8: x - 1 has a single factor two
_WORD_MULT = 0xD1342543DE82EF93
_M64 = (1 << 64) - 1
_table = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**0..n-1 and its inverses modulo 2**64."""
    have = _powers.get(mult)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        out = []
        for m in (mult, pow(mult, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            done, step = 1, m
            while done < size:
                np.multiply(p[:done], np.uint64(step), out=p[done : 2 * done])
                done, step = 2 * done, step * step & _M64
            out.append(p)
        have = _powers[mult] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def texts(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of a batch: its rows, their bytes and offsets. Null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    _, at, raw = col.buffers()
    offs = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK):
    for batch in batches:
        yield from texts(batch, column, limit)


@dataclass
class Words:
    """Word k is data[start[k]:end[k]]; those of text i are at[i]:at[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not separators, within each text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offs), np.int64))
    inside = ~sep[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[:-1][np.diff(offs) > 0]
    first[full] = inside[full]
    ends = offs[1:][np.diff(offs) > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(start, offs))


def word_hashes(data: np.ndarray, w: Words, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the words' bytes, each passed through the table ``fold``."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    if len(data) > SEGMENT and len(w.start) > 1:  # one very long text: by parts that begin with a word
        edges = np.unique(np.append(np.searchsorted(w.start, np.arange(0, len(data), SEGMENT)), len(w.start)))
        out = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            a, b = w.start[lo], w.end[hi - 1]
            part = Words(w.start[lo:hi] - a, w.end[lo:hi] - a, np.array([0, hi - lo]))
            out.append(_hashed(data[a:b], part, fold))
        return np.concatenate(out)
    return _hashed(data, w, fold)


def _hashed(data: np.ndarray, w: Words, fold: np.ndarray | None) -> np.ndarray:
    p, inv = powers(_MULT, len(data) + 1)
    table = _table if fold is None else _table[fold]
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(table[data] * p[: len(data)], out=total[1:])
    h = (total[w.end] - total[w.start]) * inv[w.start]
    h += (w.end - w.start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(h)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of h[i:i + k] for every i, also across texts: see starts()."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if n > SEGMENT:
        return np.concatenate([windows(h[lo : min(lo + SEGMENT, n) + k - 1], k) for lo in range(0, n, SEGMENT)])
    p, inv = powers(_WORD_MULT, len(h) + 1)
    total = np.empty(len(h) + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix((total[k:] - total[:n]) * inv[:n])


def starts(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Global indices of the windows of k words that lie in one text, and the offsets by text."""
    counts = np.maximum(np.diff(at) - k + 1, 0)
    where = np.zeros(len(at), np.int64)
    np.cumsum(counts, out=where[1:])
    idx = np.arange(where[-1]) + np.repeat(at[:-1] - where[:-1], counts)
    return idx, where


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]], also where a segment is empty."""
    total = np.cumsum(values)
    total = np.concatenate([np.zeros(1, total.dtype), total])
    return total[at[1:]] - total[at[:-1]]


def as_text(data: np.ndarray) -> str:
    return data.tobytes().decode("utf-8", "replace")


def place_in(h: np.ndarray, sorted_hashes: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted ones, -1 where it isn't there."""
    if not len(sorted_hashes):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == h, at, -1)
