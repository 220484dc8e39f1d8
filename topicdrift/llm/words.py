"""Words of whole texts as numpy arrays: boundaries, 64-bit hashes, windows.

A word is a run of bytes other than space and 0x09-0x0D. These bytes never occur inside a
multi-byte UTF-8 character, so cutting the bytes cuts the text. All helpers work on one Arrow
batch inside a task; they hold a few arrays of eight bytes per byte of text, so callers cut
batches with `pieces`.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

#: Bytes of text handled at a time; one longer document is handled alone.
PIECE_BYTES = 1 << 18

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept between calls up to the usual size."""
    kept = _powers.get(base)
    if kept is None or len(kept[0]) < n:
        up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 2**64), dtype=np.uint64)
        up[:1] = down[:1] = 1
        kept = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n <= 2 * PIECE_BYTES:
            _powers[base] = kept
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(texts: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts of about `most` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if len(texts) == 0:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        own = offsets[first : last + 1]
        yield first, data[own[0] : own[-1]], own - own[0]
        first = last


class Words:
    """The words of a run of texts: `start`, `end` (bytes), `doc` (index of the text), `hash`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[data]
        begins = inside[1:-1] & ~inside[:-2]
        finishes = inside[1:-1] & ~inside[2:]
        edges = offsets[:-1][np.diff(offsets) > 0]
        begins[edges] = inside[edges + 1]
        finishes[edges[1:] - 1] = inside[edges[1:]]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(finishes) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.per_doc = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.per_doc)])
        self._total = self._sums()
        self.hash = mix(self.range_hash(self.start, self.end))

    def __len__(self) -> int:
        return len(self.start)

    def _sums(self) -> np.ndarray:
        up, _ = _power(_BASES[0], len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[self.data] * up[: len(self.data)], out=total[1:])
        return total

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start to end, the same wherever they stand."""
        _, down = _power(_BASES[0], len(self.data) + 1)
        return (self._total[end] - self._total[start]) * down[start]

    def only(self, chosen: np.ndarray) -> Words:
        """The chosen words alone, for `range_hash`; windows would join words that were apart."""
        out = copy.copy(self)
        out.start, out.end, out.doc, out.hash = self.start[chosen], self.end[chosen], self.doc[chosen], self.hash[chosen]
        return out

    def windows(self, size: int, lane: int = 1) -> np.ndarray:
        """Hashes of the runs of `size` words that start at word 0, 1, ...; see `inside` for which stay in a text."""
        return window_hashes(self.hash, size, lane)

    def inside(self, size: int) -> np.ndarray:
        """Whether the window of `size` words from word i lies in one text."""
        n = len(self) - size + 1
        return self.doc[:n] == self.doc[size - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def window_hashes(values: np.ndarray, size: int, lane: int = 1) -> np.ndarray:
    """Hash of every run of `size` values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power(_BASES[lane], len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[size:] - total[:n]) * down[:n])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least value of every run of `size` values."""
    done, out = 1, x
    while done < size:
        step = min(done, size - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(words: Words, window: int, gram: int = 5) -> np.ndarray:
    """For each window of `window` words, the least hash of its grams: equal windows have equal anchors."""
    grams = words.windows(gram)
    return sliding_min(grams, window - gram + 1) if len(words) >= window else np.zeros(0, dtype=np.uint64)


def member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted table."""
    if len(table) == 0:
        return np.zeros(len(keys), dtype=bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys
