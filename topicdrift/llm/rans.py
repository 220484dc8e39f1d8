"""Interleaved range asymmetric numeral system over arrays of 16-bit ids.

One block is coded by `LANES` states side by side: id i belongs to lane i mod LANES. States
are 64-bit and give off 32-bit words, in lane order within a step, so that a reader takes the
words in the order in which it needs them. Frequencies add up to 2**BITS.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
LANES = 1024
#: Steps between two checkpoints: a reader may start at any of them.
CHECKPOINT_STEPS = 512
MAGIC = b"RNS1"
_LOW = np.uint64(1 << 32)
_HEAD = struct.Struct("<4sIQIIII")


class Table:
    """Frequencies of ids, scaled to 2**BITS; each id that occurs keeps at least one."""

    def __init__(self, counts: np.ndarray):
        counts = counts.astype(np.float64)
        present = counts > 0
        spare = (1 << BITS) - int(present.sum())
        scaled = np.where(present, 1 + np.floor(counts / max(counts.sum(), 1) * spare), 0).astype(np.int64)
        if present.any():
            scaled[int(np.argmax(counts))] += (1 << BITS) - int(scaled.sum())
        self.freq = scaled.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(scaled)])[:-1].astype(np.uint64)
        self.crc = zlib.crc32(scaled.astype("<u4").tobytes())
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))
        return self._symbol


def encode(ids: np.ndarray, table: Table) -> bytes:
    """A frame: head, checkpoints (word position and states), words, checksum of all before."""
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, _LOW, dtype=np.uint64)
    words, marks = [], []
    bits, shift = np.uint64(BITS), np.uint64(64 - BITS)
    for step in range(steps - 1, -1, -1):
        own = ids[step * LANES : (step + 1) * LANES]
        freq, base, x = table.freq[own], table.base[own], state[: len(own)]
        full = (x >> shift) >= freq
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> np.uint64(32), x)
        high = x // freq
        state[: len(own)] = (high << bits) + (x - high * freq) + base
        if step % CHECKPOINT_STEPS == 0:
            marks.append((len(words), state.copy()))
    words.reverse()
    sizes = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    stream = np.concatenate(words) if words else np.zeros(0, "<u4")
    points = [(sizes[steps - done], x) for done, x in reversed(marks)]
    body = b"".join(
        [_HEAD.pack(MAGIC, table.crc, n, LANES, CHECKPOINT_STEPS, len(points), len(stream))]
        + [np.array([place], "<u4").tobytes() + x.astype("<u8").tobytes() for place, x in points]
        + [stream.tobytes()]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def decode(frame: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids between two checkpoints (default: all). Raises ValueError if the frame is damaged or the table is another."""
    if len(frame) < _HEAD.size + 4 or zlib.crc32(frame[:-4]) != struct.unpack("<I", frame[-4:])[0]:
        raise ValueError("damaged block")
    magic, crc, n, lanes, every, points, total = _HEAD.unpack_from(frame)
    if magic != MAGIC or crc != table.crc:
        raise ValueError("not a block of this table")
    if not points:
        return np.zeros(0, dtype=np.uint16)
    size = 4 + 8 * lanes
    at = _HEAD.size + first * size
    place = int(np.frombuffer(frame, "<u4", 1, at)[0])
    state = np.frombuffer(frame, "<u8", lanes, at + 4).astype(np.uint64)
    stream = np.frombuffer(frame, "<u4", total, _HEAD.size + points * size).astype(np.uint64)
    begin = first * every * lanes
    end = n if last is None else min(n, last * every * lanes)
    out = np.empty(end - begin, dtype=np.uint16)
    mask, bits = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    symbol, freqs, bases = table.symbol, table.freq, table.base
    for step in range(0, end - begin, lanes):
        count = min(lanes, end - begin - step)
        x = state[:count]
        slot = x & mask
        own = symbol[slot]
        out[step : step + count] = own
        x = freqs[own] * (x >> bits) + slot - bases[own]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << np.uint64(32)) | stream[place : place + len(low)]
        place += len(low)
        state[:count] = x
    return out
