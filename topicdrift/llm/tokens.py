"""Token ids of whole texts by a public tokenizer file, with a table of encoded words.

Both kinds of tokenizer file cut a text before every space or newline that stands between two
other characters, so the ids of a text are the ids of its words one after the other. Each
worker keeps the ids of the words it has met in a table of 64-bit hashes; only new words go
through the tokenizer. Texts whose white space is not that simple go through it whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from topicdrift.llm.words import Words, mix, pieces

#: Places of a worker's table (20 bytes each, ids apart). When half are taken, it starts anew; it
#: grows only where the words of one text, or of a few together, need more.
TABLE_PLACES = 1 << 22

_NONE, _DOT, _COMMA, _END = range(4)
_ODD_BYTE = np.zeros(256, dtype=bool)
_ODD_BYTE[[*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

_encoders: dict[tuple, Encoder] = {}


def _has_odd_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have white space other than one space or newline between two other characters."""
    simple = (data == 0x20) | (data == 0x0A)
    odd = _ODD_BYTE[data]
    odd[1:] |= simple[1:] & simple[:-1]
    full = np.diff(offsets) > 0
    odd[offsets[:-1][full]] |= simple[offsets[:-1][full]]
    odd[offsets[1:][full] - 1] |= simple[offsets[1:][full] - 1]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[np.isin(data[lead], (0xC2, 0xE1, 0xE2, 0xE3))]
    if len(lead):
        # no-break space, next line, ogham space, the spaces of U+2000 to U+205F, ideographic space
        wide = np.r_[data, 0, 0]
        first, second, third = wide[lead], wide[lead + 1], wide[lead + 2]
        spaces = (third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF))
        odd[lead] |= (
            (first == 0xC2) & np.isin(second, (0x85, 0xA0))
            | (first == 0xE1) & (second == 0x9A) & (third == 0x80)
            | (first == 0xE2) & ((second == 0x80) & spaces | (second == 0x81) & (third == 0x9F))
            | (first == 0xE3) & (second == 0x80) & (third == 0x80)
        )
    return np.diff(np.r_[0, np.cumsum(odd)][offsets]) > 0


class Encoder:
    """Ids of texts, each followed by `end`; `kind` is "byte" (white space counts) or "word" (it is dropped)."""

    def __init__(self, path: str, kind: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.kind, self.end = kind, end
        self.places = TABLE_PLACES
        self.fixed = [np.zeros(0, "<u2"), *self.whole([".", ","]), np.array([end], "<u2")]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.places, dtype=np.uint64)
        self.entry = np.zeros(self.places, dtype=np.int32)
        self.pool, self.first, self.size = np.zeros(1 << 16, "<u2"), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.entries = self.used = 0
        self._append(self.fixed)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u2") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _append(self, found: list[np.ndarray]) -> np.ndarray:
        """Numbers of new entries with these ids."""
        sizes, numbers = np.array([len(x) for x in found]), self.entries + np.arange(len(found))
        while self.entries + len(found) > len(self.first):
            self.first, self.size = np.r_[self.first, self.first * 0], np.r_[self.size, self.size * 0]
        while self.used + sizes.sum() > len(self.pool):
            self.pool = np.r_[self.pool, self.pool * 0]
        self.first[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.pool[self.used : self.used + sizes.sum()] = np.concatenate(found)
        self.entries, self.used = self.entries + len(found), self.used + int(sizes.sum())
        return numbers

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key; -1 if it is not in the table."""
        mask = np.uint64(self.places - 1)
        out, rest, at = np.full(len(keys), -1, dtype=np.int32), np.arange(len(keys)), keys & mask
        while len(rest):
            here = self.keys[at]
            hit = here == keys[rest]
            out[rest[hit]] = self.entry[at[hit]]
            go = ~hit & (here != 0)
            rest, at = rest[go], (at[go] + np.uint64(1)) & mask
        return out

    def _insert(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask, at = np.uint64(self.places - 1), keys & np.uint64(self.places - 1)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.entry[at[won]] = entries[won]
            rest = np.ones(len(keys), dtype=bool)
            rest[won] = False
            keys, entries, at = keys[rest], entries[rest], (at[rest] + np.uint64(1)) & mask

    def _entries(self, words: Words, end: np.ndarray, form: np.ndarray) -> np.ndarray:
        """Entry of each word; a word's form says what stands before it: 0 a space, 1 a newline, 2 nothing."""
        keys = mix(words.range_hash(words.start, end) + form.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys[keys == 0] = 1
        found = self._find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            where = missing[where]
            if self.entries + len(new) > self.places // 2:
                while len(new) + len(self.fixed) > self.places // 2 or self.entries == len(self.fixed):
                    self.places, self.entries = 2 * self.places, 0
                self._clear()
                return self._entries(words, end, form)
            data, before = words.data.tobytes(), (" ", "\n", "")
            texts = [before[f] + data[a:b].decode() for a, b, f in zip(words.start[where].tolist(), end[where].tolist(), form[where].tolist(), strict=True)]
            self._insert(new, self._append(self.whole(texts)))
            found[missing] = self._find(keys[missing])
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each text of a piece and the id `end`."""
        texts = len(offsets) - 1
        words = Words(data, offsets, lower=self.kind == "word")
        if self.kind == "word":
            odd, form = np.zeros(texts, dtype=bool), np.full(len(words), 2)
        else:
            odd = _has_odd_space(data, offsets)
            form = (data[words.start - 1] == 0x0A).astype(np.int64) if len(words) else np.zeros(0, np.int64)
            form[words.first[:-1][words.per_doc > 0]] = 2
        last = words.data[words.end - 1]
        single = (words.end - words.start > 1) & _LETTER[words.data[words.end - 2]]
        stop = np.where(single & (last == 0x2E), _DOT, np.where(single & (last == 0x2C), _COMMA, _NONE))
        entry = np.full((len(words), 2), _NONE, dtype=np.int64)
        plain = ~odd[words.doc]
        if plain.all():
            entry[:, 0] = self._entries(words, words.end - (stop > 0), form)
        else:
            own = words.only(plain)
            entry[plain, 0] = self._entries(own, own.end - (stop[plain] > 0), form[plain])
        entry[:, 1] = stop
        entry[~plain] = _NONE
        # the two entries of each word, and one for the end of each text
        order = np.full(2 * len(words) + texts, _END)
        place = 2 * np.arange(len(words)) + words.doc
        order[place], order[place + 1] = entry[:, 0], entry[:, 1]
        size, first = self.size[order], self.first[order]
        after = np.cumsum(size)
        flat = self.pool[np.repeat(first - after + size, size) + np.arange(after[-1] if len(after) else 0)]
        bounds = np.r_[0, after[2 * words.first[1:] + np.arange(texts)]]
        for i in range(texts):
            if odd[i]:
                yield np.r_[self.whole([data[offsets[i] : offsets[i + 1]].tobytes().decode()])[0], self.fixed[_END]]
            else:
                yield flat[bounds[i] : bounds[i + 1]]


def encoded(texts: pa.Array, path: str, kind: str, end: int) -> Iterator[np.ndarray]:
    """For each text its ids (unsigned 16 bits, little-endian) and the id `end`; null texts are empty."""
    if (path, kind, end) not in _encoders:
        _encoders[path, kind, end] = Encoder(path, kind, end)
    for _, data, offsets in pieces(texts):
        yield from _encoders[path, kind, end].encode(data, offsets)
