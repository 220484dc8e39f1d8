"""Benchmark decontamination by canonical templates.

Words become template tokens: numbers (digits, number words, digits with up to three letters after
them, as in 5kg), units and names (capitalised words) become typed placeholders, other words lose
case and punctuation at their edges. A capital at the start of a sentence can be a name or not, so
there are two readings of each text. Windows of `WINDOW` template tokens, half of them or more
literal ones, are hashed and joined with the windows of the benchmark in the same reading; a
shorter item is one window, and one of fewer than `LEAST_TEMPLATE` words must be cited word for word.

Windows of the words themselves, without case and edges, are hashed and joined too: they find
what was cited word for word, however names stand in it.

Windows of one document and one item with the same distance between their places form one
alignment. Its placeholders give pairs of values (the item's, the document's). The alignment
counts only if the pairs are consistent: each value of the item stands for one value of the
document and the other way round. So an item with other numbers or names is found, and a text
that shares nothing but a pattern is not.

The benchmark is the build side of the join. It is broadcast in shards of at most
`SHARD_BYTES`, one pass over the documents each; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicdrift.llm.exchange import where_text
from topicdrift.llm.words import Words, member, mix, pieces, window_hashes

WINDOW = 13
LEAST_TEMPLATE = 8
#: Text of a shard of the benchmark.
SHARD_BYTES = 16 << 20

# Number words and units.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen"
)
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre "
    "kilometres centimeter centimeters mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l "
    "liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years percent % $ € £ dollar dollars cent cents euro euros mph kmh w kw v hz khz mhz kb mb gb tb degrees"
)
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0xA5A5A5A5A5A5A501, 0xA5A5A5A5A5A5A502, 0xA5A5A5A5A5A5A503))

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in "+-.,:/%$"]] = True
_EDGE = np.zeros(256, dtype=bool)
_EDGE[[ord(c) for c in ".,!?;:\"'()[]{}"]] = True
_CLOSES = np.zeros(256, dtype=bool)
_CLOSES[[ord(c) for c in ".!?:"]] = True

# Capitals of two bytes of all scripts, by their first and second byte, and the bytes of the small letter.
_CAPITAL = np.zeros((256, 256), dtype=bool)
_SMALL = np.zeros((256, 256, 2), dtype=np.uint8)
for _letter in map(chr, range(0x80, 0x800)):
    if _letter.isupper() and len(_letter.lower().encode()) == 2:
        _CAPITAL[tuple(_letter.encode())] = True
        _SMALL[tuple(_letter.encode())] = list(_letter.lower().encode())


def _hashes(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), dtype=np.uint8)
    return np.sort(Words(data, np.array([0, len(data)])).hash)


_NUMBER_WORDS, _UNIT_WORDS = _hashes(NUMBERS), _hashes(UNITS)


PLAIN = 2


@dataclass
class Templates:
    """Template tokens of a run of texts in two readings; `value` is the hash of each word without case and edges.

    `inner` takes capitals inside a sentence as names, `token` all of them; a placeholder's token is not its value.
    """

    words: Words
    token: np.ndarray
    inner: np.ndarray
    value: np.ndarray

    def windows(self, token: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of the windows of `size` tokens, half of them literal."""
        if size < LEAST_TEMPLATE:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        hashes = window_hashes(token, size, salt)
        total = np.r_[0, np.cumsum(token == self.value)]
        at = np.flatnonzero(self.words.inside(size))
        at = at[2 * (total[at + size] - total[at]) >= size]
        return at, hashes[at]

    def plain(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of the windows of `size` words as they are, without case and edges."""
        at = np.flatnonzero(self.words.inside(size))
        return at, window_hashes(self.value, size, 2)[at]

    def views(self, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(view, places, hashes): both readings, and the words as they are (`PLAIN`)."""
        yield 0, *self.windows(self.inner, size, 1)
        yield 1, *self.windows(self.token, size, 1)
        yield PLAIN, *self.plain(size)


def templates(data: np.ndarray, offsets: np.ndarray) -> Templates:
    wide = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] < 0xE0))
    wide = wide[_CAPITAL[data[wide], data[wide + 1]]]
    lowered = data.copy()
    small = _SMALL[data[wide], data[wide + 1]]
    lowered[wide], lowered[wide + 1] = small[:, 0], small[:, 1]
    words = Words(lowered, offsets, lower=True)
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        start = start + (_EDGE[data[start]] & (end - start > 1))
        end = end - (_EDGE[data[end - 1]] & (end - start > 1))
    value = mix(words.range_hash(start, end))
    digits, numeric = (np.r_[0, np.cumsum(x[data])] for x in (_DIGIT, _NUMERIC))
    more = end - start - (numeric[end] - numeric[start])
    first = data[start]
    number = (digits[end] > digits[start]) & ((more == 0) | _DIGIT[first] & (more <= 3)) | member(value, _NUMBER_WORDS)
    unit = member(value, _UNIT_WORDS)
    capital = (first >= 65) & (first <= 90) | _CAPITAL[first, np.r_[data, 0][start + 1]]
    opens = np.ones(len(words), dtype=bool)
    if len(words):
        opens[1:] = (words.doc[1:] != words.doc[:-1]) | _CLOSES[data[words.end[:-1] - 1]]
    name = capital & ~number & ~unit
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    return Templates(words, token, np.where(name & opens, value, token), value)


@dataclass
class Shard:
    """Benchmark windows sorted by hash, with their item, place, size and view; template tokens of the items."""

    sizes: list[int]
    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray
    size: np.ndarray
    view: np.ndarray
    value: np.ndarray
    token: np.ndarray
    ids: list


def shard(items: list[tuple], window: int = WINDOW) -> Shard:
    """Index of items (item_id, text)."""
    text = pa.array([text or "" for _, text in items], pa.string())
    rows, value, token, total = [], [], [], 0
    for begin, data, offsets in pieces(text):
        found = templates(data, offsets)
        words = found.words
        value.append(found.value)
        token.append(found.token)
        for size in sorted({window, *words.per_doc[(words.per_doc < window) & (words.per_doc > 0)].tolist()}):
            for view, at, hashes in found.views(size):
                own = words.per_doc[words.doc[at]] >= window if size == window else words.per_doc[words.doc[at]] == size
                at, hashes = at[own], hashes[own]
                rows.append((hashes, begin + words.doc[at], at + total, np.full(len(at), size), np.full(len(at), view)))
        total += len(words)
    columns = [np.concatenate([row[i] for row in rows]) if rows else np.zeros(0, dtype=np.int64) for i in range(5)]
    order = np.argsort(columns[0], kind="stable")
    columns = [x[order] for x in columns]
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return Shard(sorted(set(columns[3].tolist())), *columns, join(value), join(token), [item for item, _ in items])


def _consistent(ours: np.ndarray, theirs: np.ndarray) -> bool:
    """Whether equal values on one side always stand against equal values on the other."""
    pairs = set(zip(ours.tolist(), theirs.tolist(), strict=True))
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def matches(found: Templates, index: Shard) -> Iterator[tuple[int, int, int, int, bool]]:
    """(text, item, first word, words, same values) of every consistent alignment."""
    hits = []
    for size in index.sizes:
        for view, at, hashes in found.views(size):
            known = member(hashes, index.hash)
            at, hashes = at[known], hashes[known]
            low, high = np.searchsorted(index.hash, hashes, "left"), np.searchsorted(index.hash, hashes, "right")
            many = high - low
            entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            ours = np.repeat(at, many)
            right = (index.size[entry] == size) & (index.view[entry] == view)
            hits.append((ours[right], entry[right]))
    ours, entry = (np.concatenate([hit[i] for hit in hits]) if hits else np.zeros(0, dtype=np.int64) for i in range(2))
    text, item, away = found.words.doc[ours], index.item[entry], index.place[entry] - ours
    order = np.lexsort((ours, away, item, text))
    ours, entry, text, item, away = ours[order], entry[order], text[order], item[order], away[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (away[1:] != away[:-1])] if len(ours) else np.zeros(0, dtype=bool)
    starts = np.flatnonzero(new)
    for a, b in zip(starts, np.r_[starts, len(ours)][1:], strict=True):
        cited = index.view[entry[a:b]] == PLAIN
        places = np.unique(np.concatenate([x + np.arange(n) for x, n in zip(ours[a:b].tolist(), index.size[entry[a:b]].tolist(), strict=True)]))
        slots = places[found.token[places] != found.value[places]]
        own, other = found.value[slots], index.value[slots + away[a]]
        kind = found.token[slots]
        if cited.any() or _consistent(own ^ kind, other ^ kind):
            yield int(text[a]), int(item[a]), int(places[0] - found.words.first[text[a]]), len(places), bool((found.value[places] == index.value[places + away[a]]).all())


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Documents and the benchmark items they hold: doc_id, item_id, first_word, n_words, same_values.

    A row for each consistent alignment; same_values is false where numbers, names or units were
    replaced. Items with fewer than `window` words must occur whole; items without words, null
    texts and null item ids match nothing. Null texts of documents have no words; null doc_ids
    stay null. Repeated rows match each. Empty tables give none. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = {"doc_id": pa.int64(), "item_id": pa.int64(), "first_word": pa.int64(), "n_words": pa.int64(), "same_values": pa.bool_()}

    def against(index) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, own = batch.column("doc_id").to_pylist(), index.value.ids
                result = [(ids[text], own[item], *more) for text, item, *more in _found(batch.column("text"), index.value)]
                columns = list(zip(*result, strict=True)) if result else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds.values(), strict=True)], list(kinds))

        return rows.mapInArrow(find, "doc_id long, item_id long, first_word long, n_words long, same_values boolean")

    out = [against(index) for index in _shards(benchmark, window, shard_bytes)]
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def _found(texts: pa.Array, index: Shard) -> Iterator[tuple[int, int, int, int, bool]]:
    for first, data, offsets in pieces(texts):
        for text, *more in matches(templates(data, offsets), index):
            yield first + text, *more


def _shards(benchmark: DataFrame, window: int, shard_bytes: int) -> Iterator:
    """Broadcast indexes of the benchmark, one at a time, in order of items; at least one."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    held, size, done = [], 0, 0
    for item, text in items.orderBy("item_id", "text").toLocalIterator():
        held.append((item, text))
        size += len(text) + 64
        if size >= shard_bytes:
            yield context.broadcast(shard(held, window))
            held, size, done = [], 0, done + 1
    if held or not done:
        yield context.broadcast(shard(held, window))


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Rows that hold no benchmark item; same columns. Every row is judged by its own text."""

    def without(rows: DataFrame, index) -> DataFrame:
        def judge(texts: pa.Array) -> np.ndarray:
            keep = np.ones(len(texts), dtype=bool)
            keep[[text for text, *_ in _found(texts, index.value)]] = False
            return keep

        return where_text(rows, judge)

    for index in _shards(benchmark, window, shard_bytes):
        docs = without(docs, index)
    return docs
