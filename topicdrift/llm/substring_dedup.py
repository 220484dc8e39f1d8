"""Substring dedup by relative Lempel-Ziv parsing against an index of all reference blocks.

A document is parsed into factors, copies of text in documents with smaller ids, and words between
them. The reference is indexed by blocks in two steps, so that only text which occurs again costs
anything:

1. Anchors. Each window of `window` words has the least of its 5-gram hashes as its anchor;
   equal windows have equal anchors. Blocks send their distinct anchors to the index, which
   answers with a bit: does the anchor occur in two documents?
2. Windows. Blocks send the fingerprints (96 bits) of windows with such an anchor, with the least
   document of the block that has them and the word where they start there. The index answers with the
   least document of all and that word: the window's place in the reference.

The parse goes from left to right. Where a window has a place, the factor is extended as long as the
next window's place is the next word of the same source; the parse goes on behind the factor's end.
Then factor boundaries are checked: windows with a place that lie across the end of a factor become
factors of their own, which overlap it, so nothing hides at a boundary. All factors have `window` words
or more; their words are the duplicate spans. The index knows one place for a window, that in the
smallest document, so a factor also ends where the text goes on in a still smaller one.

Each key crosses the network once for each block that has it: a passage in a third of all rows
costs as much as any other. Texts are shuffled once, by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicdrift.llm.exchange import ROWS_PER_BLOCK, cells, in_blocks, joined, nullable, part_bounds, to_parts
from topicdrift.llm.words import Words, anchors, member, pieces

#: Words of a window; the shortest duplicate span.
WINDOW = 13
GRAM = 5
_NO_ID = np.iinfo(np.int64).max

RESULT = (
    "id long, n_words long, n_removed long, kept string, "
    "factors array<struct<first: long, words: long, source: long, source_first: long, boundary: boolean>>"
)


def _ids(table: pa.Table) -> np.ndarray:
    return table["id"].fill_null(_NO_ID).to_numpy()


def _runs(values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the least id that has each, whether several ids have it."""
    order = np.lexsort((ids, values))
    values, ids = values[order], ids[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=np.int64)
    ends = np.r_[starts[1:], len(values)] - 1 if len(values) else starts
    return values[starts], ids[starts], ids[starts] != ids[ends]


def _block_anchors(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a block; whether several documents of the block have them."""
    ids, values, owners = _ids(table), [], []
    for first, data, offsets in pieces(table["text"]):
        words = Words(data, offsets)
        value, inside = anchors(words, window, min(GRAM, window)), words.inside(window)
        value, owner = value[inside], ids[first + words.doc[: len(inside)][inside]]
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else inside[:0]
        values.append(value[new])
        owners.append(owner[new])
    value, _, several = _runs(joined(values, "u8"), joined(owners, "i8"))
    return value, several


def _windows(table: pa.Table, window: int, shared: np.ndarray):
    """For each piece: its first row, words, start of each candidate window and the two fingerprints."""
    for first, data, offsets in pieces(table["text"]):
        words = Words(data, offsets)
        inside = words.inside(window)
        at = np.flatnonzero(inside)
        at = at[member(anchors(words, window, min(GRAM, window))[at], shared)] if len(at) else at
        yield first, words, at, words.windows(window, 1)[at], (words.windows(window, 2)[at] >> np.uint64(32)).astype("u4")


def _copies(at: np.ndarray, source: np.ndarray, place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of windows that are copied from one run of a source."""
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    follows = (at[1:] == at[:-1] + 1) & (place[1:] == place[:-1] + 1) & (source[1:] == source[:-1]) & (doc[1:] == doc[:-1])
    starts = np.flatnonzero(np.r_[True, ~follows])
    return starts, np.r_[starts[1:], len(at)] - 1


def parse(
    at: np.ndarray, source: np.ndarray, place: np.ndarray, doc: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors of texts one after the other: first word, words, source, its first word, found at a boundary.

    Given are the windows with a place, in order: their first word, the place (source and word) and the text.
    """
    starts, ends = _copies(at, source, place, doc)
    chosen, skipped, done = [], [], -1
    for run, (low, high) in enumerate(zip(at[starts].tolist(), at[ends].tolist(), strict=True)):
        if high >= done:
            chosen.append(run)
            skipped.append(max(0, done - low))
            done = high + window
    chosen, skipped = np.array(chosen, dtype=np.int64), np.array(skipped, dtype=np.int64)
    begin, last = starts[chosen] + skipped, ends[chosen]
    first, words = at[begin], at[last] - at[begin] + window
    # Windows across a boundary: those that no factor holds.
    holder = np.searchsorted(first, at, "right") - 1
    across = np.flatnonzero(at + window > (first + words)[holder]) if len(at) else begin
    low, high = _copies(at[across], source[across], place[across], doc[across])
    low, high = across[low], across[high]
    every = np.r_[begin, low]
    order = np.argsort(at[every], kind="stable")
    every, until, boundary = every[order], np.r_[last, high][order], np.r_[np.zeros(len(begin), dtype=bool), np.ones(len(low), dtype=bool)][order]
    return at[every], at[until] - at[every] + window, source[every], place[every], boundary


def _kept_text(words: Words, removed: np.ndarray, layout: str) -> pa.Array:
    """Texts without the removed words: words joined by one space, or the original white space kept."""
    kept, texts = ~removed, len(words.offsets) - 1
    size = len(words.data)
    steps = np.zeros(size + 2, dtype=np.int32)
    data = words.data
    if layout == "words":
        index = np.flatnonzero(kept)
        followed = np.r_[words.doc[index][1:] == words.doc[index][:-1], False] if len(index) else kept[:0]
        end = words.end[index]
        np.add.at(steps, words.start[index], 1)
        np.add.at(steps, end + followed, -1)
        data = data.copy()
        data[end[followed]] = 0x20
    else:
        steps[0] = 1
        gone = np.flatnonzero(removed)
        until = np.r_[words.start, size][gone + 1]
        until = np.minimum(until, words.offsets[1:][words.doc[gone]])
        np.add.at(steps, words.start[gone], -1)
        np.add.at(steps, until, 1)
    mask = np.cumsum(steps[:size]) > 0
    where = np.r_[0, np.cumsum(mask)][words.offsets].astype("i4")
    return pa.StringArray.from_buffers(texts, pa.py_buffer(where.tobytes()), pa.py_buffer(data[mask].tobytes()))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def factored(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    layout: str = "words",
    carry: tuple[str, ...] = (),
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Documents without the spans of `window` or more words that a document with a smaller id has too.

    Result: id, n_words, n_removed, kept (the text left), factors (first word, words, source id, the first
    word there, whether it was found at the boundary of another; in order of their first words) and carried: a struct of `no_text` (the text is null) and `columns`, a struct of those named in `carry`.
    Windows are judged on the input, not on what is left. layout "words" joins the kept words by
    one space; "original" cuts spans out and leaves the rest as it is.

    The words removed are those of the factors. Where rows share an id, a factor's source is that id, and its
    place can be in either row's text.

    Null text: no words, kept is empty. Empty and short texts: nothing removed. Rows that share an
    id never match each other. Null ids are larger than any id and match no other null id; their
    id stays null. Other columns are ignored, whatever their names. An empty table gives none.
    """
    columns = [F.struct(*[F.col(_quoted(name)) for name in carry]).alias("columns")] if carry else []
    row = F.struct(F.col(text_col).isNull().alias("no_text"), *columns)
    kind = nullable(docs.select(row.alias("carried")).schema)["carried"].dataType
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row.cast(kind).alias("carried"))
    blocked, blocks = in_blocks(narrow, "id", "text", "carried", rows_per_block=rows_per_block)
    result = T.StructType.fromDDL(RESULT).add("carried", kind)

    def announce(table: pa.Table) -> pa.Table:
        keys, several = _block_anchors(table, window)
        return to_parts(table["block"][0].as_py(), keys, blocks, several=several.astype("u1"))

    def in_two(table: pa.Table) -> pa.Table:
        asked, flags = cells(table["keys"], "u8"), joined(cells(table["several"], "u1"), "u1")
        _, which, times = np.unique(joined(asked, "u8"), return_inverse=True, return_counts=True)
        shared = ((times > 1) | (np.bincount(which, weights=flags, minlength=len(times)) > 0))[which]
        bounds = np.cumsum([0, *map(len, asked)])
        bits = [np.packbits(shared[a:b]).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        return pa.table({"part": table["part"], "block": table["block"], "bits": pa.array(bits, pa.binary())})

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return to_parts(0, np.zeros(0, "u8"), blocks, check=np.zeros(0, "u4"), least=np.zeros(0, "i8"), place=np.zeros(0, "u4"), several=np.zeros(0, "u1"))
        keys, _ = _block_anchors(table, window)
        bounds, shared = part_bounds(keys, blocks), np.zeros(len(keys), dtype=bool)
        for part, bits in zip(answers["part"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            a, b = bounds[part], bounds[part + 1]
            shared[a:b] = np.unpackbits(np.frombuffer(bits, "u1"), count=b - a)
        ids, found = _ids(table), []
        for first, words, at, key, check in _windows(table, window, keys[shared]):
            doc = words.doc[at]
            found.append((key, check, ids[first + doc], (at - words.first[doc]).astype("u4")))
        key, check, owner, place = (joined([x[i] for x in found], t) for i, t in enumerate(("u8", "u4", "i8", "u4")))
        order = np.lexsort((place, owner, check, key))
        key, check, owner, place = key[order], check[order], owner[order], place[order]
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])]) if len(key) else np.zeros(0, "i8")
        ends = np.r_[starts[1:], len(key)].astype("i8") - 1 if len(key) else starts
        return to_parts(
            table["block"][0].as_py(), key[starts], blocks,
            check=check[starts], least=owner[starts], place=place[starts], several=(owner[starts] != owner[ends]).astype("u1"),
        )

    def least_of_all(table: pa.Table) -> pa.Table:
        asked = cells(table["keys"], "u8")
        key, check = joined(asked, "u8"), joined(cells(table["check"], "u4"), "u4")
        least, several = joined(cells(table["least"], "i8"), "i8"), joined(cells(table["several"], "u1"), "u1") > 0
        place = joined(cells(table["place"], "u4"), "u4")
        order = np.lexsort((place, least, check, key))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])] if len(key) else several
        group = np.cumsum(new) - 1
        smallest = np.empty(len(key), "i8")
        smallest[order] = order[np.flatnonzero(new)][group]
        first, place = least[smallest], place[smallest]
        hit = (first < least) | several
        bounds, rows = np.cumsum([0, *map(len, asked)]), []
        for block, a, b in zip(table["block"].to_pylist(), bounds, bounds[1:], strict=False):
            if hit[a:b].any():
                rows.append((block, *(x[a:b][hit[a:b]].tobytes() for x in (key, first, place))))
        binary = {name: pa.array([r[i] for r in rows], pa.binary()) for i, name in enumerate(("keys", "least", "place"), 1)}
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32())} | binary)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        key, least, place = (joined(cells(answers[name], t), t) for name, t in (("keys", "u8"), ("least", "i8"), ("place", "u4")))
        order = np.lexsort((place, least, key))
        key, least, place = key[order], least[order], place[order].astype("i8")
        ids, out = _ids(table), []
        for first, data, offsets in pieces(table["text"]):
            words = Words(data, offsets)
            at = np.flatnonzero(words.inside(window))
            if len(key) and len(at):
                mine = words.windows(window, 1)[at]
                answer = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                match = (key[answer] == mine) & (least[answer] < ids[first + words.doc[at]])
                at, answer = at[match], answer[match]
            else:
                at, answer = at[:0], at[:0]
            begin, length, source, there, boundary = parse(at, least[answer], place[answer], words.doc[at], window)
            steps = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(steps, begin, 1)
            np.add.at(steps, begin + length, -1)
            removed = np.cumsum(steps[:-1]) > 0
            texts = len(offsets) - 1
            doc = words.doc[begin]
            factors = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, np.arange(texts + 1)), pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array(x) for x in (begin - words.first[doc], length, source, there, boundary)],
                    ["first", "words", "source", "source_first", "boundary"],
                ),
            )
            out.append(pa.table({
                "id": table["id"].combine_chunks().slice(first, texts),
                "n_words": pa.array(words.per_doc),
                "n_removed": pa.array(np.bincount(words.doc[removed], minlength=texts)),
                "kept": _kept_text(words, removed, layout),
                "factors": factors,
                "carried": table["carried"].combine_chunks().slice(first, texts),
            }))
        return pa.concat_tables(out)

    by_block = blocked.groupBy("block")
    asked = by_block.applyInArrow(announce, "part int, block int, keys binary, several binary")
    shared = asked.groupBy("part").applyInArrow(in_two, "part int, block int, bits binary")
    windows = by_block.cogroup(shared.groupBy("block")).applyInArrow(ask, "part int, block int, keys binary, check binary, least binary, place binary, several binary")
    first = windows.groupBy("part").applyInArrow(least_of_all, "block int, keys binary, least binary, place binary")
    return by_block.cogroup(first.groupBy("block")).applyInArrow(cut, result)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with duplicate spans cut out, same columns; n_chars follows the text.

    A document left without any word, although it had some, goes: smaller documents hold all of it.
    """
    others = tuple(name for name in docs.columns if name not in ("doc_id", "text"))
    found = factored(docs, window=window, layout="original", carry=others)
    values = {"doc_id": F.col("id"), "text": F.when(~F.col("carried.no_text"), F.col("kept"))}
    values |= {name: F.col(f"carried.columns.{_quoted(name)}") for name in others}
    if "n_chars" in values:
        values["n_chars"] = F.when(F.col("n_removed") == 0, values["n_chars"]).otherwise(F.length("kept"))
    left = found.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.select(*[values[name].cast(kind).alias(name) for name, kind in docs.dtypes])
