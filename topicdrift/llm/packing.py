"""Bounded-space online packing of tokenised documents into sequences.

A task reads its partition once and keeps at most `windows` open sequences. The ids of a
document fill whole sequences first; the rest goes to the open sequence with the least space
that still fits it (best fit). If none fits and no further one may be opened, the fullest is
emitted: a gap of at least `least_cut` ids is first filled with the head of the rest, a smaller
one is padded. What is still open at the end of a partition is merged by the same rule, some
partitions at a time, level by level, so that no task ever gets more than `MERGED` partitions'
open sequences. The last level fills every gap; at most one short sequence is left.

Reading, tokenising and packing are one narrow pass; only open sequences are shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicdrift.llm.tokens import encoded
from topicdrift.runtime import stored

LENGTH = 2048
WINDOWS = 64
LEAST_CUT = 64
MERGED = 16

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_ROWS = 4096


class Packer:
    """Open sequences of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, task: int, level: int, length: int, windows: int, least_cut: int):
        self.length, self.windows, self.least_cut = length, windows, least_cut
        self.next_id = (level << 57) | (task << 29)
        self.open: dict[int, list[tuple]] = {}
        self.spaces: list[tuple[int, int]] = []
        self.done: list[tuple] = []

    def _emit(self, sequence: int, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, None))
            offset += len(ids)

    def _new(self, pieces: list[tuple], space: int) -> None:
        self.open[self.next_id] = pieces
        insort(self.spaces, (space, self.next_id))
        self.next_id += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            if len(ids) >= self.length:
                self._emit(self.next_id, [(doc, start, ids[: self.length], total)])
                self.next_id += 1
                start, ids = start + self.length, ids[self.length :]
                continue
            place = bisect_left(self.spaces, (len(ids), -1))
            if place < len(self.spaces):
                space, sequence = self.spaces.pop(place)
                self.open[sequence].append((doc, start, ids, total))
                if space == len(ids):
                    self._emit(sequence, self.open.pop(sequence))
                else:
                    insort(self.spaces, (space - len(ids), sequence))
                return
            if len(self.spaces) < self.windows:
                self._new([(doc, start, ids, total)], self.length - len(ids))
                return
            gap, sequence = self.spaces.pop(0)
            pieces = self.open.pop(sequence)
            if gap >= self.least_cut:
                pieces.append((doc, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            self._emit(sequence, pieces)

    def fill(self) -> None:
        """Closes everything: fullest first, each filled up with ids of the emptiest."""
        pieces = [piece for _, sequence in self.spaces for piece in self.open[sequence]]
        self.open, self.spaces, space, row = {}, [], self.length, []
        for doc, start, ids, total in pieces:
            while len(ids):
                row.append((doc, start, ids[:space], total))
                start, ids, space = start + len(row[-1][2]), ids[space:], space - len(row[-1][2])
                if not space:
                    self._emit(self.next_id, row)
                    self.next_id, row, space = self.next_id + 1, [], self.length
        if row:
            self._emit(self.next_id, row)

    def left(self) -> list[tuple]:
        """Pieces of the open sequences, with their ids."""
        rows = []
        for _, sequence in self.spaces:
            offset = 0
            for doc, start, ids, total in self.open[sequence]:
                rows.append((doc, start, len(ids), 0, total, sequence, offset, ids.astype("<u2").tobytes()))
                offset += len(ids)
        return rows


def _batch(rows: list[tuple], task: int) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 7, pa.binary()]
    names = [field.split()[0] for field in PIECE.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(rows), task), pa.int64())], [*names, "task"])


def packed(
    docs: DataFrame,
    path: str,
    kind: str = "byte",
    end: int = 1,
    length: int = LENGTH,
    windows: int = WINDOWS,
    least_cut: int = LEAST_CUT,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `path` is a tokenizer file, `end` the id put after each document. Every id lies in one piece.
    Null and empty texts are documents of the end id alone; null ids and repeated rows are
    documents of their own. Other columns are ignored. An empty table gives no piece.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer = Packer(task, 0, length, windows, least_cut)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for doc, ids in zip(names, encoded(batch.column(1), path, kind, end), strict=True):
                packer.add(doc, 0, ids, len(ids))
                if len(packer.done) >= _ROWS:
                    yield _batch(packer.done, task)
                    packer.done = []
        yield _batch(packer.done + packer.left(), task)

    schema = PIECE + ", task long"
    found = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, schema))
    columns = [field.split()[0] for field in PIECE.split(", ")][:-1]
    whole = [found.where("ids IS NULL").select(columns)]
    tasks = (found.where("ids IS NOT NULL").agg(F.max("task")).first()[0] or 0) + 1

    def merging(level: int, last: bool):
        def merge(table: pa.Table) -> pa.Table:
            table = table.sort_by([("task", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            task = table["task"][0].as_py() // MERGED
            packer = Packer(task, level, length, windows, least_cut)
            rows = zip(*(table[name].to_pylist() for name in ("doc_id", "start", "ids", "doc_tokens")), strict=True)
            for doc, start, ids, total in rows:
                packer.add(doc, start, np.frombuffer(ids, dtype="<u2"), total)
            if last:
                packer.fill()
            return pa.Table.from_batches([_batch(packer.done + ([] if last else packer.left()), task)])

        return merge

    level = 0
    while level == 0 or tasks > 1:
        level, tasks = level + 1, -(-tasks // MERGED)
        group = F.floor(F.col("task") / MERGED).alias("group")
        found = stored(found.where("ids IS NOT NULL").groupBy(group).applyInArrow(merging(level, tasks == 1), schema))
        whole.append(found.where("ids IS NULL").select(columns))
    result = whole[0]
    for more in whole[1:]:
        result = result.unionByName(more)
    return result
