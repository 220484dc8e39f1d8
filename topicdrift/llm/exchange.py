"""Blocks of documents and a hash-divided index that blocks ask.

A block is a set of documents, a bounded number of rows and bytes on average. Instead
of a row for each key and document, a block sends each distinct key once to the index part
that owns it, in one binary cell for each (block, part). However hot a key is, a part receives
it once from a block, and a block receives one answer.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents and bytes of text of a block, on average; the number of blocks follows the input.
ROWS_PER_BLOCK = 2048
BYTES_PER_BLOCK = 32 << 20


def in_blocks(
    docs: DataFrame, id_col: str, text_col: str, *columns: str, rows_per_block: int = ROWS_PER_BLOCK, bytes_per_block: int = BYTES_PER_BLOCK
) -> tuple[DataFrame, int]:
    """The id, the text, the given columns and `block`; the number of blocks.

    Rows are dealt by id, text and the partition that reads them, so that neither a repeated id, nor null
    ids, nor a repeated row fill a block.
    """
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_col).cast("bigint"))).first()
    blocks = max(1, math.ceil(rows / rows_per_block), math.ceil((size or 0) / bytes_per_block))
    number = F.pmod(F.xxhash64(id_col, text_col, F.spark_partition_id()), F.lit(blocks)).cast("int")
    return docs.select(id_col, text_col, *columns, number.alias("block")), blocks


def where_text(docs: DataFrame, judge: Callable[[pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """Rows for whose text `judge` says true, a batch at a time; same columns, whatever their names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    place = docs.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(place))))

    return plain.mapInArrow(choose, nullable(plain.schema)).toDF(*docs.columns)


def part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted 64-bit keys (parts + 1 positions); a part owns a range of keys."""
    owner = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(owner, np.arange(parts + 1, dtype=np.uint64))


def to_parts(block: int, keys: np.ndarray, parts: int, **payload: np.ndarray) -> pa.Table:
    """A row for each part that owns some of the sorted keys: part, block, keys and the payload's bytes."""
    bounds = part_bounds(keys, parts)
    full = np.flatnonzero(np.diff(bounds))
    cells = {"keys": keys, **payload}
    return pa.table(
        {"part": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32())}
        | {name: pa.array([x[bounds[p] : bounds[p + 1]].tobytes() for p in full], pa.binary()) for name, x in cells.items()}
    )


def cells(column: pa.ChunkedArray, dtype: str) -> list[np.ndarray]:
    """Binary cells as arrays."""
    return [np.frombuffer(x, dtype=dtype) for x in column.to_pylist()]


def joined(parts: list[np.ndarray], dtype: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def nullable(schema: T.StructType) -> T.StructType:
    """The schema with every field and element nullable, as Arrow tables made in a task are."""
    text = json.dumps(json.loads(schema.json()))
    for flag in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{flag}": false', f'"{flag}": true')
    return T.StructType.fromJson(json.loads(text))
