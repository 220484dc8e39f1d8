"""Sparse term vectors for the topic model."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from ..runtime import BROADCAST_LIMIT_BYTES, PACKED, broadcast_if_small, delete_table, new_table_path, size_in_bytes, stored

TFIDF = "tfidf"
COUNT = "count"

#: Tokens that a task counts at a time, besides those of one row.
PIECE_TOKENS = 1 << 20

# How a sparse vector is stored.
_FIELDS = "type tinyint, size int, indices array<int>, values array<double>"
_LAYOUT = f"struct<{_FIELDS}>"


def document_vectors(
    tokens: DataFrame, weights: DataFrame, keys: Sequence[str], weighting: str = TFIDF, binary: bool = False,
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """``(keys, features)`` of token lists over a vocabulary ``(term_id, term, idf)``, as a stored table.

    A vocabulary that measures at most ``limit`` bytes is broadcast as a dictionary in the order of ids,
    which tasks have put together; then each row becomes its own vector in one narrow pass, unknown
    terms vanish inside the row, nothing is shuffled. Of a larger one pieces of rows ask for their distinct
    terms (`_asked_vectors`). The driver sees no term. ``keys`` identify a row. Raises if there is no term.
    """
    keys = list(keys)
    if weights.isEmpty():
        raise ValueError("the vocabulary is empty")
    if size_in_bytes(weights.select("term_id", "term", "idf")) > limit:
        return _asked_vectors(tokens, weights, keys, weighting, binary)
    pieces = dictionary(weights).orderBy("first").collect()
    listed = tokens.sparkSession.sparkContext.broadcast([bytes(row["piece"]) for row in pieces])
    fields = [tokens.schema[name] for name in keys]
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in fields) + f", features {_LAYOUT}"

    def count(batches):
        known = pa.concat_tables([pa.ipc.open_stream(piece).read_all() for piece in listed.value]).combine_chunks()
        terms, size = known["term"].combine_chunks(), len(known)
        scale = known["idf"].to_numpy() if weighting == TFIDF else np.ones(size)
        for batch in (piece for whole in batches for piece in _pieces(whole, len(keys))):
            lists = batch.column(len(keys))
            places = pa.compute.index_in(lists.flatten(), value_set=terms)
            there = places.is_valid().to_numpy(zero_copy_only=False)
            pairs, counts = np.unique(_row_numbers(lists)[there] * size + places.drop_null().to_numpy().astype(np.int64), return_counts=True)
            indices = (pairs % size).astype(np.int32)
            values = scale[indices] * (1.0 if binary else counts)
            vector = _vectors(np.searchsorted(pairs // size, np.arange(len(batch) + 1)), indices, values, size)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), vector], [*keys, "features"])

    made = tokens.select(*keys, "tokens").mapInArrow(count, schema)
    return stored(made, T.StructType([*fields, T.StructField("features", VectorUDT())]))


def _row_numbers(lists: pa.Array) -> np.ndarray:
    """Of each element of lists, the list that holds it; nulls are empty."""
    return np.repeat(np.arange(len(lists)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def _vectors(offsets: np.ndarray, indices: np.ndarray, values: np.ndarray, size: int) -> pa.StructArray:
    """Sparse vectors in the order of their entries."""
    rows, offsets = len(offsets) - 1, pa.array(offsets.astype(np.int32))
    return pa.StructArray.from_arrays([
        pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, size, np.int32)),
        pa.ListArray.from_arrays(offsets, pa.array(indices)), pa.ListArray.from_arrays(offsets, pa.array(values, pa.float64())),
    ], ["type", "size", "indices", "values"])


def _asked_vectors(tokens: DataFrame, weights: DataFrame, keys: Sequence[str], weighting: str, binary: bool) -> DataFrame:
    """`document_vectors` over a vocabulary of any size.

    Pieces of rows are written with their terms numbered piece by piece. What is joined with the vocabulary are
    the distinct terms of each piece, not the entries of rows; a piece and its answers make its vectors.
    """
    spark, size = tokens.sparkSession, weights.count()
    fields = [tokens.schema[name] for name in keys]
    path = new_table_path(spark)

    def pack(batches):
        for batch in (piece for whole in batches for piece in _pieces(whole, len(keys))):
            lists = batch.column(len(keys))
            known = lists.flatten().dictionary_encode()
            codes, words = pa.compute.fill_null(known.indices, -1).to_numpy(zero_copy_only=False), known.dictionary
            # A NULL token is no term.
            rows, there = _row_numbers(lists), codes >= 0
            pairs, counts = np.unique(rows[there] * max(1, len(words)) + codes[there], return_counts=True)
            sink = pa.BufferOutputStream()
            kept = pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keys))], names=[f"_{i}" for i in range(len(keys))])
            with pa.ipc.new_stream(sink, kept.schema) as writer:
                writer.write_batch(kept)
            yield pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                pa.array([np.searchsorted(pairs // max(1, len(words)), np.arange(len(batch) + 1)).astype(np.int32).tobytes()], pa.binary()),
                pa.array([(pairs % max(1, len(words))).astype(np.int32).tobytes()], pa.binary()), pa.array([counts.astype(np.int32).tobytes()], pa.binary()),
            ], ["piece", "words", "keys", "offsets", "codes", "counts"])

    def make(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        one = pieces.to_pylist()[0]
        rows = pa.ipc.open_stream(one["keys"]).read_all()
        offsets, codes, counts = (np.frombuffer(one[name], np.int32) for name in ("offsets", "codes", "counts"))
        ids, idf = np.full(one["words"], -1, dtype=np.int32), np.ones(one["words"])
        places = answers["place"].to_numpy()
        ids[places] = answers["term_id"].to_numpy()
        if weighting == TFIDF:
            idf[places] = answers["idf"].to_numpy()
        there = ids[codes] >= 0
        row, codes, counts = np.repeat(np.arange(len(rows)), np.diff(offsets))[there], codes[there], counts[there]
        order = np.lexsort((ids[codes], row))
        row, codes, counts = row[order], codes[order], counts[order]
        made = _vectors(np.searchsorted(row, np.arange(len(rows) + 1)), ids[codes], idf[codes] * (1.0 if binary else counts), size)
        return pa.table([*rows.columns, made], names=[*keys, "features"])

    try:
        packed = stored(
            tokens.select(*keys, "tokens").mapInArrow(pack, "piece string, words array<string>, keys binary, offsets binary, codes binary, counts binary"),
            options=PACKED | {"compression": "zstd"}, path=path,
        )
        listed = broadcast_if_small(weights.select("term", F.col("term_id").cast("int").alias("term_id"), F.col("idf").cast("double").alias("idf")))
        answers = packed.select(F.col("piece").alias("asker"), F.posexplode("words").alias("place", "term")).join(listed, "term").drop("term")
        pieces = packed.withColumn("words", F.size("words"))
        schema = T.StructType([*fields, T.StructField("features", T.StructType.fromDDL(_FIELDS))])
        made = pieces.groupBy("piece").cogroup(answers.groupBy("asker")).applyInArrow(make, schema)
        return stored(made, T.StructType([*fields, T.StructField("features", VectorUDT())]))
    finally:
        delete_table(spark, path)


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch cut between rows, so that a piece has at most `PIECE_TOKENS` elements of a list column, or one more row."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    before = np.cumsum(sizes, dtype=np.int64) - sizes
    starts = np.flatnonzero(np.diff(before // PIECE_TOKENS, prepend=-1)).tolist()
    for first, end in zip(starts, [*starts[1:], len(batch)]):
        yield batch.slice(first, end - first)


def dictionary(weights: DataFrame) -> DataFrame:
    """``(first, piece)``: terms and idf in the order of their ids, in pieces packed by tasks.

    Ids must be 0, 1, 2, ... without gaps.
    """

    def pack(batches):
        for table in batches:
            sink = pa.BufferOutputStream()
            columns = pa.RecordBatch.from_arrays([table.column(1), table.column(2)], ["term", "idf"])
            with pa.ipc.new_stream(sink, columns.schema) as writer:
                writer.write_batch(columns)
            yield pa.RecordBatch.from_arrays([pa.array([table.column(0)[0].as_py()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["first", "piece"])

    numbered = weights.select(F.col("term_id").cast("int"), "term", "idf")
    pieces = numbered.repartitionByRange("term_id").sortWithinPartitions("term_id")
    return pieces.mapInArrow(pack, "first int, piece binary")


def stored_vectors(
    bag: DataFrame, weights: DataFrame, keys: Sequence[str], weighting: str = TFIDF, binary: bool = False,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """``(keys, features)`` of added-up bags over a vocabulary ``(term_id, term, idf)``, as a stored table.

    For bags that are sums over several texts; see `document_vectors` for single ones.
    ``bag`` has one row per keys and term; keys without a known term get a vector of zeros.
    Unknown terms are gone before the exchange, so a row gathers as many entries as the
    vocabulary has at most. Vectors are written in the storage layout of a sparse vector
    and read back, without leaving the JVM.
    """
    keys = list(keys)
    size = weights.count()
    if not size:
        raise ValueError("the vocabulary is empty")
    listed = broadcast_if_small(weights.select("term", "term_id", "idf"))
    count = F.lit(1.0) if binary else F.col("tf").cast("double")
    value = count * F.col("idf") if weighting == TFIDF else count
    known = bag.join(listed, "term").select(*keys, F.struct("term_id", value.alias("value")).alias("_entry"))
    nothing = F.lit(None).cast(known.schema["_entry"].dataType).alias("_entry")
    every = bag.select(*keys).distinct().select(*keys, nothing)
    rows = known.unionByName(every).groupBy(*keys).agg(F.sort_array(F.collect_list("_entry")).alias("_entries"))
    layout = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.col("_entries.term_id").alias("indices"),
        F.col("_entries.value").alias("values"),
    )
    kept = [rows.schema[name] for name in keys]
    return stored(
        rows.select(*keys, layout.alias("features")),
        T.StructType([*kept, T.StructField("features", VectorUDT())]),
        partition_by,
    )


def entries(vectors: DataFrame, keys: Sequence[str], features: str = "features") -> DataFrame:
    """``(keys, size, indices, values)`` of sparse vectors."""
    parts = vectors.select(*keys, F.unwrap_udt(features).alias("_parts"))
    return parts.select(*keys, "_parts.size", "_parts.indices", "_parts.values")
