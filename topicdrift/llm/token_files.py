"""Token ids in compressed files, in ascending order of documents.

Writing: texts are range-partitioned by id and tokenised once into chunks of whole documents;
the ids of all chunks are counted; every chunk becomes an independent block coded with the one
shared frequency table (`rans`). A folder holds `table` (frequency of each id) and `blocks`:
a row for each block with its place, its documents, their lengths and the coded frame. Blocks
can be read in any order and in parallel; each has checkpoints and a checksum. `ids_between` reads a range
of ids from the checkpoint before it, so that a reader of one shard decodes that alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicdrift.llm.rans import CHECKPOINT_STEPS, LANES, Table, decode, encode
from topicdrift.llm.tokens import encoded
from topicdrift.runtime import new_table_path

#: Ids of a block, at least, but for the last of a partition; a document is never cut.
BLOCK_IDS = 1 << 20
VOCABULARY = 1 << 16

CHUNK = "part int, number int, first long, tokens long, docs array<long>, lengths array<int>, ids binary"
BLOCK = CHUNK.replace("ids binary", "frame binary")


def _chunks(batches: Iterator[pa.RecordBatch], path: str, kind: str, end: int) -> Iterator[pa.RecordBatch]:
    part, number, first, docs, parts = TaskContext.get().partitionId(), 0, 0, [], []

    def chunk() -> pa.RecordBatch:
        lengths = [len(x) for x in parts]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first]), pa.array([sum(lengths)], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([np.concatenate(parts).tobytes()], pa.binary()),
            ],
            [field.split()[0] for field in CHUNK.split(", ")],
        )

    held = 0
    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), path, kind, end), strict=True):
            docs.append(doc)
            parts.append(ids)
            held += len(ids)
            if held >= BLOCK_IDS:
                yield chunk()
                number, first, held, docs, parts = number + 1, first + held, 0, [], []
    if docs:
        yield chunk()


def write(docs: DataFrame, folder: str, path: str, kind: str = "word", end: int = 2) -> None:
    """Ids of all documents, each followed by `end`, to `folder`, in ascending order of doc_id.

    Null texts are empty. Null ids come first; repeated ids follow one another, in the order of a
    hash of their texts, and may lie in several partitions. Other columns are ignored. An empty table gives a folder without blocks.
    """
    spark = docs.sparkSession
    scratch = new_table_path(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("read_by"))
    ordered = rows.repartitionByRange("doc_id", "hash", "read_by").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    ordered.mapInArrow(lambda batches: _chunks(batches, path, kind, end), CHUNK).write.option("compression", "zstd").parquet(scratch)
    chunks = spark.read.schema(CHUNK).parquet(scratch)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(ids, "<u2"), minlength=VOCABULARY)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["id", "n"])

    counted = chunks.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted.write.parquet(f"{folder}/table")
    table = spark.sparkContext.broadcast(_table(spark, folder))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = [encode(np.frombuffer(ids, "<u2"), table.value) for ids in batch.column("ids").to_pylist()]
            at = batch.schema.get_field_index("ids")
            yield batch.remove_column(at).append_column("frame", pa.array(frames, pa.binary()))

    chunks.mapInArrow(code, BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")


def _table(spark: SparkSession, folder: str) -> Table:
    """The frequency table: a row for each id of the vocabulary at most."""
    counts = np.zeros(VOCABULARY, dtype=np.int64)
    for number, n in spark.read.schema("id int, n long").parquet(f"{folder}/table").collect():
        counts[number] = n
    return Table(counts)


def _bases(blocks: DataFrame) -> DataFrame:
    """part and base (ids in all parts before it); a row for each partition of the writer."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.groupBy("part").agg(F.sum("tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def ids_between(spark: SparkSession, folder: str, begin: int, end: int) -> DataFrame:
    """Ids at the places begin to end (not included) of all ids of a folder: start, n_tokens, ids (16-bit).

    A row for each block that has some. Only these blocks are decoded, from the last checkpoint before the
    range to the first behind it. Places that do not exist give nothing.
    """
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    table = spark.sparkContext.broadcast(_table(spark, folder))
    span = LANES * CHECKPOINT_STEPS
    placed = blocks.join(_bases(blocks), "part").select((F.col("base") + F.col("first")).alias("at"), "tokens", "frame")
    wanted = placed.where((F.col("at") < end) & (F.col("at") + F.col("tokens") > begin) & (F.lit(begin) < end))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, last = max(0, begin - row["at"]), min(row["tokens"], end - row["at"])
                mark = first // span
                ids = decode(row["frame"], table.value, mark, -(-last // span))[first - mark * span : last - mark * span]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["at"] + first]), pa.array([last - first], pa.int64()), pa.array([ids.tobytes()], pa.binary())], ["start", "n_tokens", "ids"]
                )

    return wanted.mapInArrow(cut, "start long, n_tokens long, ids binary")


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids (16-bit)."""
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    table = spark.sparkContext.broadcast(_table(spark, folder))
    bases = _bases(blocks)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = decode(row["frame"], table.value), np.array(row["lengths"], dtype=np.int64)
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                own = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["docs"], pa.int64()), pa.array(row["first"] + cuts[:-1]), pa.array(lengths),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                        pa.array([x.tobytes() if with_ids else None for x in own], pa.binary()), pa.array(np.full(len(own), row["part"]), pa.int32()),
                    ],
                    ["doc_id", "local", "n_tokens", "ids_crc32", "ids", "part"],
                )

    schema = "doc_id long, local long, n_tokens long, ids_crc32 long, ids binary, part int"
    found = blocks.mapInArrow(documents, schema).join(bases, "part")
    return found.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
