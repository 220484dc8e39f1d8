"""Documents to training sequences: five stages over the whole table, each a written table.

    toxicity              documents that the classifier rejects go
    near_duplicates       the smallest document of each group stays
    repeated_passages     spans of 13 or more words of a smaller document are cut out
    decontamination       documents that hold a benchmark item go
    packing               pieces of token sequences

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicdrift.llm import decontamination, near_dedup, packing, substring_dedup, toxicity
from topicdrift.llm.queries import BYTE_BPE, table
from topicdrift.runtime import stored


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, BYTE_BPE)


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", without_benchmark),
    ("packing", sequences),
]

#: Classifier, signatures and tokenizer have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
