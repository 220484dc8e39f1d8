"""The registered queries of the package, each over its whole table, and the SQL they are checked by."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicdrift.llm import decontamination, html_text, lm, near_dedup, oracle, packing, quality_rules, sharding, substring_dedup, target_resampling, token_files, toxicity, url_reputation, whitening
from topicdrift.runtime import new_table_path

#: The installed tokenizer files; other folders can be given to the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.factored(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"), lm.held_out("id", 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = near_dedup.linked(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_reputation.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("clean")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_table_path(spark)
    token_files.write(table(spark, sf_dir, "documents"), folder, WORD_BPE)
    return token_files.read(spark, folder, with_ids=False)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations that a long cannot hold are null; the operator has them as decimals."""
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = target_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: Shards of `op13_sharding`.
SHARDS = 24


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents"), SHARDS)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_near_dedup": op5_near_dedup,
    "op6_url_reputation": op6_url_reputation,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_scores": op8_lm_scores,
    "op9_html_text": op9_html_text,
    "op10_token_files": op10_token_files,
    "op11_whitening": op11_whitening,
    "op12_target_resampling": op12_target_resampling,
    "op13_sharding": op13_sharding,
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op6_url_reputation": oracle.URL_REPUTATION,
    "op7_quality_rules": oracle.QUALITY_RULES,
    "op12_target_resampling": oracle.TARGET_RESAMPLING,
    "op13_sharding": oracle.SHARDING,
}
