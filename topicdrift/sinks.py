"""Writers of scores, reports and topic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


# How the report names scores, in its order.
SCORE_LABELS = {"log_perplexity": "Perplexity: ", "coherence": "Coherence Score: "}


def topic_lists(terms: DataFrame, group: str) -> DataFrame:
    """``(config, topics)`` from ``(group, topic, rank, term)``: one row per group, for reports."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "term")))
    lists = terms.groupBy(group, "topic").agg(F.transform(ranked, lambda row: row["term"]).alias("_terms"))
    ordered = F.array_sort(F.collect_list(F.struct("topic", "_terms")))
    topics = F.transform(ordered, lambda row: row["_terms"]).alias("topics")
    return lists.groupBy(F.col(group).alias("config")).agg(topics)


def score_table(scores: DataFrame) -> DataFrame:
    """``(Topics, Coherence, Perplexity)`` of a sweep, by number of topics."""
    return scores.select(
        F.col("k").alias("Topics"), F.col("coherence").alias("Coherence"), F.col("log_perplexity").alias("Perplexity")
    ).orderBy("Topics")


def write_scores(scores: DataFrame, path: str) -> None:
    """CSV with a header line."""
    score_table(scores).write.mode("overwrite").option("header", True).csv(path)


def report_lines(scores: DataFrame, header: str = "Preprocessing Variant: ") -> DataFrame:
    """``(config, line, text)``: header, one line per topic, and the scores, per setting.

    ``scores`` needs ``config, topics``; ``log_perplexity`` and ``coherence`` are reported
    if it has them. ``text`` is what a text file holds; order by ``config, line``.
    """
    named = F.transform(
        "topics",
        lambda terms, i: F.concat(F.lit("Topic "), (i + 1).cast("string"), F.lit(": "), F.array_join(terms, ", ")),
    )
    lines = F.concat(
        F.array(F.concat(F.lit(header), "config")),
        named,
        *[
            F.array(F.concat(F.lit(label), F.col(column).cast("string")))
            for column, label in SCORE_LABELS.items()
            if column in scores.columns
        ],
    )
    return scores.select("config", F.posexplode(lines).alias("line", "text"))


def write_report(scores: DataFrame, path: str, header: str = "Preprocessing Variant: ") -> None:
    """Text files that read as one report in the order of their names."""
    report_lines(scores, header).orderBy("config", "line").select("text").write.mode("overwrite").text(path)


def write_distribution(distribution: DataFrame, path: str) -> None:
    """Topic shares per document as parquet."""
    distribution.write.mode("overwrite").parquet(path)
