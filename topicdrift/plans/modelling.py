"""From a corpus to topic models: the whole corpus, or one model per period."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.cleaning import clean
from ..operators import terms, topics, vectors
from ..operators.corpus import PERIODS, nonempty, with_period
from ..runtime import delete_table, new_table_path, stored
from .text import TokenConfig, token_table

# Settings of the final model over all years.
FINAL_TOPICS = 16
FINAL_ITERATIONS = 100
FINAL_TOKENS = TokenConfig(stop_words=("url", "ref"))

# Settings of the models per period.
PERIOD_TOPICS = 10
PERIOD_ITERATIONS = 50
PERIOD_TOKENS = TokenConfig(stem=True)


@dataclass(frozen=True)
class Fitted:
    """A model with the vocabulary and the vectors it was fitted on, both stored tables."""

    model: topics.TopicModel
    vocabulary: DataFrame
    vectors: DataFrame

    def topic_terms(self, n: int = 10) -> DataFrame:
        return topics.topic_terms(self.model, self.vocabulary, n)

    def topic_distribution(self) -> DataFrame:
        return topics.topic_distribution(self.model, self.vectors)


@dataclass(frozen=True)
class FittedPeriods:
    """Models per period over one vocabulary."""

    models: dict[str, topics.TopicModel]
    vocabulary: DataFrame
    vectors: DataFrame

    def topic_terms(self, n: int = 10) -> DataFrame:
        parts = [
            topics.topic_terms(model, self.vocabulary, n).select(F.lit(period).alias("period"), "*")
            for period, model in self.models.items()
        ]
        united = parts[0]
        for part in parts[1:]:
            united = united.unionByName(part)
        return united

    def topic_distribution(self) -> DataFrame:
        return topics.period_topic_distribution(self.models, self.vectors)


def stored_weights(bag: DataFrame, documents: int, min_df: int, vocabulary_size: int | None) -> DataFrame:
    """Vocabulary of a bag with idf, as a stored table; ``vocabulary_size`` None keeps all terms."""
    statistics = stored(terms.term_statistics(bag))
    return stored(terms.idf(terms.vocabulary(statistics, min_df, size=vocabulary_size), F.lit(documents)))


def weigh_topics(
    corpus: DataFrame,
    keys: Sequence[str],
    *,
    vocabulary_size: int | None,
    cleaning: str = "wiki",
    tokens: TokenConfig = FINAL_TOKENS,
    min_df: int = 1,
    weighting: str = vectors.TFIDF,
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and vectors of the non-empty texts of a corpus, both stored tables: clean, cut, count, weigh.

    Tokens are written once and deleted at the end; executors hold none in memory.
    """
    spark = corpus.sparkSession
    path = new_table_path(spark)
    try:
        table = stored(token_table(clean(nonempty(corpus), cleaning), tokens, keys), path=path)
        bag = terms.bag_of_words(table, keys, keep_empty=True)
        weights = stored_weights(bag, table.count(), min_df, vocabulary_size)
        return weights, vectors.document_vectors(table, weights, keys, weighting)
    finally:
        delete_table(spark, path)


def fit_topics(
    corpus: DataFrame,
    keys: Sequence[str],
    seed: int,
    *,
    vocabulary_size: int | None,
    cleaning: str = "wiki",
    tokens: TokenConfig = FINAL_TOKENS,
    k: int = FINAL_TOPICS,
    max_iter: int = FINAL_ITERATIONS,
    min_df: int = 1,
    weighting: str = vectors.TFIDF,
    subsampling_rate: float = 0.05,
) -> Fitted:
    """Clean, cut, count, weigh and fit one model over the non-empty texts of a corpus."""
    weights, rows = weigh_topics(
        corpus, keys, vocabulary_size=vocabulary_size, cleaning=cleaning, tokens=tokens, min_df=min_df, weighting=weighting
    )
    return Fitted(topics.fit(rows, keys, k, max_iter, seed, subsampling_rate), weights, rows)


def fit_topics_per_period(
    corpus: DataFrame,
    seed: int,
    *,
    vocabulary_size: int | None,
    key: str = "doc_id",
    cleaning: str = "none",
    tokens: TokenConfig = PERIOD_TOKENS,
    periods: Sequence[tuple[int, int, str]] = PERIODS,
    keep_other_years: bool = False,
    k: int = PERIOD_TOPICS,
    max_iter: int = PERIOD_ITERATIONS,
    min_df: int = 1,
    weighting: str = vectors.TFIDF,
    subsampling_rate: float = 0.05,
    parallelism: int = 1,
) -> FittedPeriods:
    """One model per period over documents ``(title, period)`` of a corpus with ``year``.

    A period document is the sum of its revisions' bags; its text is never put together.
    Vocabulary and idf come from all periods. ``keep_other_years`` lets texts outside all
    periods count there, too.
    """
    group = ["title", "period"]
    dated = with_period(nonempty(corpus), periods)
    if not keep_other_years:
        dated = dated.where(F.col("period").isNotNull())
    table = token_table(clean(dated, cleaning), tokens, [key, *group])
    bag = terms.grouped_bag(terms.bag_of_words(table, group, keep_empty=True), group).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        documents = bag.select(*group).distinct().count()
        weights = stored_weights(bag, documents, min_df, vocabulary_size)
        rows = vectors.stored_vectors(bag, weights, group, weighting, partition_by=["period"])
    finally:
        bag.unpersist()
    names = [name for _, _, name in periods]
    models = topics.fit_per_period(rows, ["title"], names, k, max_iter, seed, subsampling_rate, parallelism)
    return FittedPeriods(models, weights, rows)
