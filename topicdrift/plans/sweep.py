"""Experiment tables: one model per setting, scored on one scale."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..functions.cleaning import clean
from ..operators import coherence, terms, topics, vectors
from ..operators.corpus import nonempty
from ..functions.tokens import SHRINK
from ..runtime import intermediate_tables, side_by_side, stored
from .text import TokenConfig, form_of, form_table, plain_form, tokens_of_form

SCORES = (
    "config string, k int, min_df int, documents bigint, vocabulary bigint, "
    "log_perplexity double, coherence double, topics array<array<string>>"
)


@dataclass(frozen=True)
class Trial:
    """One setting."""

    config: str
    cleaning: str = "wiki"
    tokens: TokenConfig = field(default_factory=TokenConfig)
    min_df: int = 1
    k: int = 5
    max_iter: int = 30


# The settings of the five experiments, in their order.
CLEANING_TRIALS = (
    Trial("No Preprocessing", "none"),
    Trial("Variant 1", "entities"),
    Trial("Variant 2", "refs"),
    Trial("Variant 3", "templates"),
    Trial("Variant 4", "urls"),
    Trial("Variant 5", "comments"),
    Trial("Variant 6", "files"),
    Trial("Must haves", "must_haves"),
    Trial("Must haves and Files", "must_and_files"),
    Trial("Preprocess All", "all"),
)
OWN_STOP_WORDS = ("url", "ref", "date", "accessed")
TOKEN_TRIALS = (
    Trial("plain", tokens=TokenConfig(stop_words=OWN_STOP_WORDS), min_df=10),
    Trial("stem", tokens=TokenConfig(stop_words=OWN_STOP_WORDS, stem=True), min_df=10),
    Trial("stem, 2-grams", tokens=TokenConfig(stop_words=OWN_STOP_WORDS, stem=True, ngrams=(2,)), min_df=10),
)
NGRAM_TRIALS = (
    Trial("1+2", tokens=TokenConfig(stop_words=OWN_STOP_WORDS, ngrams=(1, 2), distinct=True)),
    Trial("1+2, cased", tokens=TokenConfig(stop_words=OWN_STOP_WORDS, ngrams=(1, 2), distinct=True, lowercase=False)),
    Trial("1+2, blanks kept", tokens=TokenConfig(stop_words=OWN_STOP_WORDS, ngrams=(1, 2), distinct=True, cleanup="disabled")),
    Trial("2", tokens=TokenConfig(stop_words=OWN_STOP_WORDS, ngrams=(2,))),
    Trial("1+2+3", tokens=TokenConfig(stop_words=OWN_STOP_WORDS, ngrams=(1, 2, 3), distinct=True)),
    Trial("2, cased", tokens=TokenConfig(stop_words=OWN_STOP_WORDS, ngrams=(2,), lowercase=False)),
)
TUNING_TOKENS = TokenConfig(stop_words=("url", "ref", "date"), stem=True)
MIN_DF_TRIALS = tuple(
    Trial(f"minDF={least}", tokens=TUNING_TOKENS, min_df=least) for least in (3, 6, 11, 15, 21)
)
TOPIC_TRIALS = tuple(
    Trial(f"k={k}", tokens=TUNING_TOKENS, min_df=5, k=k, max_iter=50) for k in (5, 7, 10, 13, 16, 20, 30, 50)
)


def sweep(
    corpus: DataFrame,
    trials: Sequence[Trial],
    key: str,
    seed: int,
    *,
    vocabulary_size: int | None,
    terms_per_topic: int = 10,
    window: int = coherence.WINDOW,
    subsampling_rate: float = 0.05,
    parallelism: int = 1,
    results: str | None = None,
) -> DataFrame:
    """One row per trial; see ``SCORES``.

    Texts are cleaned and cut once for all trials that differ in case, stems and n-grams only, and
    one pass and one shuffle count the n-grams of all of them (`terms.ngram_statistics`). Vectors
    are built once per vocabulary, and topics of trials with the same tokens are scored together in
    one pass over these. Trials that differ in nothing but the clean-up of blanks, which tokens do not
    show, share a fit. Only scores and topic terms reach the driver. ``parallelism`` cleanings, or
    fits of a single one, are under way at a time; words are a written table, n-grams are made when they are read.
    Tables of a cleaning, a vocabulary and a fit are deleted when it is done.

    ``results`` names a folder that keeps the row of each trial, written as soon as its model is
    scored (each model then has a pass over the tokens of its own). A sweep that was stopped
    goes on where it was: trials found there, with the same settings and seed, are not run
    again. A folder belongs to one corpus; `stored_results` reads it.
    """
    spark = corpus.sparkSession
    settings = (key, seed, terms_per_topic, window, vocabulary_size, subsampling_rate)
    places = {trial: f"{results.rstrip('/')}/{_digest(trial, settings)}" for trial in trials} if results else {}
    rows = {trial: tuple(row) for trial, place in places.items() if (row := _found(spark, place))}
    runs: dict[tuple, list[Trial]] = {}
    for trial in trials:
        if trial not in rows:
            runs.setdefault(_inputs(trial), []).append(trial)
    def keep(trial: Trial, row: tuple) -> None:
        spark.createDataFrame([row], SCORES).coalesce(1).write.mode("overwrite").parquet(places[trial])

    families: dict[tuple, list[list[Trial]]] = {}
    for listed in runs.values():
        families.setdefault(_family(listed[0]), []).append(listed)
    beside = max(1, parallelism // len(families)) if runs else 1

    def family(listed: list[list[Trial]]) -> list[list[tuple]]:
        """All runs over the same words, whose tables go before the next family's are made."""
        with intermediate_tables(spark):
            counted = _counted(corpus, listed[0][0].cleaning, [run[0].tokens for run in listed], key)
            within = max(1, beside // len(listed))
            return side_by_side(spark, lambda run: _run(counted, run, *settings, within, keep if results else None), listed, beside)

    made = side_by_side(spark, family, list(families.values()), parallelism)
    scored = {tuple(run): found for listed, rows_of in zip(families.values(), made) for run, found in zip(listed, rows_of)}
    rows |= {trial: row for run, found in scored.items() for trial, row in zip(run, found)}
    return spark.createDataFrame([rows[trial] for trial in trials], SCORES)


def _digest(trial: Trial, settings: tuple) -> str:
    return hashlib.sha256(repr((trial, settings)).encode()).hexdigest()[:32]


def _found(spark: SparkSession, place: str) -> Row | None:
    """The row written to a folder, if it was written to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return None
    return spark.read.schema(SCORES).parquet(place).first()


def stored_results(spark: SparkSession, results: str) -> DataFrame:
    """Rows of all trials that are done; see ``SCORES``."""
    return spark.read.schema(SCORES).parquet(f"{results.rstrip('/')}/*")


def _inputs(trial: Trial) -> tuple:
    """What a trial's token table depends on."""
    return trial.cleaning, replace(trial.tokens, cleanup=SHRINK)


def _family(trial: Trial) -> tuple:
    """What trials have in common that share their words and the count of their n-grams."""
    return trial.cleaning, plain_form(trial.tokens)


def _counted(corpus: DataFrame, cleaning: str, configs: Sequence[TokenConfig], key: str) -> tuple[DataFrame, DataFrame, int]:
    """Words of all forms and statistics of all n-grams of a family, both written tables; its number of texts."""
    forms = stored(form_table(clean(nonempty(corpus), cleaning), configs, [key]))
    wanted = [(form_of(config), size) for config in configs for size in config.ngrams]
    return forms, stored(terms.ngram_statistics(forms, wanted)), forms.count()


def _setting(trial: Trial) -> tuple[int, int, int]:
    """What a trial's model depends on besides its tokens."""
    return trial.min_df, trial.k, trial.max_iter


def _run(
    counted, trials, key, seed, terms_per_topic, window, vocabulary_size, subsampling_rate, beside, keep: Callable | None
) -> list[tuple]:
    forms, shared, documents = counted
    spark = forms.sparkSession
    config = trials[0].tokens
    table = tokens_of_form(forms, config, [key])
    statistics = terms.setting_statistics(shared, form_of(config), config.ngrams, config.distinct)
    by_min_df: dict[int, list[tuple[int, int, int]]] = {}
    for setting in dict.fromkeys(map(_setting, trials)):
        by_min_df.setdefault(setting[0], []).append(setting)

    def row(trial: Trial, by_topic: list[list[str]], perplexity: float, mean: float | None, size: int) -> tuple:
        return trial.config, trial.k, trial.min_df, documents, size, perplexity, mean, by_topic

    def fit_all(settings: list[tuple[int, int, int]]) -> list[tuple[list[list[str]], float, float | None, int]]:
        """Fits over one vocabulary; its vectors and models go before the next one's are made."""
        with intermediate_tables(spark):
            topic_counts = [k for _, k, _ in settings]
            listed = terms.vocabulary(statistics, settings[0][0], size=vocabulary_size)
            weights = stored(terms.idf(listed, F.lit(documents)))
            vectored = vectors.document_vectors(table, weights, [key])
            size, prepared = weights.count(), topics.prepare(vectored, [key], seed, subsampling_rate, max(topic_counts), min(topic_counts))

            def fit(setting: tuple[int, int, int]) -> tuple[list[list[str]], float, float | None, int]:
                _, k, max_iter = setting
                with intermediate_tables(spark):
                    model = topics.fit_prepared(prepared, k, max_iter, seed)
                    best = topics.topic_terms(model, weights, terms_per_topic).collect()
                    perplexity = topics.log_perplexity(model, vectored)
                ranked = sorted((row["topic"], row["rank"], row["term"]) for row in best)
                by_topic = [[term for topic, _, term in ranked if topic == number] for number in range(k)]
                mean = None
                if keep:
                    (mean,) = _mean_coherence(table, [by_topic], key, window)
                    for trial in trials:
                        if _setting(trial) == setting:
                            keep(trial, row(trial, by_topic, perplexity, mean, size))
                return by_topic, perplexity, mean, size

            return side_by_side(spark, fit, settings, max(1, beside // len(by_min_df)))

    groups = side_by_side(spark, fit_all, list(by_min_df.values()), beside)
    settings, fitted = ([one for group in some for one in group] for some in (by_min_df.values(), groups))
    if not keep:
        means = _mean_coherence(table, [by_topic for by_topic, *_ in fitted], key, window)
        fitted = [(by_topic, perplexity, mean, size) for (by_topic, perplexity, _, size), mean in zip(fitted, means)]
    found = dict(zip(settings, fitted))
    return [row(trial, *found[_setting(trial)]) for trial in trials]


def _mean_coherence(table: DataFrame, models: list[list[list[str]]], key: str, window: int) -> list[float | None]:
    """Mean topic coherence of each model; all topics share one pass over the tokens."""
    listed = [
        (model, topic, term)
        for model, by_topic in enumerate(models)
        for topic, words in enumerate(by_topic)
        for term in words
    ]
    named = table.sparkSession.createDataFrame(listed, "model int, number int, term string").select(
        F.struct("model", "number").alias("topic"), "term"
    )
    scores = coherence.coherence_cv(table, named, key, window=window)
    means = scores.groupBy(F.col("topic.model").alias("model")).agg(F.avg("coherence").alias("mean"))
    found = {row["model"]: row["mean"] for row in means.collect()}
    return [found.get(model) for model in range(len(models))]
