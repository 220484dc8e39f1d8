"""Topic models. SQL cannot fit them; the checks cover what is determined: sizes, sums,
names and ranges, not the quality of topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import evolution, terms, topics, vectors
from ..operators.corpus import PERIODS
from ..plans import sweep as trials
from ..plans.modelling import (
    FINAL_ITERATIONS, FINAL_TOKENS, FINAL_TOPICS, PERIOD_ITERATIONS, PERIOD_TOPICS, fit_topics, fit_topics_per_period, stored_weights,
    weigh_topics,
)
from ..plans.text import TokenConfig
from ..runtime import side_by_side, stored
from . import inputs
from .cleaning import clean_sql
from .porter_sql import stem_sql
from .registry import query
from .tokens import OWN_SQL, _ngrams_sql

SEED = 17
K = FINAL_TOPICS
KEYS = ["doc_id", "title", "year"]
PERIOD_K = PERIOD_TOPICS
PARALLELISM = 4


def _fitted(spark, folder):
    """The final model at its own settings, over all terms."""
    return fit_topics(inputs.marked(spark, folder), KEYS, SEED, vocabulary_size=None)


def _fitted_periods(spark, folder):
    """The models per period at their own settings, over all terms."""
    return fit_topics_per_period(inputs.corpus(spark, folder), SEED, vocabulary_size=None, parallelism=PARALLELISM)


def _listed_tokens(trial, run: str) -> str:
    """Token lists of a trial over ``marked``, by its switches; stems by their own SQL."""
    config: TokenConfig = trial.tokens
    text = clean_sql(trial.cleaning)
    listed = f"[{inputs.english_stop_words_sql()}]" if config.stop_words == "english" else (
        "[" + ", ".join(f"'{word}'" for word in config.stop_words) + "]"
    )
    words = f"list_filter({inputs.words_sql(text, config.lowercase)}, lambda w: NOT list_contains({listed}, lower(w)))"
    parts = [f"{run}_words AS (SELECT doc_id, {words} AS tokens FROM marked)"]
    source = f"{run}_words"
    if config.stem:
        parts.append(stem_sql(f"SELECT DISTINCT unnest(tokens) AS term FROM {source}", f"{run}_").lstrip(",\n"))
        parts.append(
            f"{run}_stemmed AS (SELECT doc_id, list(stem ORDER BY place) AS tokens FROM "
            f"(SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS place FROM {source}) "
            f"JOIN {run}_stems USING (term) GROUP BY doc_id)"
        )
        source = f"{run}_stemmed"
    lists = ["tokens" if n == 1 else _ngrams_sql(n) for n in config.ngrams]
    joined = reduce(lambda left, right: f"list_concat({left}, {right})", lists)
    parts.append(f"{run} AS (SELECT doc_id, {joined} AS tokens FROM {source})")
    return ",\n".join(parts)


# The final model's vocabulary, by its own SQL.
FINAL_SQL = ",\n" + _listed_tokens(trials.Trial("final", tokens=FINAL_TOKENS), "final") + """,
vocabulary AS (SELECT DISTINCT unnest(tokens) AS term FROM final)"""


def _checked_terms(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per topic: number of terms, of distinct ones, and whether weights fall with the rank."""
    falling = F.transform(F.array_sort(F.collect_list(F.struct("rank", "weight"))), lambda row: -row["weight"])
    return rows.groupBy(*group, "topic").agg(
        F.count("*").alias("terms"),
        F.count_distinct("term").alias("distinct_terms"),
        (F.sort_array(falling) == falling).alias("falling"),
    ).withColumn("topic", F.col("topic").cast("bigint"))


@query("lda_fit", inputs.with_marked(FINAL_SQL + f"""
SELECT topic, (SELECT count(*) FROM vocabulary) AS terms, CAST(1.0 AS DOUBLE) AS weight FROM range({K}) AS t(topic)"""))
def lda_fit(spark, folder):
    """Each topic is a distribution over the whole vocabulary."""
    fitted = _fitted(spark, folder)
    sums = [F.sum(F.get("weights", F.lit(topic)) / total) for topic, total in enumerate(fitted.model.totals)]
    rows = fitted.model.topics.agg(F.count_distinct("term_id").alias("terms"), F.array(*sums).alias("sums"))
    return rows.select(F.posexplode("sums").alias("topic", "weight"), "terms").select(
        F.col("topic").cast("bigint").alias("topic"), "terms", F.round("weight", 6).alias("weight"))


# Planted topics: each has a run of terms, and neighbours share those at its ends.
PLANTED = 8
PLANTED_TERMS = 80
PLANTED_STEP = 62
PLANTED_KEYS = ["doc_id"]
PLANTED_RATE = 0.25
PLANTED_ITERATIONS = 60
PLANTED_LEARNING = (10.0, 0.7)
PLANTED_SEEDS = (1, 2, 3)


def _planted(spark, folder):
    """Token lists of the corpus with every word replaced by a term of a planted topic.

    Four of five words of a text get a term of its own topic, the others of any topic, by a
    hash of text, place and word; a topic's first terms are the commonest.
    """
    def term(word, place):
        drawn = F.xxhash64("doc_id", place, word)
        topic = F.when(F.pmod(drawn, F.lit(5)) < 4, F.col("doc_id") % PLANTED).otherwise(F.pmod(F.shiftright(drawn, 8), F.lit(PLANTED)))
        part = F.pmod(F.shiftright(drawn, 16), F.lit(10_000)) / 10_000.0
        return F.concat(F.lit("t"), (topic * PLANTED_STEP + F.floor(part * part * PLANTED_TERMS)).cast("string"))

    return stored(inputs.tokens(spark, folder).select("doc_id", F.transform("tokens", term).alias("tokens")))


def _planted_vectors(planted, rows):
    """Counts over the vocabulary of ``rows``, for the given token lists."""
    weights = stored_weights(terms.bag_of_words(rows, PLANTED_KEYS), rows.count(), 1, None)
    return weights, vectors.document_vectors(planted, weights, PLANTED_KEYS, vectors.COUNT)


@query("lda_topics", f"""
SELECT CAST({PLANTED} AS BIGINT) AS topics, CAST({PLANTED} AS BIGINT) AS planted, true AS pure""")
def lda_topics(spark, folder):
    """Planted topics are found: eight, over 514 terms, overlapping, and mixed in every text.

    Of a topic's 20 heaviest terms at least 16 must be of one planted topic, another one for each topic.
    As a fit can end with two planted topics in one, there are three, and that of the best bound counts.
    """
    planted = _planted(spark, folder)
    weights, made = _planted_vectors(planted, planted)
    prepared = topics.prepare(made, PLANTED_KEYS, SEED, PLANTED_RATE, PLANTED)

    def fitted(seed):
        model = topics.fit_prepared(prepared, PLANTED, PLANTED_ITERATIONS, seed, *PLANTED_LEARNING)
        return topics.log_perplexity(model, made), seed, model

    model = min(side_by_side(spark, fitted, PLANTED_SEEDS, PARALLELISM), key=lambda one: one[:2])[2]
    number = F.floor(F.substring("term", 2, 9).cast("int") / PLANTED_STEP)
    best = topics.topic_terms(model, weights, 20).withColumn("planted", F.least(number, F.lit(PLANTED - 1)))
    by_topic = best.groupBy("topic").agg(F.mode("planted", deterministic=True).alias("most"), F.collect_list("planted").alias("all"))
    own = F.size(F.filter("all", lambda one: one == F.col("most")))
    return by_topic.agg(
        F.count("topic").alias("topics"), F.count_distinct("most").alias("planted"), (F.min(own) >= 16).alias("pure"),
    )


@query("held_out_perplexity", inputs.with_corpus("""
SELECT true AS better_than_one_topic, true AS better_than_too_few FROM corpus LIMIT 1"""))
def held_out_perplexity(spark, folder):
    """Texts that no fit has seen: their words are likelier under as many topics as were planted than under one or three.

    A tenth of the texts is kept back by a hash; their topics come from one half of the terms, the other is scored.
    """
    planted = _planted(spark, folder).withColumn("unseen", topics.held_out(PLANTED_KEYS, seed=SEED))
    seen, unseen = planted.where("NOT unseen").drop("unseen"), planted.where("unseen").drop("unseen")
    weights, made = _planted_vectors(seen, seen)
    others = vectors.document_vectors(unseen, weights, PLANTED_KEYS, vectors.COUNT)
    prepared = topics.prepare(made, PLANTED_KEYS, SEED, PLANTED_RATE, PLANTED)

    def score(k):
        return topics.held_out_log_perplexity(topics.fit_prepared(prepared, k, PLANTED_ITERATIONS, SEED, *PLANTED_LEARNING), others)

    one, few, as_planted = side_by_side(spark, score, (1, 3, PLANTED), PARALLELISM)
    return spark.createDataFrame([(as_planted < one, as_planted < few)], "better_than_one_topic boolean, better_than_too_few boolean")


@query("topic_terms", f"""
SELECT topic, CAST(10 AS BIGINT) AS terms, CAST(10 AS BIGINT) AS distinct_terms, true AS falling FROM range({K}) AS t(topic)""")
def topic_terms(spark, folder):
    return _checked_terms(_fitted(spark, folder).topic_terms(), [])


@query("topic_distribution", inputs.with_corpus(f"""
SELECT doc_id, title, year, CAST({K} AS BIGINT) AS topics, CAST(1.0 AS DOUBLE) AS total FROM corpus"""))
def topic_distribution(spark, folder):
    """One distribution per document, adding up to 1."""
    shares = _fitted(spark, folder).topic_distribution()
    total = F.aggregate(topics.DISTRIBUTION, F.lit(0.0), lambda total, share: total + share)
    return shares.select(*KEYS, F.size(topics.DISTRIBUTION).cast("bigint").alias("topics"), F.round(total, 6).alias("total"))


@query("topic_prevalence", inputs.with_corpus(f"""
SELECT year, CAST(count(*) AS DOUBLE) AS mass, CAST(1.0 AS DOUBLE) AS shares, CAST({K} AS BIGINT) AS topics
FROM corpus GROUP BY year"""))
def topic_prevalence(spark, folder):
    """Model shares by year: a year's mass is its number of documents, its shares add up to 1."""
    shares = _fitted(spark, folder).topic_distribution()
    mass = evolution.prevalence_share(evolution.topic_mass(shares, topics.DISTRIBUTION, ["year"], K), ["year"])
    return mass.groupBy("year").agg(
        F.round(F.sum("total"), 4).alias("mass"), F.round(F.sum("share"), 6).alias("shares"), F.count("topic").alias("topics")
    )


def heatmap(spark, folder):
    """Corpus, model, shares by year, one column per topic."""
    shares = _fitted(spark, folder).topic_distribution()
    mass = evolution.topic_mass(shares, topics.DISTRIBUTION, ["year"], K)
    return evolution.prevalence_pivot(evolution.prevalence_share(mass, ["year"]), ["year"], "topic", range(K))


@query("topic_heatmap", inputs.with_corpus(f"""
SELECT DISTINCT year, CAST({K} AS BIGINT) AS topics, CAST(1.0 AS DOUBLE) AS total, true AS in_range FROM corpus"""))
def topic_heatmap(spark, folder):
    """The flagship, by what is determined: a column per topic, shares from 0 to 1 that add up to 1 each year."""
    shares = heatmap(spark, folder)
    columns = F.array(*[name for name in shares.columns if name != "year"])
    total = F.aggregate(columns, F.lit(0.0), lambda total, share: total + share)
    return shares.select(
        "year", F.size(columns).cast("bigint").alias("topics"), F.round(total, 6).alias("total"),
        F.forall(columns, lambda share: share.between(0.0, 1.0)).alias("in_range"),
    )


@query("log_perplexity", inputs.with_marked(FINAL_SQL + """
SELECT count(*) AS documents, (SELECT count(*) FROM vocabulary) AS vocabulary, true AS below_even, true AS below_two FROM corpus"""))
def log_perplexity(spark, folder):
    """The bound is below that of equally likely words, and below that of a model of two topics."""
    weights, rows = weigh_topics(inputs.marked(spark, folder), KEYS, vocabulary_size=None)
    size, prepared = weights.count(), topics.prepare(rows, KEYS, SEED, k=K, least=2)

    def scored(k):
        return topics.log_perplexity(topics.fit_prepared(prepared, k, FINAL_ITERATIONS, SEED), rows)

    bound, two = side_by_side(spark, scored, (K, 2), PARALLELISM)
    return rows.agg(F.count("*").alias("documents")).select(
        "documents",
        F.lit(size).cast("bigint").alias("vocabulary"),
        (F.lit(bound) < F.log(F.lit(float(size)))).alias("below_even"),
        (F.lit(bound) < F.lit(two)).alias("below_two"),
    )


PERIODS_SQL = ", ".join(f"('{name}')" for _, _, name in PERIODS)


@query("period_topics", f"""
SELECT period, topic, CAST(10 AS BIGINT) AS terms, CAST(10 AS BIGINT) AS distinct_terms, true AS falling
FROM (VALUES {PERIODS_SQL}) AS p(period), range({PERIOD_K}) AS t(topic)""")
def period_topics(spark, folder):
    """One model per period over the vocabulary of all periods."""
    return _checked_terms(_fitted_periods(spark, folder).topic_terms(), ["period"])


@query("period_topic_distribution", inputs.with_corpus(f"""
SELECT DISTINCT title, {inputs.PERIOD_SQL} AS period, CAST({PERIOD_K} AS BIGINT) AS topics, true AS valid
FROM corpus WHERE {inputs.PERIOD_SQL} IS NOT NULL"""))
def period_topic_distribution(spark, folder):
    shares = _fitted_periods(spark, folder).topic_distribution()
    total = F.aggregate(topics.DISTRIBUTION, F.lit(0.0), lambda total, share: total + share)
    valid = (F.abs(total - 1) < 1e-6) | (total == 0)
    return shares.select("title", "period", F.size(topics.DISTRIBUTION).cast("bigint").alias("topics"), valid.alias("valid"))


def _checked_scores(scores: DataFrame) -> DataFrame:
    """What is determined about a sweep's rows."""
    lengths = F.transform("topics", F.size)
    return scores.select(
        "config",
        F.col("k").cast("bigint").alias("k"),
        F.col("min_df").cast("bigint").alias("min_df"),
        "documents",
        "vocabulary",
        F.size("topics").cast("bigint").alias("topics"),
        F.array_min(lengths).cast("bigint").alias("least_terms"),
        F.col("log_perplexity").isNotNull().alias("perplexity_known"),
        F.col("coherence").between(-1.0, 1.0).alias("coherence_in_range"),
    )


def _sweep_sql(listed) -> str:
    """One vocabulary count for all trials with the same cleaning and tokens."""
    names, runs, rows = {}, [], []
    for trial in listed:
        inputs_of = (trial.cleaning, trial.tokens)
        if inputs_of not in names:
            run = names[inputs_of] = f"run{len(names)}"
            runs.append(_listed_tokens(trial, run))
            runs.append(
                f"{run}_df AS (SELECT term, count(DISTINCT doc_id) AS df FROM "
                f"(SELECT doc_id, unnest(tokens) AS term FROM {run}) GROUP BY term)"
            )
        run = names[inputs_of]
        rows.append(
            f"SELECT '{trial.config}' AS config, CAST({trial.k} AS BIGINT) AS k, CAST({trial.min_df} AS BIGINT) AS min_df, "
            f"(SELECT count(*) FROM {run}) AS documents, "
            f"(SELECT count(*) FROM {run}_df WHERE df >= {trial.min_df}) AS vocabulary, "
            f"CAST({trial.k} AS BIGINT) AS topics, CAST(10 AS BIGINT) AS least_terms, "
            f"true AS perplexity_known, true AS coherence_in_range"
        )
    return ",\n" + ",\n".join(runs) + "\n" + "\nUNION ALL ".join(rows)


def _register_sweep(name: str, listed: tuple) -> None:
    @query(name, inputs.with_marked(_sweep_sql(listed)))
    def run(spark, folder):
        scores = trials.sweep(inputs.marked(spark, folder), listed, "doc_id", SEED, vocabulary_size=None, parallelism=PARALLELISM)
        return _checked_scores(scores)


_register_sweep("sweep_cleaning", trials.CLEANING_TRIALS)
_register_sweep("sweep_tokens", trials.TOKEN_TRIALS)
_register_sweep("sweep_ngrams", trials.NGRAM_TRIALS)
_register_sweep("sweep_mindf", trials.MIN_DF_TRIALS)
_register_sweep("sweep_k", trials.TOPIC_TRIALS)
