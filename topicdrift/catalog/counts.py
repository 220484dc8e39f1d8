"""Bags of words, vocabularies, weights, and top terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import terms, vectors
from ..operators.corpus import with_period
from ..plans.sweep import MIN_DF_TRIALS
from ..plans.text import token_table
from ..runtime import stored
from . import inputs
from .registry import query

KEYS = ["doc_id"]
THRESHOLDS = tuple(trial.min_df for trial in MIN_DF_TRIALS)


def _statistics(bag):
    return stored(terms.term_statistics(bag))


def _weights(spark, folder, min_df=1, bag=None):
    documents = terms.document_count(inputs.table(spark, folder, "documents"))
    statistics = _statistics(inputs.bag(spark, folder) if bag is None else bag)
    return stored(terms.idf(terms.vocabulary(statistics, min_df, size=None), documents))


def _wide_ids(listed):
    return listed.withColumn("term_id", F.col("term_id").cast("bigint"))


@query("bag_of_words", inputs.with_corpus(inputs.BAG_SQL + "\nSELECT * FROM bag"))
def bag_of_words(spark, folder):
    return inputs.bag(spark, folder)


@query("vocabulary", inputs.with_corpus(inputs.vocabulary_sql(1) + "\nSELECT * FROM vocabulary"))
def vocabulary(spark, folder):
    return _wide_ids(terms.vocabulary(_statistics(inputs.bag(spark, folder)), size=None))


@query("vocabulary_mindf", inputs.with_corpus(inputs.vocabulary_sql(10) + "\nSELECT * FROM vocabulary"))
def vocabulary_mindf(spark, folder):
    return _wide_ids(terms.vocabulary(_statistics(inputs.bag(spark, folder)), min_df=10, size=None))


SIZES_SQL = " UNION ALL ".join(
    f"SELECT CAST({least} AS BIGINT) AS min_df, count(*) AS terms FROM statistics WHERE df >= {least}" for least in THRESHOLDS
)


@query("mindf_vocab_sizes", inputs.with_corpus(inputs.STATISTICS_SQL + "\n" + SIZES_SQL))
def mindf_vocab_sizes(spark, folder):
    sizes = terms.vocabulary_sizes(terms.term_statistics(inputs.bag(spark, folder)), THRESHOLDS)
    return sizes.select(F.col("min_df").cast("bigint"), "terms")


IDF_SQL = "ln(((SELECT count(*) FROM documents) + 1) / (df + 1))"


@query("idf", inputs.with_corpus(inputs.vocabulary_sql(1) + f"""
SELECT term, df, round({IDF_SQL}, 6) AS idf FROM vocabulary"""))
def idf(spark, folder):
    return _weights(spark, folder).select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf", inputs.with_corpus(inputs.vocabulary_sql(1) + f"""
SELECT doc_id, term, round(tf * {IDF_SQL}, 6) AS tfidf FROM bag JOIN vocabulary USING (term)"""))
def tfidf(spark, folder):
    # Both the vocabulary and the weights read the bag; texts are cut and counted once.
    bag = stored(inputs.bag(spark, folder))
    weighted = terms.tfidf(bag, _weights(spark, folder, bag=bag), KEYS)
    return weighted.withColumn("tfidf", F.round("tfidf", 6))


VECTOR_SQL = """
SELECT doc_id, count(term_id) AS entries, CAST(coalesce(sum(tf) FILTER (term_id IS NOT NULL), 0) AS BIGINT) AS words,
       (SELECT count(*) FROM vocabulary) AS size
FROM documents LEFT JOIN bag USING (doc_id) LEFT JOIN vocabulary USING (term) GROUP BY doc_id"""


@query("term_counts", inputs.with_corpus(inputs.vocabulary_sql(5) + """
SELECT doc_id, term_id, tf FROM bag JOIN vocabulary USING (term)"""))
def term_counts(spark, folder):
    """Counts over the vocabulary in long form."""
    known = _weights(spark, folder, 5).select("term", "term_id")
    return inputs.bag(spark, folder).join(known, "term").select("doc_id", F.col("term_id").cast("bigint"), "tf")


@query("vector_totals", inputs.with_corpus(inputs.vocabulary_sql(5) + VECTOR_SQL))
def vector_totals(spark, folder):
    """The model's count vectors, one per document: entries, sum and length."""
    made = vectors.document_vectors(inputs.tokens(spark, folder), _weights(spark, folder, 5), KEYS, vectors.COUNT)
    parts = vectors.entries(made, KEYS)
    return parts.select(
        "doc_id",
        F.size("indices").cast("bigint").alias("entries"),
        F.aggregate("values", F.lit(0.0), lambda total, value: total + value).cast("bigint").alias("words"),
        F.col("size").cast("bigint").alias("size"),
    )


BINARY_SQL = VECTOR_SQL.replace("sum(tf)", "count(tf)")


@query("vector_presence", inputs.with_corpus(inputs.vocabulary_sql(5) + BINARY_SQL))
def vector_presence(spark, folder):
    """Binary vectors of bags: 1 for each known term of a document."""
    bag = terms.bag_of_words(inputs.tokens(spark, folder), KEYS, keep_empty=True)
    made = vectors.stored_vectors(bag, _weights(spark, folder, 5), KEYS, vectors.COUNT, binary=True)
    return vectors.entries(made, KEYS).select(
        "doc_id",
        F.size("indices").cast("bigint").alias("entries"),
        F.aggregate("values", F.lit(0.0), lambda total, value: total + value).cast("bigint").alias("words"),
        F.col("size").cast("bigint").alias("size"),
    )


@query("top_terms_per_group", inputs.with_corpus(inputs.WORDS_SQL + f""",
dated AS (SELECT *, {inputs.PERIOD_SQL} AS period FROM words),
inside AS (SELECT doc_id FROM corpus WHERE {inputs.PERIOD_SQL} IS NOT NULL),
frequency AS (SELECT term, count(DISTINCT doc_id) AS df FROM dated WHERE period IS NOT NULL GROUP BY term),
weighted AS (SELECT period, term,
  round(count(*) * ln(((SELECT count(*) FROM inside) + 1) / (any_value(df) + 1)), 6) AS weight
  FROM dated JOIN frequency USING (term) WHERE period IS NOT NULL GROUP BY period, term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY weight DESC, term) AS rank FROM weighted)
SELECT period, rank, term, weight FROM ranked WHERE rank <= 10"""))
def top_terms_per_group(spark, folder):
    """Ten heaviest terms of each period; idf over documents with a period."""
    dated = with_period(inputs.corpus(spark, folder)).where(F.col("period").isNotNull())
    counted = terms.bag_of_words(token_table(dated, inputs.ALL_TOKENS, ["doc_id", "period"]), ["doc_id", "period"])
    # Term totals per period carry the document counts along: one aggregate of the bag.
    by_period = counted.groupBy("period", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    by_period = stored(by_period)
    frequency = by_period.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.round(F.col("tf") * terms.idf_weight(F.col("df"), terms.document_count(dated)), 6)
    weighted = by_period.drop("df").join(frequency, "term").withColumn("weight", weight)
    return terms.top_terms(weighted, ["period"], "weight").withColumn("rank", F.col("rank").cast("bigint"))
