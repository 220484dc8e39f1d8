"""Reports and tables written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..operators import terms
from ..runtime import new_table_path
from ..sources.pages import ingest
from . import inputs
from .evolution import K, LIMITS, SHARES_SQL, TOPICS_SQL, shares
from .registry import query

# Figures that follow from the corpus stand in for a model's scores.
FIGURES_SQL = TOPICS_SQL + """,
figures AS (SELECT lang AS config, count(*) AS log_perplexity, CAST(sum(length(content)) AS BIGINT) AS coherence FROM corpus GROUP BY lang),
listed AS (SELECT topic AS config, 'Topic 1: ' || string_agg(term, ', ' ORDER BY rank) AS text FROM topics GROUP BY topic)"""


def _scores(spark, folder):
    table = inputs.tokens(spark, folder, "lang")
    counted = terms.grouped_bag(terms.bag_of_words(table, ["lang"]), ["lang"])
    best = terms.top_terms(counted, ["lang"], "tf")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda row: row["term"])
    topics = best.groupBy("lang").agg(F.array(ordered).alias("topics"))
    figures = inputs.corpus(spark, folder).groupBy("lang").agg(
        F.count("*").alias("log_perplexity"), F.sum(F.length("content").cast("bigint")).alias("coherence")
    )
    return topics.join(figures, "lang").withColumnRenamed("lang", "config")


@query("report_lines", inputs.with_corpus(FIGURES_SQL + """
SELECT config, CAST(0 AS BIGINT) AS line, 'Variant: ' || config AS text FROM figures
UNION ALL SELECT config, 1, text FROM listed
UNION ALL SELECT config, 2, 'Perplexity: ' || CAST(log_perplexity AS VARCHAR) FROM figures
UNION ALL SELECT config, 3, 'Coherence Score: ' || CAST(coherence AS VARCHAR) FROM figures"""))
def report_lines(spark, folder):
    lines = sinks.report_lines(_scores(spark, folder), "Variant: ")
    return lines.withColumn("line", F.col("line").cast("bigint"))


@query("report_roundtrip", inputs.with_corpus(FIGURES_SQL + """
SELECT 'Variant: ' || config AS value FROM figures UNION ALL SELECT text FROM listed
UNION ALL SELECT 'Perplexity: ' || CAST(log_perplexity AS VARCHAR) FROM figures
UNION ALL SELECT 'Coherence Score: ' || CAST(coherence AS VARCHAR) FROM figures"""))
def report_roundtrip(spark, folder):
    path = new_table_path(spark)
    sinks.write_report(_scores(spark, folder), path, "Variant: ")
    return spark.read.text(path)


@query("csv_roundtrip", """
SELECT user_id AS "Topics", round(avg(value), 4) AS "Coherence", round(max(value), 4) AS "Perplexity" FROM events GROUP BY user_id""")
def csv_roundtrip(spark, folder):
    """The score table's format, with figures per user in place of scores per model."""
    scores = inputs.table(spark, folder, "events").groupBy(F.col("user_id").alias("k")).agg(
        F.round(F.avg("value"), 4).alias("coherence"), F.round(F.max("value"), 4).alias("log_perplexity")
    )
    path = new_table_path(spark)
    sinks.write_scores(scores, path)
    return spark.read.schema("Topics bigint, Coherence double, Perplexity double").option("header", True).csv(path)


@query("parquet_roundtrip", inputs.with_corpus(SHARES_SQL + f"""
SELECT doc_id, title, year, {', '.join(f'round(shares[{i + 1}], 6) AS topic_{i}' for i in range(len(LIMITS)))} FROM shares"""))
def parquet_roundtrip(spark, folder):
    path = new_table_path(spark)
    sinks.write_distribution(shares(spark, folder), path)
    read = spark.read.parquet(path)
    return read.select("doc_id", "title", "year", *[F.round(F.col("shares")[i], 6).alias(f"topic_{i}") for i in range(K)])


@query("ingest_by_year", inputs.with_corpus("""
SELECT doc_id, title, year, content, year BETWEEN 2006 AND 2011 AS listed FROM corpus"""))
def ingest_by_year(spark, folder):
    """Revisions written by year and read back: a range of years, which reads only its directories, and the rest."""
    path = new_table_path(spark)
    ingest(inputs.corpus(spark, folder).drop("lang"), path)
    read, inside = spark.read.parquet(path), F.col("year").between(2006, 2011)
    both = read.where(inside).withColumn("listed", F.lit(True)).unionByName(read.where(~inside).withColumn("listed", F.lit(False)))
    return both.select("doc_id", "title", F.col("year").cast("bigint").alias("year"), "content", "listed")


AGAIN = (2007, 2019)


@query("ingest_year_again", inputs.with_corpus(f"""
SELECT doc_id, title, year, CASE WHEN year IN {AGAIN} THEN upper(lang) || content ELSE content END AS content FROM corpus
WHERE NOT (year = {AGAIN[0]} AND doc_id % 2 = 0)"""))
def ingest_year_again(spark, folder):
    """Two years written again, with other texts and one of them with fewer rows; all other years stay."""
    path, rows = new_table_path(spark), inputs.corpus(spark, folder)
    ingest(rows.drop("lang"), path)
    changed = rows.where(F.col("year").isin(*AGAIN)).where(~((F.col("year") == AGAIN[0]) & (F.col("doc_id") % 2 == 0)))
    ingest(changed.withColumn("content", F.concat(F.upper("lang"), "content")).drop("lang"), path, given_years_only=True)
    return spark.read.parquet(path).select("doc_id", "title", F.col("year").cast("bigint").alias("year"), "content")
