"""The supplied tables seen as dated page revisions, in Spark and as SQL text.

``documents`` become revisions: the title is source and language, the date follows from
the id and spans 2000 to 2025, one year beyond the periods on either side. Every row and
every text is used whole.
"""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import terms
from ..operators.corpus import with_period
from ..plans.text import TokenConfig, token_table
from ..runtime import spread

ALL_TOKENS = TokenConfig(stop_words=None)

CORPUS_SQL = """
corpus AS (
  SELECT doc_id, source || '_' || lang AS title, lang,
         make_timestamp(2000 + doc_id % 26, 1 + (doc_id // 26) % 12, 1, 0, 0, 0.0) AS timestamp,
         CAST(2000 + doc_id % 26 AS BIGINT) AS year, text AS content
  FROM documents)"""

# Markup added to each text: template, reference, URL, file link, words, entities,
# comment, a template over two lines, a tag.
MARKUP_SQL = """
marked AS (
  SELECT doc_id, title, timestamp, year,
    content || ' {{cite|' || title || '}} <ref name="r' || CAST(doc_id AS VARCHAR) || '">note</ref> http://example.org/'
    || CAST(doc_id AS VARCHAR) || ' [[File:img' || CAST(doc_id AS VARCHAR) || '.png]] ISBN ' || CAST(doc_id AS VARCHAR)
    || ' REDIRECT a &amp; b &lt;i&gt; <!-- c --> {{open\n}} <b>x</b>' AS content
  FROM corpus)"""

PERIOD_SQL = """CASE WHEN year BETWEEN 2001 AND 2005 THEN '2001-2005' WHEN year BETWEEN 2006 AND 2011 THEN '2006-2011'
  WHEN year BETWEEN 2012 AND 2018 THEN '2012-2018' WHEN year BETWEEN 2019 AND 2024 THEN '2019-2024' END"""


def with_corpus(body: str) -> str:
    return f"WITH {CORPUS_SQL}{body}"


def with_marked(body: str) -> str:
    return f"WITH {CORPUS_SQL},{MARKUP_SQL}{body}"


def words_sql(text: str, lowercase: bool = True) -> str:
    """Token list of a text expression: anything but letters and blanks parts words."""
    letters = f"regexp_replace({text}, '[^\\p{{L}}\\s]+', ' ', 'g')"
    if lowercase:
        letters = f"lower({letters})"
    return f"list_filter(regexp_split_to_array({letters}, '\\s+'), lambda w: w <> '')"


TOKENS_SQL = f",\ntokens AS (SELECT doc_id, title, lang, year, {words_sql('content')} AS tokens FROM corpus)"
WORDS_SQL = TOKENS_SQL + ",\nwords AS (SELECT doc_id, title, lang, year, unnest(tokens) AS term FROM tokens)"
BAG_SQL = WORDS_SQL + ",\nbag AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL)"
STATISTICS_SQL = BAG_SQL + ",\nstatistics AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM bag GROUP BY term)"


def vocabulary_sql(min_df: int) -> str:
    return STATISTICS_SQL + f""",
vocabulary AS (
  SELECT row_number() OVER (ORDER BY n DESC, term) - 1 AS term_id, term, n, df
  FROM (SELECT * FROM statistics WHERE df >= {min_df}))"""


def english_stop_words_sql() -> str:
    """Spark's English list as SQL strings, read from the library that ships it."""
    homes = (Path(pyspark.__file__).parent, Path(os.environ.get("SPARK_HOME", "/opt/spark")))
    jar = next(jar for home in homes for jar in (home / "jars").glob("spark-mllib_*.jar"))
    with zipfile.ZipFile(jar) as archive:
        words = archive.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split("\n")
    return ", ".join("'" + word.strip().replace("'", "''") + "'" for word in words if word.strip())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, title, lang, timestamp, year, content)``."""
    return spread(table(spark, folder, "documents"), "doc_id").selectExpr(
        "doc_id",
        "concat(source, '_', lang) AS title",
        "lang",
        "make_timestamp_ntz(cast(2000 + doc_id % 26 AS int), cast(1 + (doc_id div 26) % 12 AS int), 1, 0, 0, 0) AS timestamp",
        "2000 + doc_id % 26 AS year",
        "text AS content",
    )


def marked(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus with markup added to each text."""
    number = F.col("doc_id").cast("string")
    pieces = [
        F.col("content"), F.lit(" {{cite|"), F.col("title"), F.lit('}} <ref name="r'), number,
        F.lit('">note</ref> http://example.org/'), number, F.lit(" [[File:img"), number,
        F.lit(".png]] ISBN "), number,
        F.lit(" REDIRECT a &amp; b &lt;i&gt; <!-- c --> {{open\n}} <b>x</b>"),
    ]
    return corpus(spark, folder).drop("lang").withColumn("content", F.concat(*pieces))


def tokens(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """All words of the corpus, no stop words removed."""
    return token_table(with_period(corpus(spark, folder)), ALL_TOKENS, ["doc_id", *keys])


def bag(spark: SparkSession, folder: str) -> DataFrame:
    return terms.bag_of_words(tokens(spark, folder), ["doc_id"])
