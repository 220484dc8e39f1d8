"""Token lists, stop words, stems, lemmas and n-grams."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ..functions import tokens as words
from ..functions.cleaning import clean
from ..functions.stemming import stem_tokens
from ..operators import terms
from ..plans.stage import TokenSteps
from ..plans.sweep import OWN_STOP_WORDS
from ..plans.text import TokenConfig, token_table
from ..runtime import new_table_path, stored
from . import inputs
from .cleaning import clean_sql
from .porter_sql import stem_sql
from .registry import query

KEYS = ["doc_id"]


def _shown(df):
    """Lists as text, so that rows compare by value."""
    return df.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", "|").alias("tokens"))


def _shown_sql(tokens: str, source: str) -> str:
    return f"\nSELECT doc_id, CAST(len(t) AS BIGINT) AS n, array_to_string(t, '|') AS tokens FROM (SELECT doc_id, {tokens} AS t FROM {source})"


@query("tokens", inputs.with_corpus(_shown_sql(inputs.words_sql("content"), "corpus")))
def tokens(spark, folder):
    return _shown(inputs.tokens(spark, folder))


@query("tokens_keep_case", inputs.with_corpus(_shown_sql(inputs.words_sql("content", lowercase=False), "corpus")))
def tokens_keep_case(spark, folder):
    return _shown(token_table(inputs.corpus(spark, folder), TokenConfig(stop_words=None, lowercase=False), KEYS))


@query("tokens_joined", inputs.with_corpus(_shown_sql(
    r"list_filter(regexp_split_to_array(lower(regexp_replace(content, '[^\p{L}\s]+', '', 'g')), '\s+'), lambda w: w <> '')",
    "corpus")))
def tokens_joined(spark, folder):
    """Punctuation inside a word vanishes instead of parting it."""
    return _shown(token_table(inputs.corpus(spark, folder), TokenConfig(stop_words=None, punctuation="join"), KEYS))


@query("stopwords_default", inputs.with_corpus(_shown_sql(
    f"list_filter({inputs.words_sql('content')}, lambda w: NOT list_contains([{inputs.english_stop_words_sql()}], w))", "corpus")))
def stopwords_default(spark, folder):
    return _shown(token_table(inputs.corpus(spark, folder), TokenConfig(), KEYS))


OWN_SQL = "[" + ", ".join(f"'{word}'" for word in OWN_STOP_WORDS) + "]"


@query("stopwords_custom", inputs.with_marked(_shown_sql(
    f"list_filter({inputs.words_sql(clean_sql('urls'))}, lambda w: NOT list_contains({OWN_SQL}, w))", "marked")))
def stopwords_custom(spark, folder):
    """The own list replaces the English one; URLs became the word it names."""
    texts = clean(inputs.marked(spark, folder), "urls")
    return _shown(token_table(texts, TokenConfig(stop_words=OWN_STOP_WORDS), KEYS))


@query("stopwords_extended", inputs.with_marked(_shown_sql(
    f"list_filter({inputs.words_sql(clean_sql('urls'))}, "
    f"lambda w: NOT list_contains({OWN_SQL}, w) AND NOT list_contains([{inputs.english_stop_words_sql()}], w))", "marked")))
def stopwords_extended(spark, folder):
    texts = clean(inputs.marked(spark, folder), "urls")
    return _shown(token_table(texts, TokenConfig(stop_words=OWN_STOP_WORDS, extend_english=True), KEYS))


@query("stem_terms", inputs.with_corpus(inputs.WORDS_SQL + stem_sql("SELECT DISTINCT term FROM words") + """
SELECT term, stem FROM stems"""))
def stem_terms(spark, folder):
    """Each distinct word with its stem."""
    listed = inputs.bag(spark, folder).select("term").distinct()
    return listed.select("term", F.get(stem_tokens(F.array("term")), F.lit(0)).alias("stem"))


@query("stem_corpus_counts", inputs.with_corpus(inputs.BAG_SQL + stem_sql("SELECT DISTINCT term FROM bag") + """
SELECT stem AS term, CAST(sum(tf) AS BIGINT) AS n, count(DISTINCT doc_id) AS df
FROM bag JOIN stems USING (term) GROUP BY stem"""))
def stem_corpus_counts(spark, folder):
    """Occurrences and documents per stem, from stemmed token lists."""
    table = token_table(inputs.corpus(spark, folder), TokenConfig(stop_words=None, stem=True), KEYS)
    return terms.term_statistics(terms.bag_of_words(table, KEYS))


LEMMAS_SQL = """,
lemmas AS (SELECT DISTINCT term AS form, substr(term, 1, length(term) - 1) AS lemma
           FROM words WHERE length(term) > 3 AND term LIKE '%s')"""


@query("lemmatize", inputs.with_corpus(inputs.TOKENS_SQL + f""",
words AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS at FROM tokens){LEMMAS_SQL}
SELECT doc_id, count(w.term) AS n, coalesce(string_agg(coalesce(l.lemma, w.term), '|' ORDER BY w.at), '') AS tokens
FROM tokens t LEFT JOIN words w USING (doc_id) LEFT JOIN lemmas l ON l.form = w.term GROUP BY doc_id"""))
def lemmatize(spark, folder):
    """A form table taken from the corpus: longer words ending in s, without it."""
    table = inputs.tokens(spark, folder)
    forms = terms.bag_of_words(table, KEYS).where("length(term) > 3 AND endswith(term, 's')").select("term").distinct()
    lemmas = stored(forms.selectExpr("term AS form", "substr(term, 1, length(term) - 1) AS lemma"))
    return _shown(terms.lemmatize(table, lemmas, KEYS))


def _ngrams_sql(n: int, tokens: str = "tokens") -> str:
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"


@query("ngrams_2", inputs.with_corpus(inputs.TOKENS_SQL + _shown_sql(_ngrams_sql(2), "tokens")))
def ngrams_2(spark, folder):
    return _shown(token_table(inputs.corpus(spark, folder), TokenConfig(stop_words=None, ngrams=(2,)), KEYS))


@query("ngrams_3", inputs.with_corpus(inputs.TOKENS_SQL + _shown_sql(_ngrams_sql(3), "tokens")))
def ngrams_3(spark, folder):
    return _shown(token_table(inputs.corpus(spark, folder), TokenConfig(stop_words=None, ngrams=(3,)), KEYS))


MULTI_SQL = f"list_concat(list_concat(tokens, {_ngrams_sql(2)}), {_ngrams_sql(3)})"


@query("ngrams_multi", inputs.with_corpus(inputs.TOKENS_SQL + _shown_sql(MULTI_SQL, "tokens")))
def ngrams_multi(spark, folder):
    return _shown(token_table(inputs.corpus(spark, folder), TokenConfig(stop_words=None, ngrams=(1, 2, 3)), KEYS))


@query("ngrams_multi_distinct", inputs.with_corpus(inputs.TOKENS_SQL + _shown_sql(
    f"list_sort(list_distinct({MULTI_SQL}))", "tokens")))
def ngrams_multi_distinct(spark, folder):
    """Each n-gram of a document once, so that its counts are 0 or 1."""
    config = TokenConfig(stop_words=None, ngrams=(1, 2, 3), distinct=True)
    table = token_table(inputs.corpus(spark, folder), config, KEYS)
    return _shown(table.withColumn("tokens", F.sort_array("tokens")))


STEPS_SQL = f""",
tokens AS (SELECT doc_id, list_filter({inputs.words_sql(clean_sql('wiki'))}, lambda w: NOT list_contains({OWN_SQL}, w)) AS tokens
           FROM marked)"""


@query("token_steps", inputs.with_marked(STEPS_SQL + _shown_sql(
    f"list_concat(tokens, {_ngrams_sql(2)})", "tokens")))
def token_steps(spark, folder):
    """Markup removed, words cut, own stop words dropped, single words and 2-grams joined."""
    texts = clean(inputs.marked(spark, folder), "wiki")
    return _shown(token_table(texts, TokenConfig(stop_words=OWN_STOP_WORDS, ngrams=(1, 2)), KEYS))


@query("token_pipeline", inputs.with_marked(STEPS_SQL + _shown_sql(
    f"list_concat(tokens, {_ngrams_sql(2)})", "tokens")))
def token_pipeline(spark, folder):
    """The steps as a pipeline that was saved and loaded again."""
    path = new_table_path(spark)
    steps = TokenSteps.of(TokenConfig(stop_words=OWN_STOP_WORDS, ngrams=(1, 2)), "wiki")
    Pipeline(stages=[steps]).save(path)
    return _shown(Pipeline.load(path).fit(inputs.marked(spark, folder)).transform(inputs.marked(spark, folder)))


EXCEPTIONS = ("e.g.", "Mr.", "C++")
RULES_SQL = r"e\.g\.|Mr\.|C\+\+|(?:\p{L}\.){2,}|[$#€£]?\p{Nd}+(?:[.,:/]\p{Nd}+)*%?|\p{L}[\p{L}\p{M}\p{Nd}]*(?:['’]\p{L}[\p{L}\p{M}\p{Nd}]*)*|[^ \t\n\x0B\f\r]|[ \t\n\x0B\f\r]+"


@query("rule_tokens", inputs.with_marked(f""",
cut AS (SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(content || ' U.S. (a) well-known don''t, e.g. C++ $3.50', '{RULES_SQL.replace("'", "''")}') AS p FROM marked)),
placed AS (SELECT doc_id, piece, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS until FROM cut)
SELECT doc_id, count(*) AS n, string_agg(piece || '@' || CAST(until - length(piece) AS VARCHAR) || '-' || CAST(until AS VARCHAR), ' ' ORDER BY i) AS tokens
FROM placed WHERE NOT regexp_matches(piece, '^[ \\t\\n\\x0B\\f\\r]') GROUP BY doc_id"""))
def rule_tokens(spark, folder):
    """Tokens by rules, with their places; exceptions, initials, contractions, signs and hyphens are in every text."""
    more = F.concat("content", F.lit(" U.S. (a) well-known don't, e.g. C++ $3.50")).alias("content")
    cut = words.rule_tokens(inputs.marked(spark, folder).select("doc_id", more), exceptions=EXCEPTIONS)
    shown = F.transform("tokens", lambda one: F.format_string("%s@%d-%d", one["token"], one["begin"], one["end"]))
    return cut.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join(shown, " ").alias("tokens"))
