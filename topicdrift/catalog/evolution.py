"""Topic shares by year and title, with word-length shares standing in for a model's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coherence, evolution, terms
from ..runtime import stored
from . import inputs
from .registry import query

# Shares of words with up to 3, up to 6, up to 9 and more letters: four "topics" per document.
LIMITS = ((1, 3), (4, 6), (7, 9), (10, 1000000))
K = len(LIMITS)

SHARES_SQL = inputs.TOKENS_SQL + ",\nshares AS (SELECT doc_id, title, year, [" + ", ".join(
    f"len(list_filter(tokens, lambda w: length(w) BETWEEN {low} AND {high})) / nullif(len(tokens), 0)" for low, high in LIMITS
) + "] AS shares FROM tokens),\nlong AS (SELECT doc_id, title, year, unnest(shares) AS share, generate_subscripts(shares, 1) - 1 AS topic FROM shares)"


def shares(spark, folder):
    # No filter on the token lists: it would be moved down and cut the texts a second time.
    words = inputs.tokens(spark, folder, "title", "year")
    parts = [
        F.try_divide(F.size(F.expr(f"filter(tokens, word -> length(word) BETWEEN {low} AND {high})")), F.size("tokens"))
        for low, high in LIMITS
    ]
    return words.select("doc_id", "title", "year", F.array(*parts).alias("shares"))


@query("topic_long", """
SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS topic,
       round(CAST(unnest(embedding) AS DOUBLE), 6) AS share FROM embeddings""")
def topic_long(spark, folder):
    long = evolution.topic_long(inputs.table(spark, folder, "embeddings"), "embedding", ["vec_id", "label"])
    return long.select("vec_id", "label", F.col("topic").cast("bigint"), F.round(F.col("share").cast("double"), 6).alias("share"))


DAYS_SQL = "SELECT CAST(day(ts) AS BIGINT) AS day, event_type, value FROM events"


@query("prevalence_sum", f"""
SELECT day, event_type, round(sum(value), 4) AS total FROM ({DAYS_SQL}) GROUP BY ALL""")
def prevalence_sum(spark, folder):
    events = inputs.table(spark, folder, "events").withColumn("day", F.dayofmonth("ts").cast("bigint"))
    totals = evolution.prevalence_sum(events, ["day"], "event_type", "value")
    return totals.withColumn("total", F.round("total", 4))


@query("prevalence_share", f"""
SELECT day, event_type, round(sum(value) / sum(sum(value)) OVER (PARTITION BY day), 6) AS share
FROM ({DAYS_SQL}) GROUP BY day, event_type""")
def prevalence_share(spark, folder):
    events = inputs.table(spark, folder, "events").withColumn("day", F.dayofmonth("ts").cast("bigint"))
    shared = evolution.prevalence_share(evolution.prevalence_sum(events, ["day"], "event_type", "value"), ["day"])
    return shared.select("day", "event_type", F.round("share", 6).alias("share"))


@query("prevalence_by_year", inputs.with_corpus(SHARES_SQL + """
SELECT year, topic, round(sum(share), 6) AS total, round(sum(share) / sum(sum(share)) OVER (PARTITION BY year), 6) AS share
FROM long GROUP BY year, topic"""))
def prevalence_by_year(spark, folder):
    """Totals straight from the arrays, and their shares of the year."""
    mass = evolution.topic_mass(shares(spark, folder), "shares", ["year"], K)
    shared = evolution.prevalence_share(mass, ["year"])
    return shared.select("year", F.col("topic").cast("bigint"), F.round("total", 6).alias("total"), F.round("share", 6).alias("share"))


@query("prevalence_pivot", inputs.with_corpus(SHARES_SQL + """,
totals AS (SELECT year, topic, sum(share) / sum(sum(share)) OVER (PARTITION BY year) AS share FROM long GROUP BY year, topic)
SELECT year, """ + ", ".join(f"round(max(share) FILTER (topic = {i}), 6) AS topic_{i}" for i in range(K)) + """
FROM totals GROUP BY year ORDER BY year"""))
def prevalence_pivot(spark, folder):
    """Year by topic, the heatmap's matrix."""
    mass = evolution.topic_mass(shares(spark, folder), "shares", ["year"], K)
    wide = evolution.prevalence_pivot(evolution.prevalence_share(mass, ["year"]), ["year"], "topic", range(K))
    return wide.select("year", *[F.round(f"topic_{i}", 6).alias(f"topic_{i}") for i in range(K)])


CHARTED = ("src0_en", "src3_en", "src5_de", "src8_fr")


@query("title_trajectory", inputs.with_corpus(SHARES_SQL + f"""
SELECT title, year, doc_id, {', '.join(f'round(shares[{i + 1}], 6) AS topic_{i}' for i in range(K))}
FROM shares WHERE title IN ({', '.join(f"'{title}'" for title in CHARTED)}) ORDER BY title, year, doc_id"""))
def title_trajectory(spark, folder):
    """Documents of the chosen titles, one column per topic, the stacked bars' table."""
    rows = evolution.title_trajectory(shares(spark, folder), CHARTED, "shares", K, ("title", "year", "doc_id"))
    return rows.select("title", "year", "doc_id", *[F.round(f"topic_{i}", 6).alias(f"topic_{i}") for i in range(K)])


# Topics without a model: the ten most frequent words of each language.
TOPICS_SQL = inputs.WORDS_SQL + """,
ranked AS (SELECT lang AS topic, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS rank
           FROM words GROUP BY lang, term),
topics AS (SELECT topic, rank, term FROM ranked WHERE rank <= 10)"""

# Windows by plain interval arithmetic: each occurrence covers a run of window starts,
# runs that touch are merged, and pairs of runs that overlap are added up.
WINDOWS_SQL = TOPICS_SQL + f""",
positions AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS p FROM tokens),
covered AS (SELECT doc_id, term, p, greatest(p - {coherence.WINDOW} + 1, 0) AS s, least(p, greatest(n - {coherence.WINDOW}, 0)) AS e
            FROM positions WHERE term IN (SELECT term FROM topics)),
flagged AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY doc_id, term ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
                      THEN 1 ELSE 0 END AS gap FROM covered),
islands AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, term ORDER BY p) AS island FROM flagged),
runs AS (SELECT doc_id, term, min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, term, island),
pairs AS (SELECT x.topic, x.term AS a, y.term AS b FROM topics x JOIN topics y ON x.topic = y.topic AND x.term <= y.term),
met AS (SELECT x.term AS a, y.term AS b, sum(least(x.e, y.e) - greatest(x.s, y.s) + 1) AS n
        FROM runs x JOIN runs y ON x.doc_id = y.doc_id AND x.s <= y.e AND y.s <= x.e AND x.term <= y.term
        WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.a = x.term AND p.b = y.term) GROUP BY ALL),
counts AS (SELECT topic, a, b, CAST(coalesce(n, 0) AS BIGINT) AS n FROM pairs LEFT JOIN met USING (a, b)),
total AS (SELECT sum(greatest(len(tokens) - {coherence.WINDOW}, 0) + 1) AS windows FROM tokens WHERE len(tokens) > 0)"""
SCORES_SQL = WINDOWS_SQL + """,
shares AS (SELECT c.topic, c.a, c.b, c.n / t.windows AS joint, x.n / t.windows AS pa, y.n / t.windows AS pb
           FROM counts c JOIN counts x ON x.topic = c.topic AND x.a = c.a AND x.b = c.a
           JOIN counts y ON y.topic = c.topic AND y.a = c.b AND y.b = c.b CROSS JOIN total t),
scores AS (SELECT topic, a, b, CASE WHEN pa = 0 OR pb = 0 THEN 0.0 WHEN joint = 1 THEN 1.0
           ELSE ln((joint + 1e-12) / (pa * pb)) / -ln(joint + 1e-12) END AS npmi FROM shares)"""


def _tokens_and_topics(spark, folder):
    """Token lists, kept as a table because several passes read them, and the topics."""
    documents = stored(inputs.tokens(spark, folder, "lang"))
    counted = terms.grouped_bag(terms.bag_of_words(documents, ["lang"]), ["lang"])
    topics = stored(terms.top_terms(counted, ["lang"], "tf").withColumnRenamed("lang", "topic"))
    return documents, topics


@query("window_cooccurrence", inputs.with_corpus(WINDOWS_SQL + "\nSELECT * FROM counts"))
def window_cooccurrence(spark, folder):
    return coherence.window_cooccurrence(*_tokens_and_topics(spark, folder), "doc_id")


@query("npmi", inputs.with_corpus(SCORES_SQL + "\nSELECT topic, a, b, round(npmi, 6) AS npmi FROM scores"))
def npmi(spark, folder):
    documents, topics = _tokens_and_topics(spark, folder)
    counts = coherence.window_cooccurrence(documents, topics, "doc_id")
    return coherence.npmi(counts, coherence.window_total(documents)).withColumn("npmi", F.round("npmi", 6))


@query("coherence_cv", inputs.with_corpus(SCORES_SQL + """,
whole AS (SELECT * FROM scores UNION ALL SELECT topic, b, a, npmi FROM scores WHERE a <> b),
sums AS (SELECT topic, b, sum(npmi) AS v FROM whole GROUP BY topic, b),
cosines AS (SELECT w.topic, w.a, sum(npmi * v) / (sqrt(sum(npmi * npmi)) * sqrt(sum(v * v))) AS cosine
            FROM whole w JOIN sums s ON w.topic = s.topic AND w.b = s.b GROUP BY w.topic, w.a)
SELECT topic, round(avg(cosine), 6) AS coherence FROM cosines GROUP BY topic"""))
def coherence_cv(spark, folder):
    scored = coherence.coherence_cv(*_tokens_and_topics(spark, folder), "doc_id")
    return scored.withColumn("coherence", F.round("coherence", 6))
