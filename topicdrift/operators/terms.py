"""Term counts, vocabulary, inverse document frequency and weights in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lemmas import lemmas_of
from ..functions.tokens import ngrams
from ..runtime import BROADCAST_LIMIT_BYTES, broadcast_if_small, size_in_bytes, stored
from .corpus import running_total


def bag_of_words(df: DataFrame, keys: Sequence[str], tokens: str = "tokens", keep_empty: bool = False) -> DataFrame:
    """``(keys, term, tf)``: how often each term occurs in each row's token list.

    Counted inside the row: sort the list, find where a new term starts, and take the
    distance to the next start. Nothing is shuffled. ``keep_empty`` keeps a row without
    tokens as one row of NULL term and count.
    """
    keys = list(keys)
    ordered = df.select(*keys, F.sort_array(tokens).alias("_words"))
    starts = F.expr(
        "if(size(_words) > 0, "
        "filter(sequence(0, size(_words) - 1), i -> i = 0 or _words[i] <> _words[i - 1]), array())"
    )
    runs = F.expr(
        "transform(_starts, (start, i) -> named_struct('term', _words[start], "
        "'tf', cast(coalesce(get(_starts, i + 1), size(_words)) - start as bigint)))"
    )
    explode = F.explode_outer if keep_empty else F.explode
    exploded = ordered.withColumn("_starts", starts).select(*keys, explode(runs).alias("_run"))
    return exploded.select(*keys, "_run.term", "_run.tf")


def grouped_bag(bag: DataFrame, group: Sequence[str]) -> DataFrame:
    """Bags added up per group: the bag of the group's joined texts, without joining them."""
    return bag.groupBy(*group, "term").agg(F.sum("tf").alias("tf"))


def term_statistics(bag: DataFrame) -> DataFrame:
    """``(term, n, df)``: occurrences and documents of each term; partial sums before the shuffle."""
    bag = bag.where(F.col("term").isNotNull())
    return bag.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


def ngram_statistics(lists: DataFrame, wanted: Sequence[tuple[str, int]]) -> DataFrame:
    """``(term, size, counts)``: statistics of the n-grams of several token lists, for many settings at once.

    ``wanted`` names pairs of a list column and a size. ``counts`` has, for each list column, a struct
    of occurrences ``n`` and documents ``df``, NULL where the list has no such term. All pairs
    share a pass over the rows and a shuffle, in which a term that several lists hold is one row. See
    `setting_statistics`.
    """
    pairs = [
        F.struct(F.lit(form).alias("form"), F.lit(size).alias("size"), ngrams(F.col(form), size).alias("tokens"))
        for form, size in dict.fromkeys(wanted)
    ]
    bag = bag_of_words(lists.select(F.inline(F.array(*pairs))), ["form", "size"])

    def counted(form: str) -> Column:
        own = F.col("form") == form
        df = F.count_if(own)
        return F.when(df > 0, F.struct(F.sum(F.when(own, F.col("tf"))).alias("n"), df.alias("df"))).alias(form)

    forms = dict.fromkeys(form for form, _ in wanted)
    return bag.groupBy("term", "size").agg(F.struct(*map(counted, forms)).alias("counts"))


def setting_statistics(shared: DataFrame, form: str, sizes: Sequence[int], distinct: bool = False) -> DataFrame:
    """`term_statistics` of one setting: n-grams of ``sizes`` of one list, out of those of all settings.

    ``distinct``: an entry counts once in a row, so occurrences are documents.
    """
    own = shared.where(F.col("size").isin(*sizes) & F.col(f"counts.{form}").isNotNull())
    return own.select("term", F.col(f"counts.{form}.{'df' if distinct else 'n'}").alias("n"), F.col(f"counts.{form}.df").alias("df"))


def vocabulary(statistics: DataFrame, min_df: int = 1, *, size: int | None) -> DataFrame:
    """Terms in at least ``min_df`` documents: ``(term_id, term, n, df)``.

    Ids follow falling ``n``, ties by term. ``size`` keeps the most frequent terms only;
    ``None`` keeps all. Ids come from range partitions and their offsets, so that no task
    holds more than a slice however many distinct terms there are.
    """
    kept = statistics.where(F.col("df") >= min_df)
    ranked = kept.select((-F.col("n")).alias("_fall"), "term", F.lit(1).cast("bigint").alias("_one"), "n", "df")
    numbered = running_total(ranked, "_one", [], ["_fall", "term"], "_place", ["n", "df"])
    listed = numbered.select((F.col("_place") - 1).cast("int").alias("term_id"), "term", "n", "df")
    return listed if size is None else listed.where(F.col("term_id") < size)


def vocabulary_sizes(statistics: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """``(min_df, terms)`` for all thresholds in one pass."""
    counts = [F.count_if(F.col("df") >= least) for least in thresholds]
    pairs = [F.struct(F.lit(least).alias("min_df"), n.alias("terms")) for least, n in zip(thresholds, counts)]
    return statistics.agg(F.array(*pairs).alias("_pairs")).select(F.inline("_pairs"))


def document_count(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery; reads no text."""
    return df.agg(F.count("*")).scalar()


def idf_weight(document_frequency: Column, documents: Column) -> Column:
    return F.log((documents + 1) / (document_frequency + 1))


def idf(terms: DataFrame, documents: Column) -> DataFrame:
    """``terms`` with their inverse document frequency; ``documents`` counts empty ones too."""
    return terms.withColumn("idf", idf_weight(F.col("df"), documents))


def tfidf(bag: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, term, tfidf)`` for terms of the vocabulary.

    The vocabulary is broadcast if it measures small, so the bag stays where it is.
    """
    listed = broadcast_if_small(weights.select("term", "idf"))
    return bag.join(listed, "term").select(*keys, "term", (F.col("tf") * F.col("idf")).alias("tfidf"))


def top_terms(weighted: DataFrame, group: Sequence[str], weight: str, n: int = 10) -> DataFrame:
    """The ``n`` heaviest terms per group: ``(group, rank, term, weight)``; ties by term."""
    heaviest = Window.partitionBy(*group).orderBy(F.desc(weight), "term")
    ranked = weighted.withColumn("rank", F.row_number().over(heaviest)).where(F.col("rank") <= n)
    return ranked.select(*group, "rank", "term", weight)


def lemmatize(
    df: DataFrame, lemmas: DataFrame, keys: Sequence[str], tokens: str = "tokens"
) -> DataFrame:
    """Tokens replaced by their lemma from a table ``(form, lemma)``; others stay.

    ``keys`` identify a row; it comes back with the keys and its list in order. A table that
    measures small is looked up inside each batch, each distinct word once, without a shuffle;
    a larger one is joined.
    """
    keys = list(keys)
    one_each = stored(lemmas.groupBy("form").agg(F.min("lemma").alias("lemma")))
    if size_in_bytes(one_each) <= BROADCAST_LIMIT_BYTES:
        return df.select(*keys, lemmas_of({row["form"]: row["lemma"] for row in one_each.collect()})(tokens).alias(tokens))
    words = df.select(*keys, F.posexplode_outer(tokens).alias("_position", "form"))
    named = words.join(one_each, "form", "left").select(*keys, "_position", F.coalesce("lemma", "form").alias("_word"))
    word = F.when(F.col("_word").isNotNull(), F.struct("_position", "_word"))
    in_order = F.transform(F.array_sort(F.collect_list(word)), lambda row: row["_word"])
    return named.groupBy(*keys).agg(in_order.alias(tokens))
