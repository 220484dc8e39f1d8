"""Sliding-window topic coherence "c_v" (Roeder, Both, Hinneburg: Exploring the Space of
Topic Coherence Measures, WSDM 2015) over a token table.

Windows are never listed. For each topic the set of its terms inside the window changes
only where a term enters or leaves. The set is a bit mask in as many words as the longest
topic needs. Stretches between changes with one mask are added up, partly before the
shuffle; a mask then gives its pairs of terms, which are added up by topic and pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import BROADCAST_LIMIT_BYTES, size_in_bytes

WINDOW = 110
EPSILON = 1e-12
WORD_BITS = 62
# Distinct topic terms up to which they are looked for inside the row.
LITERAL_TERMS = 10_000


def _term_lists(topics: DataFrame) -> DataFrame:
    """``(topic, terms)``: the distinct terms of each topic, sorted; their places number them."""
    return topics.groupBy("topic").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def window_total(documents: DataFrame, tokens: str = "tokens", window: int = WINDOW) -> DataFrame:
    """One row ``windows``: a document shorter than the window is one, an empty one none."""
    length = F.size(tokens)
    count = F.when(length > 0, F.greatest(length - window, F.lit(0)) + 1).otherwise(0)
    return documents.agg(F.coalesce(F.sum(count.cast("bigint")), F.lit(0)).alias("windows"))


def _occurrences(documents: DataFrame, listed: DataFrame, key: str, tokens: str, window: int) -> DataFrame:
    """``(key, _last, _at, term)``: places of topic terms; other tokens never leave the row.

    Very long lists of terms are joined instead, broadcast if they measure small.
    """
    last_start = F.greatest(F.size(tokens) - window, F.lit(0)).alias("_last")
    places = F.transform(tokens, lambda term, at: F.struct(at.alias("_at"), term.alias("term")))
    terms = listed.select("term").distinct()
    if terms.limit(LITERAL_TERMS + 1).count() <= LITERAL_TERMS:
        words = [row["term"] for row in terms.collect()]
        inside = F.filter(places, lambda place: place["term"].isin(words))
        return documents.select(key, last_start, F.inline(inside))
    small = F.broadcast if size_in_bytes(terms) <= BROADCAST_LIMIT_BYTES else lambda df: df
    return documents.select(key, last_start, F.inline(places)).join(small(terms), "term", "left_semi")


def window_masks(
    documents: DataFrame, topics: DataFrame, key: str, tokens: str = "tokens", window: int = WINDOW
) -> DataFrame:
    """``(topic, masks, n)``: number of windows that hold exactly the topic terms of the masks.

    Bit ``p % 62`` of word ``p / 62`` stands for the term with place ``p`` in the topic's sorted
    list. ``topics`` is the small side (topics x terms), broadcast if it measures so. Only
    occurrences of topic terms are shuffled, once, by document.
    """
    listed = topics.select("topic", "term")
    small = F.broadcast if size_in_bytes(listed) <= BROADCAST_LIMIT_BYTES else lambda df: df
    lists = _term_lists(topics)
    longest = lists.agg(F.max(F.size("terms"))).first()[0] or 1
    words = [f"_word{i}" for i in range(-(-longest // WORD_BITS))]
    numbered = lists.select("topic", F.posexplode("terms").alias("_place", "term"))
    occurrences = _occurrences(documents, listed, key, tokens, window).repartition(key)
    # An occurrence lies in the windows starting at _first.._final. Neighbours of the
    # same term that touch form one stretch: only its two ends matter.
    first = F.greatest(F.col("_at") - (window - 1), F.lit(0))
    final = F.least(F.col("_at"), F.col("_last"))
    along = Window.partitionBy(key, "term").orderBy("_at")
    stretches = (
        occurrences.select(key, "term", "_at", first.alias("_first"), final.alias("_final"))
        .withColumn("_enters", F.coalesce(F.lag("_final").over(along) + 1 < F.col("_first"), F.lit(True)))
        .withColumn("_leaves", F.coalesce(F.lead("_first").over(along) > F.col("_final") + 1, F.lit(True)))
        .where("_enters or _leaves")
    )
    changes = stretches.join(small(numbered), "term").select(
        key,
        "topic",
        "_place",
        F.inline(
            F.array(
                F.struct(F.col("_first").alias("_start"), F.when(F.col("_enters"), F.lit(1)).alias("_sign")),
                F.struct((F.col("_final") + 1).alias("_start"), F.when(F.col("_leaves"), F.lit(-1)).alias("_sign")),
            )
        ),
    ).where(F.col("_sign").isNotNull())
    starts = Window.partitionBy(key, "topic").orderBy("_start")
    upto = starts.rowsBetween(Window.unboundedPreceding, 0)
    bit = F.expr(f"shiftleft(1L, _place % {WORD_BITS})")
    here = [F.when(F.floor(F.col("_place") / WORD_BITS) == i, bit * F.col("_sign")).otherwise(0) for i in range(len(words))]
    spans = changes.select(
        "topic",
        *[F.sum(word).over(upto).alias(name) for word, name in zip(here, words)],
        (F.lead("_start").over(starts) - F.col("_start")).cast("bigint").alias("_span"),
    )
    held = spans.where(F.col("_span") > 0).where(" or ".join(f"{name} > 0" for name in words))
    return held.groupBy("topic", *words).agg(F.sum("_span").alias("n")).select("topic", F.array(*words).alias("masks"), "n")


def window_cooccurrence(
    documents: DataFrame, topics: DataFrame, key: str, tokens: str = "tokens", window: int = WINDOW
) -> DataFrame:
    """``(topic, a, b, n)``: windows that hold both terms, for all pairs ``a <= b`` of a topic.

    ``a = b`` counts the windows with that term; pairs that never meet have ``n = 0``.
    """
    masks = window_masks(documents, topics, key, tokens, window)
    lists = _term_lists(topics)
    small = F.broadcast if size_in_bytes(topics.select("topic", "term")) <= BROADCAST_LIMIT_BYTES else lambda df: df
    bit_set = f"shiftright(element_at(masks, cast(p div {WORD_BITS} as int) + 1), cast(p % {WORD_BITS} as int)) & 1 = 1"
    present = F.expr(f"transform(filter(sequence(0, size(terms) - 1), p -> {bit_set}), p -> terms[p])")
    held = masks.join(small(lists), "topic").select("topic", "n", present.alias("present"))
    paired = held.select("topic", "n", "present", F.posexplode("present").alias("_i", "a"))
    paired = paired.select("topic", "n", "a", F.explode(F.expr("slice(present, _i + 1, size(present))")).alias("b"))
    met = paired.groupBy("topic", "a", "b").agg(F.sum("n").alias("n"))
    first = lists.select("topic", "terms", F.posexplode("terms").alias("_i", "a"))
    pairs = first.select("topic", "a", F.explode(F.expr("slice(terms, _i + 1, size(terms))")).alias("b"))
    return pairs.join(met, ["topic", "a", "b"], "left").select("topic", "a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def npmi(counts: DataFrame, total: DataFrame) -> DataFrame:
    """``(topic, a, b, npmi)`` from pair counts and the one-row number of windows.

    A pair with a term that never occurs scores 0, a pair in every window 1.
    """
    alone = F.when(F.col("a") == F.col("b"), F.col("n"))
    known = counts.select(
        "topic", "a", "b", "n",
        F.max(alone).over(Window.partitionBy("topic", "a")).alias("_n_a"),
        F.max(alone).over(Window.partitionBy("topic", "b")).alias("_n_b"),
        total.scalar().cast("double").alias("_windows"),
    )
    both = F.col("n") / F.col("_windows")
    apart = (F.col("_n_a") / F.col("_windows")) * (F.col("_n_b") / F.col("_windows"))
    score = (
        F.when((F.col("_n_a") == 0) | (F.col("_n_b") == 0), F.lit(0.0))
        .when(F.col("n") == F.col("_windows"), F.lit(1.0))
        .otherwise(F.log((both + EPSILON) / apart) / -F.log(both + EPSILON))
    )
    return known.select("topic", "a", "b", score.alias("npmi"))


def topic_coherence(scores: DataFrame) -> DataFrame:
    """``(topic, coherence)``: mean cosine between each term's vector and their sum."""
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    directions = F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back))
    full = scores.select("topic", "npmi", F.inline(directions))
    column_sum = F.sum("npmi").over(Window.partitionBy("topic", "b"))
    summed = full.withColumn("_sum", column_sum)
    norms = F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))) * F.sqrt(F.sum(F.col("_sum") * F.col("_sum")))
    cosine = F.coalesce(F.try_divide(F.sum(F.col("npmi") * F.col("_sum")), norms), F.lit(0.0))
    per_term = summed.groupBy("topic", "a").agg(cosine.alias("_cosine"))
    return per_term.groupBy("topic").agg(F.avg("_cosine").alias("coherence"))


def coherence_cv(
    documents: DataFrame, topics: DataFrame, key: str, tokens: str = "tokens", window: int = WINDOW
) -> DataFrame:
    """``(topic, coherence)`` of topics given as ``(topic, term)`` over a token table.

    The score of a model is the mean over its topics. ``key`` identifies a document.
    """
    counts = window_cooccurrence(documents, topics, key, tokens, window)
    return topic_coherence(npmi(counts, window_total(documents, tokens, window)))
