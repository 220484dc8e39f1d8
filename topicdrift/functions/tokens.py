"""Token arrays from texts, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F

SHRINK = "shrink"
DISABLED = "disabled"


def shrink(text: Column) -> Column:
    """Runs of blanks become one blank; none at either end."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokenize(text: Column, lowercase: bool = True, punctuation: str = "split") -> Column:
    """Words made of letters only.

    ``split``: anything that is neither letter nor blank ends a word (``don't`` gives
    ``don``, ``t``). ``join``: such characters vanish inside a word (``dont``).
    """
    if punctuation not in ("split", "join"):
        raise ValueError(f"punctuation must be 'split' or 'join', not {punctuation!r}")
    if punctuation == "join":
        text = F.regexp_replace(text, r"(?U)[^\p{L}\s]+", "")
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))
    return F.transform(words, F.lower) if lowercase else words


def english_stop_words() -> list[str]:
    """Spark's English list; needs a running session."""
    return StopWordsRemover.loadDefaultStopWords("english")


def remove_stop_words(tokens: Column, stop_words: Iterable[str]) -> Column:
    """Tokens outside the list, which is matched ignoring case."""
    listed = sorted({word.lower() for word in stop_words})
    return F.filter(tokens, lambda word: ~F.lower(word).isin(listed)) if listed else tokens


def ngrams(tokens: Column, n: int) -> Column:
    """Every ``n`` neighbouring tokens joined by a blank; empty for shorter lists."""
    if n == 1:
        return tokens
    starts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))

    def joined(word: Column, i: Column) -> Column:
        following = [F.get(tokens, i + step) for step in range(1, n)]
        plain = F.concat(word, *[part for one in following for part in (F.lit(" "), one)])
        # Joining with a separator passes over NULL words, but costs more.
        return F.coalesce(plain, F.concat_ws(" ", word, *following))

    return F.transform(starts, joined)


def combined_ngrams(tokens: Column, sizes: Sequence[int], distinct: bool = False) -> Column:
    """All n-grams of several sizes in one list, smallest list first as given."""
    lists = [ngrams(tokens, n) for n in sizes]
    joined = lists[0] if len(lists) == 1 else F.concat(*lists)
    return F.array_distinct(joined) if distinct else joined


# A cut into tokens by rules, the first that fits at a place decides: exceptions, initials with
# their points (U.S.), numbers with a sign before and parts inside ($3.50, 12:30, 40%), words with
# apostrophes inside (don't), any other character that is no blank by itself.
BLANK = r"[ \t\n\x0B\f\r]"
INITIALS = r"(?:\p{L}\.){2,}"
NUMBER = r"[$#€£]?\p{Nd}+(?:[.,:/]\p{Nd}+)*%?"
LETTERS = r"\p{L}[\p{L}\p{M}\p{Nd}]*"
INSIDE = {"split": "['’]", "join": "['’-]"}


def rule_pattern(exceptions: Sequence[str] = (), hyphens: str = "split") -> str:
    """The rules as one pattern. Exceptions stand as they are, longest first; they end where no letter or digit follows."""
    if hyphens not in INSIDE:
        raise ValueError(f"hyphens must be 'split' or 'join', not {hyphens!r}")
    listed = [
        re.sub(r"([^\w\s])", r"\\\1", word) + (r"(?![\p{L}\p{Nd}])" if word[-1].isalnum() else "")
        for word in sorted(set(exceptions), key=lambda word: (-len(word), word))
    ]
    return "|".join([*listed, INITIALS, NUMBER, f"{LETTERS}(?:{INSIDE[hyphens]}{LETTERS})*", r"[^ \t\n\x0B\f\r]"])


def rule_tokens(
    df: DataFrame, text: str = "content", tokens: str = "tokens", exceptions: Sequence[str] = (), hyphens: str = "split"
) -> DataFrame:
    """``df`` with ``tokens``, an array of ``(token, begin, end)`` cut by rules.

    ``begin`` and ``end`` are places in characters, the end not included, so that a token is the text
    between them. ``hyphens``: ``"split"`` gives ``well``, ``-``, ``known``, ``"join"`` gives ``well-known``.
    NULL texts give NULL. Native expressions; places are running sums over runs of lengths.
    """
    pattern = f"{rule_pattern(exceptions, hyphens)}|{BLANK}+"
    pieces = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    # Pieces whose lengths are added up together: with n to the power of 1/3, adding inside runs and adding runs up cost the same.
    run = F.greatest(F.lit(1), F.ceil(F.cbrt(F.size("_pieces"))).cast("int"))
    # Generators keep the arrays, which lambdas read again and again, from being computed inside these.
    cut = df.withColumn("_pieces", F.explode(F.array(pieces)))
    pieces = F.col("_pieces")
    cut = cut.withColumn("_cut", F.explode(F.array(F.struct(pieces.alias("pieces"), F.transform(pieces, F.length).alias("lengths"), run.alias("run")))))
    add = "0, (total, n) -> total + n"
    sums = (
        f"transform(filter(sequence(0, size(_cut.lengths)), i -> i % _cut.run = 0), "
        f"i -> aggregate(slice(_cut.lengths, i + 1, _cut.run), {add}))"
    )
    cut = cut.withColumn("_sums", F.explode(F.array(F.expr(sums))))
    cut = cut.withColumn("_starts", F.explode(F.array(F.expr(f"transform(_sums, (n, i) -> aggregate(slice(_sums, 1, i), {add}))"))))
    placed = F.expr(
        f"transform(_cut.pieces, (piece, i) -> named_struct('token', piece, 'begin', "
        f"_starts[cast(i div _cut.run as int)] + aggregate(slice(_cut.lengths, cast(i div _cut.run as int) * _cut.run + 1, i % _cut.run), {add})))"
    )
    kept = F.filter(placed, lambda one: ~one["token"].rlike(f"^{BLANK}"))
    ended = F.transform(kept, lambda one: F.struct(one["token"].alias("token"), one["begin"].alias("begin"), (one["begin"] + F.length(one["token"])).alias("end")))
    return cut.withColumn(tokens, ended).drop("_pieces", "_cut", "_sums", "_starts")
