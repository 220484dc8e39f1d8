"""Line-first cleaning: rules for each line, failing lines go, documents that lose too much go.

A line fails if it neither ends like a sentence nor holds two, looks like navigation (separators between
short entries), is boilerplate (notices about cookies, rights, licences, sign-up), consists of
symbols or shouts. A document is rejected if less than `KEPT_SHARE` of the characters of its
words are in lines that pass. Base counts are computed beside the method.

Columns only: arrays inside the row, no shuffle, no Python. Repeated windows are found by
sorting the hashes of a text's windows inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\x0B\f\r]"
SYMBOLS = r"[#*$%&|<>]"
#: Share of the characters that must be in lines that pass.
KEPT_SHARE = 0.5
#: Words of a repeated window.
WINDOW = 5

# How a line ends that is a sentence, and phrases of boilerplate lines.
SENTENCE_END = r"[.!?:;…。！？][\"'”’»)\]]*[ \t\x0B\f\r]*$"
SENTENCES_INSIDE = r"[.!?] .*[.!?] "
BOILERPLATE = (
    r"(?i)cookie|all rights reserved|copyright|©|privacy policy|terms of (use|service)|javascript|"
    r"lorem ipsum|subscribe|sign up|log ?in|click here|read more|share this|licen[sc]ed under|released under"
)


def _share(line: Column, pattern: str) -> Column:
    """Characters of the line that match, of all that are no blanks; 0 for a blank line."""
    solid = F.length(F.regexp_replace(line, BLANKS, ""))
    return (F.length(line) - F.length(F.regexp_replace(line, pattern, ""))) / F.greatest(solid, F.lit(1))


def line_passes(line: Column) -> Column:
    """Whether a line passes all rules."""
    sentence = line.rlike(SENTENCE_END) | line.rlike(SENTENCES_INSIDE)
    navigation = F.length(line) - F.length(F.translate(line, "|»›•·", "")) >= 3
    boilerplate = line.rlike(BOILERPLATE)
    symbols = _share(line, SYMBOLS) > 0.1
    shouting = _share(line, r"\p{Lu}") > 0.6
    return sentence & ~navigation & ~boilerplate & ~symbols & ~shouting


def _windows(words: Column, size: int) -> Column:
    """Hashes of the runs of `size` words of an array of word hashes."""
    at = lambda i, k: F.element_at(words, i + k)
    places = F.sequence(F.lit(1), F.size(words) - (size - 1))
    return F.when(F.size(words) >= size, F.transform(places, lambda i: F.xxhash64(*[at(i, k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_share: float = KEPT_SHARE) -> DataFrame:
    """id, base counts, base_failed, kept, and the text that is left.

    Result: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    clean (lines that pass, joined by newlines). Null texts have no words and are rejected.
    Null ids and repeated rows are rows like any other. An empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANKS + "+"), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))
    rows = rows.select(
        "id", "text", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    rows = rows.withColumn("windows", _windows(F.col("hashes"), WINDOW))
    rows = rows.withColumn("several", F.size(F.array_distinct("windows")) < F.size("windows"))
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("ordered", F.when(F.col("several"), F.sort_array(pairs)))
    same = lambda k, x: F.coalesce(F.get(F.col("ordered"), k)["h"] == x["h"], F.lit(False))
    places = F.filter(
        F.transform("ordered", lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("places", F.sort_array(places))
    step = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("places"), k + 1) - p, F.lit(WINDOW))))
    n_repeat = F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x), F.lit(0))
    passed = F.filter("lines", line_passes)
    rows = rows.select(
        "id", "n_words", "word_chars",
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        F.array_join(passed, "\n").alias("clean"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.length(F.regexp_replace("clean", BLANKS, ""))
    return rows.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left >= kept_share * F.col("word_chars"))).alias("kept"), "clean",
    )
