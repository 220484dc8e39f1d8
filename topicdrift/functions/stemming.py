"""English stemming by the algorithm of M. F. Porter, "An algorithm for suffix
stripping", Program 14(3), 1980."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Executors get the helpers of this module with the query; nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The suffix tables of the paper, (suffix, replacement).
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP_4 = (
    ("al", ""), ("ance", ""), ("ence", ""), ("er", ""), ("ic", ""), ("able", ""), ("ible", ""),
    ("ant", ""), ("ement", ""), ("ment", ""), ("ent", ""), ("ion", ""), ("ou", ""), ("ism", ""),
    ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""),
)


def _shape(word: str) -> str:
    """One letter per letter: "v" for vowels, "c" for consonants; y counts as a vowel after a consonant."""
    shape = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and shape[-1:] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _has_vowel(word: str) -> bool:
    return "v" in _shape(word)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_ending(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last one not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _strip(word: str, table: tuple, least_measure: int) -> str:
    """Replace the longest suffix of the table if what precedes it is long enough."""
    fitting = [pair for pair in table if word.endswith(pair[0])]
    if not fitting:
        return word
    suffix, replacement = max(fitting, key=lambda pair: len(pair[0]))
    rest = word[: -len(suffix)]
    if suffix == "ion" and rest[-1:] not in ("s", "t"):
        return word
    return rest + replacement if _measure(rest) >= least_measure else word


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past_or_progressive(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    rest = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else None
    if rest is None or not _has_vowel(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _double_consonant(rest) and rest[-1] not in "lsz":
        return rest[:-1]
    return rest + "e" if _measure(rest) == 1 and _short_ending(rest) else rest


def _final_e_and_l(word: str) -> str:
    if word.endswith("e"):
        rest = word[:-1]
        measure = _measure(rest)
        if measure > 1 or (measure == 1 and not _short_ending(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def porter_stem(word: str) -> str:
    """Stem of one word, in lower case; words of one or two letters stay as they are."""
    word = word.lower()
    if len(word) < 3:
        return word
    word = _past_or_progressive(_plural(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _strip(_strip(_strip(word, STEP_2, 1), STEP_3, 1), STEP_4, 2)
    return _final_e_and_l(word)


def map_distinct(lists: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """Lists of changed words: each distinct word of the batch is changed once; the rest is Arrow index work."""
    coded = lists.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    changed = pa.array([change(word) for word in known], pa.string()).take(coded.indices)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), changed, mask=lists.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    return map_distinct(tokens, porter_stem)
