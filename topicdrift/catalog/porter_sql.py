"""The stemming algorithm written once more, as SQL over a table of distinct words.

It checks ``functions.stemming`` and shares no code with it: conditions are regular
expressions over words whose vowels were replaced by 1 and whose other letters by 0.
"""

from __future__ import annotations

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
    ("al", ""), ("ance", ""), ("ence", ""), ("er", ""), ("ic", ""),
    ("able", ""), ("ible", ""), ("ant", ""), ("ement", ""), ("ment", ""),
    ("ent", ""), ("ion", ""), ("ou", ""), ("ism", ""), ("ate", ""),
    ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""),
)

# y is a vowel after a consonant; a run of y alternates.
SHAPE = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({},"
    " '^y', 'C'), '([aeiou])y', '\\1C', 'g'), '([^aeiouyC]|C)yy', '\\1VC', 'g'), '[aeiouyV]', '1', 'g'), '[^1]', '0', 'g')"
)


def _shape(word: str) -> str:
    return SHAPE.format(word)


def _least(word: str, measure: int) -> str:
    return f"regexp_matches({_shape(word)}, '^0*(1+0+){{{measure}}}')"


def _is_one(word: str) -> str:
    return f"regexp_matches({_shape(word)}, '^0*1+0+1*$')"


def _short(word: str) -> str:
    return f"(regexp_matches({_shape(word)}, '010$') AND right({word}, 1) NOT IN ('w', 'x', 'y'))"


def _double(word: str) -> str:
    return f"(length({word}) > 1 AND right({word}, 1) = substr({word}, length({word}) - 1, 1) AND {_shape(word)} LIKE '%0')"


def _cut(word: str, length: int) -> str:
    return f"substr({word}, 1, length({word}) - {length})"


def _table(listed: tuple, measure: int) -> str:
    """One CASE over a suffix table: the longest suffix that fits decides."""
    pairs = sorted(listed, key=lambda pair: -len(pair[0]))
    cases = []
    for suffix, replacement in pairs:
        rest = _cut("w", len(suffix))
        condition = _least(rest, measure)
        if suffix == "ion":
            condition += f" AND right({rest}, 1) IN ('s', 't')"
        cases.append(f"WHEN w LIKE '%{suffix}' THEN CASE WHEN {condition} THEN {rest} || '{replacement}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def stem_sql(words: str, prefix: str = "") -> str:
    """Common table expressions ending in ``<prefix>stems (term, stem)`` for a query of ``term``."""
    has_vowel = "regexp_matches({}, '1')"
    step_1a = f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_cut('w', 2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {_cut('w', 1)} ELSE w END"
    ends = (
        f"CASE WHEN w LIKE '%eed' THEN NULL"
        f" WHEN w LIKE '%ed' AND {has_vowel.format(_shape(_cut('w', 2)))} THEN {_cut('w', 2)}"
        f" WHEN w LIKE '%ing' AND {has_vowel.format(_shape(_cut('w', 3)))} THEN {_cut('w', 3)} END"
    )
    step_1b = (
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {_least(_cut('w', 3), 1)} THEN {_cut('w', 1)} ELSE w END"
        f" WHEN r IS NULL THEN w"
        f" WHEN r LIKE '%at' OR r LIKE '%bl' OR r LIKE '%iz' THEN r || 'e'"
        f" WHEN {_double('r')} AND right(r, 1) NOT IN ('l', 's', 'z') THEN {_cut('r', 1)}"
        f" WHEN {_is_one('r')} AND {_short('r')} THEN r || 'e' ELSE r END"
    )
    step_1c = f"CASE WHEN w LIKE '%y' AND {has_vowel.format(_shape(_cut('w', 1)))} THEN {_cut('w', 1)} || 'i' ELSE w END"
    rest = _cut("w", 1)
    step_5a = f"CASE WHEN w LIKE '%e' AND ({_least(rest, 2)} OR ({_least(rest, 1)} AND NOT {_short(rest)})) THEN {rest} ELSE w END"
    step_5b = f"CASE WHEN w LIKE '%ll' AND {_least('w', 2)} THEN {rest} ELSE w END"
    steps = [step_1a, None, step_1c, _table(STEP_2, 1), _table(STEP_3, 1), _table(STEP_4, 2), step_5a, step_5b]
    parts = [f"{prefix}s0 AS MATERIALIZED (SELECT term, lower(term) AS w FROM ({words}) AS listed)"]
    for i, step in enumerate(steps, start=1):
        source = f"{prefix}s{i - 1}"
        if step is None:
            source, step = f"(SELECT term, w, {ends} AS r FROM {source})", step_1b
        parts.append(f"{prefix}s{i} AS MATERIALIZED (SELECT term, {step} AS w FROM {source})")
    parts.append(
        f"{prefix}stems AS (SELECT first.term, CASE WHEN length(first.w) < 3 THEN first.w ELSE last.w END AS stem "
        f"FROM {prefix}s0 AS first JOIN {prefix}s{len(steps)} AS last ON first.term = last.term)"
    )
    return ",\n" + ",\n".join(parts)
