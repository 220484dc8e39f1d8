import random
import re

import pytest
from conftest_llm import EDGES, prose, words

from topicdrift.llm.decontamination import _found, clean, contaminated, shard

ITEMS = [
    (1, "A train leaves Boston at 5 pm and travels 60 miles per hour for 3 hours to reach the old harbor where Alice waits for it"),
    (2, prose(11, 40, 5000)), (3, prose(12, 15, 5000)), (4, "five small words only here"), (5, None), (6, ""), (None, prose(13, 30)),
]
SWAPPED = "Well. A train leaves Denver at 7 pm and travels 80 miles per hour for 4 hours to reach the old harbor where Bob waits for it now"
DOCS = EDGES + [
    (20, prose(1, 30, 5000) + " " + prose(11, 40, 5000) + " " + prose(2, 30, 5000)),
    (21, SWAPPED),
    (22, SWAPPED.replace("80", "7").replace(" 4 ", " 7 ")),  # one number of the document for several of the item
    (23, " ".join(prose(11, 40, 5000).upper().split()[5:25])), (24, "before " + prose(12, 15, 5000) + " after"),
    (25, prose(3, 200, 5000)), (26, "x five small words only here y"), (27, " ".join(prose(11, 40, 5000).split()[:12])), (21, SWAPPED),
]


def benchmark(spark):
    return spark.createDataFrame([(i, t, None, "z") for i, t in ITEMS], "item_id long, text string, doc_id long, value string")


@pytest.mark.parametrize("shard_bytes", [1 << 20, 50])
def test_matches(make, spark, shard_bytes):
    found = contaminated(make(DOCS), benchmark(spark), shard_bytes=shard_bytes).collect()
    assert sorted((r.doc_id, r.item_id, r.same_values) for r in found) == [
        (20, 2, True), (21, 1, False), (21, 1, False), (23, 2, True), (24, 3, True), (26, 4, True)]
    assert {(r.doc_id, r.first_word, r.n_words) for r in found if r.doc_id in (20, 24)} == {(20, 30, 40), (24, 1, 15)}


def test_literal_passages_against_brute_force(make, spark):
    """Every run of 13 words, without case and edges, that an item has, too."""
    bare = lambda t: [re.sub(r"^[.,!?;:\"'()\[\]{}]{0,3}|[.,!?;:\"'()\[\]{}]{0,3}$", "", w.lower()) for w in words(t)]
    items = [(i, prose(100 + i, 20 + i)) for i in range(8)]
    docs = [(i, prose(i, 20) + ". " + " ".join(prose(100 + i % 8, 20 + i % 8).split()[i % 11 : i % 11 + 8 + i % 13]).title() + ", " + prose(500 + i, 9)) for i in range(80)]
    grams = {tuple(bare(t)[k : k + 13]) for _, t in items for k in range(len(bare(t)) - 12)}
    expected = {i for i, t in docs if any(tuple(bare(t)[k : k + 13]) in grams for k in range(len(bare(t)) - 12))}
    found = contaminated(make(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == expected and 10 < len(expected) < 80


def test_stage_and_empty_tables(make, spark):
    docs = make(DOCS)
    left = clean(docs, benchmark(spark))
    assert left.dtypes == docs.dtypes
    assert sorted(repr(r.doc_id) for r in left.collect()) == sorted(repr(i) for i, _ in DOCS if i not in (20, 21, 23, 24, 26))
    assert clean(docs, benchmark(spark).limit(0)).count() == len(DOCS)
    assert clean(docs.limit(0), benchmark(spark)).count() == 0
    assert contaminated(docs, benchmark(spark).limit(0)).count() == 0


def found_in(item, text):
    import pyarrow as pa

    return [more[-1] for _, _, *more in _found(pa.array([text]), shard([(1, item)]))]


@pytest.mark.parametrize(("item", "text"), [
    ("Tom had 3 apples. Tom gave 2 to Ann. How many apples does Tom have now?", "Bob had 7 apples. Bob gave 4 to Sue. How many apples does Bob have now?"),
    ("Alice has 5 pens and loses two of them", "Bob has 9 pens and loses three of them"),
    ("a parcel of 5kg and another one of 7kg were sent to the same old house", "a parcel of 6kg and another one of 9kg were sent to the same old house"),
    ("on the 3rd day she met Łukasz near the old mill and they spoke for long", "on the 5th day she met Émile near the old mill and they spoke for long"),
    ("when Ольга left the town she had 12 coins and gave 5 of them to the poor", "when Иван left the town she had 30 coins and gave 8 of them to the poor"),
])
def test_other_names_and_numbers(item, text):
    assert found_in(item, "well then. " + text + " and so on") == [False]
    assert found_in(item, "well then. " + item + " and so on") == [True]


@pytest.mark.parametrize(("item", "text"), [
    ("Tom had 3 apples. Tom gave 2 to Ann. How many apples does Tom have now?", "Bob had 7 apples. Jim gave 4 to Sue. How many apples does Bob have now?"),
    ("Alice has 5 pens and loses two of them", "Bob has 9 cows and sells three of those"),
    ("Alice has 5 pens", "Bob has 7 pens"),
])
def test_other_questions(item, text):
    assert found_in(item, text) == []


def test_recall_on_changed_questions():
    """Questions made from templates: those with other names, numbers and units of one word are found, others are not."""
    rng = random.Random(4)
    names, units = ["Ann", "Bob", "Cleo", "Dan", "Eve", "Zoë", "Łukasz", "Olga"], ["miles", "kg", "hours", "dollars", "meters"]
    verbs = [f"verb{i}" for i in range(60)]
    nouns = [f"noun{i}" for i in range(60)]
    items, changed = [], []
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(3, 7)):
            parts.append(rng.choice([
                "{a} " + rng.choice(verbs) + " {n} " + rng.choice(nouns) + " for {b}.", "Then {a} " + rng.choice(verbs) + " the " + rng.choice(nouns) + " by {m} {u}.",
                "The " + rng.choice(nouns) + " of {b} was " + rng.choice(verbs) + " and cost {m}.", "How many " + rng.choice(nouns) + " does {a} " + rng.choice(verbs) + " now?",
            ]))
        template = " ".join(parts)

        def filled():
            a, b = rng.sample(names, 2)
            n, m = rng.sample(range(2, 99), 2)
            return template.format(a=a, b=b, n=n, m=m, u=rng.choice(units))

        items.append(filled())
        changed.append(filled())
    index = shard(list(enumerate(items)))
    import pyarrow as pa

    hits = {(text, item) for text, item, *_ in _found(pa.array(["some words " + x + " more words" for x in changed]), index)}
    assert sum((i, i) in hits for i in range(len(items))) >= 0.9 * len(items)
    assert not list(_found(pa.array([prose(i, 400) for i in range(50)]), index))
