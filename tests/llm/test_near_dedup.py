import random

import numpy as np
import pytest
from conftest_llm import EDGES, lowered, prose

from topicdrift.llm import near_dedup
from topicdrift.llm.components import components
from topicdrift.llm.near_dedup import THRESHOLD, VALUES, kept, least_matches, linked, survivors


def shingles(text):
    w = lowered(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Smallest id reachable over links of 75 percent and more, for rows with distinct ids."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if i is not None and j is not None and a and 100 * len(a & b) >= THRESHOLD * len(a | b):
                root[max(find(x), find(y))] = min(find(x), find(y))
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = i if i is None else min(i, least.get(find(x), i))
    return sorted(((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets)), key=repr)


def edited(text, seed, times):
    rng, w = random.Random(seed), text.split()
    for _ in range(times):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def families():
    rows, number = [], 100
    for family in range(6):
        base = prose(family, 200, 5000)
        for k in range(14):  # similarities on both sides of the threshold
            rows.append((number := number + 1, edited(base, 100 * family + k, k % 8)))
        rows.append((number := number + 1, base.upper()))
    chain = prose(77, 400, 5000)
    for k in range(9):  # only neighbours are linked
        chain = edited(chain, 1000 + k, 8)
        rows.append((number := number + 1, chain))
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [EDGES, families(), EDGES + families()], ids=["edges", "families", "both"])
def test_against_all_pairs(make, rows):
    found, links = linked(make(rows))
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in found.collect()), key=repr) == brute(rows)
    for link in links.collect():
        assert 100 * link.same >= THRESHOLD * link.united


def test_members_of_a_bucket_beside_the_hub(make):
    """The smallest document resembles all others in part, while these are linked with each other only."""
    words = prose(3, 300, 100_000).split()
    body = " ".join(words)
    hub = edited(body, 5, 14)
    rows = [(1, hub)] + [(2 + k, edited(body, 50 + k, k)) for k in range(5)]
    found, _ = linked(make(rows))
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in found.collect()), key=repr) == brute(rows)


def test_many_copies_are_one_class(make):
    rows = [(i, "the very same text in each of these rows") for i in range(500, 900)] + [(3, prose(1, 50))]
    found, links = linked(make(rows))
    assert links.count() == 0
    assert {(r.rep, r.component_id) for r in found.collect()} == {(500, 500), (3, 3)}


def test_posterior_keeps_the_threshold():
    needed = least_matches()
    assert needed == sorted(needed) and len(needed) == VALUES // 16
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**8, (20_000, VALUES), dtype=np.uint8)
    equal = rng.random(a.shape) < THRESHOLD / 100
    assert len(survivors(a, np.where(equal, a, a + 1), needed)[0]) > 19_990
    equal = rng.random(a.shape) < 0.3
    assert len(survivors(a, np.where(equal, a, a + 1), needed)[0]) == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(100)] + [(300, 301), (300, 301), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(101), 0), 300: 300, 301: 300}


def test_stage_and_empty_table(make):
    rows = [(4, prose(1, 60)), (2, prose(1, 60) + " end"), (9, None), (None, prose(1, 60)), (8, prose(2, 60)), (7, "")]
    docs = make(rows)
    left = kept(docs)
    assert left.dtypes == docs.dtypes
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([2, 9, None, 8, 7], key=repr)
    found, _ = linked(docs.limit(0))
    assert found.count() == 0 and kept(docs.limit(0)).count() == 0


def test_stage_keeps_one_row_of_each_group(make):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(2, a), (5, b), (5, a + " end"), (2, a), (2, a), (6, b + " end"), (5, b), (2, a + " other"), (None, c), (None, c), (None, c + " end"), (4, None), (4, "")]
    left = kept(make(rows)).collect()
    assert sorted((repr(r.doc_id), (r.text or "")[:20]) for r in left) == sorted(
        [("2", a[:20]), ("5", b[:20]), ("None", c[:20]), ("4", ""), ("4", "")])


def test_stage_keeps_both_texts_of_a_shared_id(make):
    a, b = prose(1, 60), prose(2, 60)
    left = kept(make([(2, a), (2, b), (7, a + " end"), (8, b + " end")])).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(2, a), (2, b)])


def test_an_id_shared_by_two_texts(make):
    """Links are those of the rows' own texts: A with A', B with B', and nothing between them."""
    a, b = prose(1, 60), prose(2, 60)
    found, _ = linked(make([(3, a), (5, a + " end"), (5, b), (7, b + " end")]))
    assert sorted((r.id, r.component_id) for r in found.collect()) == [(3, 3), (5, 3), (5, 5), (7, 5)]


def test_one_id_and_null_in_a_third_of_the_rows(make):
    rows = [(i, prose(i, 40)) for i in range(30)] + [(50, prose(100 + i, 40)) for i in range(30)] + [(None, prose(200 + i // 2, 40)) for i in range(30)]
    found, _ = linked(make(rows))
    assert sorted(((r.id, r.component_id) for r in found.collect()), key=repr) == sorted(((i, i) for i, _ in rows), key=repr)
    assert kept(make(rows)).count() == 30 + 30 + 15


def test_clashing_names_come_back(spark):
    text = prose(1, 60)
    names = ["doc_id", "text", "row_key", "row", "key", "id", "a.b", "rep", "least"]
    rows = [(2, text, "k2", 1, "x", 9, "dot", 3, 4), (1, text + " end", "k1", 5, "y", 8, "point", 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string, row int, key string, id int, `a.b` string, rep int, least int")
    left = kept(docs)
    assert left.columns == names and [tuple(r) for r in left.collect()] == [rows[1]]


@pytest.mark.parametrize("tile", [2, 5])
def test_small_tiles_find_the_same(make, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "SLICE", 2)
    rows = families()
    found, _ = linked(make(rows))
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in found.collect()), key=repr) == brute(rows)
