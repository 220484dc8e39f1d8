import hashlib

import numpy as np
import pytest
from conftest_llm import EDGES, prose, words
from pyspark.sql import functions as F

from topicdrift.llm.substring_dedup import deduplicated, factored, parse


def brute(rows, size=13):
    """Removed word places of each row, by comparing all windows."""
    first = {}
    for i, text in rows:
        if i is not None:
            w = words(text)
            for k in range(len(w) - size + 1):
                gram = tuple(w[k : k + size])
                first[gram] = min(first.get(gram, i), i)
    out = []
    for i, text in rows:
        w, gone = words(text), set()
        for k in range(len(w) - size + 1):
            if first.get(tuple(w[k : k + size]), float("inf")) < (float("inf") if i is None else i):
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def copies():
    base = prose(5, 60).split()
    rows = [(100 + i, " ".join(base[i % 20 : 20 + i % 35])) for i in range(30)]
    rows += [(200 + i, prose(50 + i, 40) + " " + " ".join(base[3:40]) + "\n" + prose(90 + i, 30)) for i in range(10)]
    # two factors from two sources, and a window across their boundary that a third document has
    a, b = prose(7, 20).split(), prose(8, 20).split()
    return rows + [(300, " ".join(a)), (301, " ".join(b)), (302, " ".join(a[10:] + b[:10])), (303, " ".join(a + b))]


@pytest.mark.parametrize("rows", [EDGES, copies(), EDGES + copies()], ids=["edges", "copies", "both"])
@pytest.mark.parametrize("per_block", [4, 2048])
def test_against_all_windows(make, rows, per_block):
    found = factored(make(rows), rows_per_block=per_block).collect()
    assert sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in found), key=repr) == brute(rows)


def test_factors_cover_what_is_removed(make):
    rows = copies()
    text = {i: words(t) for i, t in rows}
    for row in factored(make(rows)).collect():
        covered = set()
        for f in row.factors:
            assert f.words >= 13 and f.source < row.id
            covered.update(range(f.first, f.first + f.words))
        assert len(covered) == row.n_removed
        for f in row.factors:
            source, own = " ".join(text[f.source]), text[row.id]
            assert all(" ".join(own[k : k + 13]) in source for k in range(f.first, f.first + f.words - 12))


def test_factors_are_copies_of_their_place(make):
    rows = copies()
    text = {i: words(t) for i, t in rows}
    boundaries = 0
    for per_block in (4, 2048):
        for row in factored(make(rows), rows_per_block=per_block).collect():
            done = 0
            for f in row.factors:
                assert text[row.id][f.first : f.first + f.words] == text[f.source][f.source_first : f.source_first + f.words]
                if not f.boundary:
                    assert f.first >= done
                    done = f.first + f.words
            boundaries += sum(f.boundary for f in row.factors)
    assert boundaries


def test_parse_against_word_by_word():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, window = int(rng.integers(0, 60)), int(rng.integers(1, 6))
        at = np.flatnonzero(rng.random(n) < 0.7)
        doc = at // 20
        inside = (at + window - 1) // 20 == doc
        at, doc = at[inside], doc[inside]
        source = rng.integers(0, 2, len(at))
        place = at + rng.integers(0, 2, len(at))
        known = {int(i): (int(s), int(p), int(d)) for i, s, p, d in zip(at, source, place, doc, strict=True)}
        wanted, i = [], 0
        while i < n:
            if i not in known:
                i += 1
                continue
            s, p, d = known[i]
            k = 1
            while known.get(i + k) == (s, p + k, d):
                k += 1
            wanted.append((i, k - 1 + window, s, p))
            i += k - 1 + window
        first, length, sources, places, boundary = parse(at, source, place, doc, window)
        found = list(zip(first.tolist(), length.tolist(), sources.tolist(), places.tolist(), strict=True))
        assert [f for f, b in zip(found, boundary, strict=True) if not b] == wanted
        covered = {i for f, words_of, *_ in found for i in range(f, f + words_of)}
        assert covered == {j for i in at.tolist() for j in range(i, i + window)}


def test_stage_keeps_layout_columns_and_clean_rows(make):
    rows = [(1, "alpha\n beta  gamma " + prose(1, 20)), (2, "own words\n\tkept " + prose(1, 20) + "\n the  end"), (3, prose(1, 20)), (4, None), (5, "")]
    docs = make(rows)
    found = deduplicated(docs)
    assert found.dtypes == docs.dtypes
    kept = {r.doc_id: r for r in found.collect()}
    assert set(kept) == {1, 2, 4, 5}
    assert kept[1].text == rows[0][1] and kept[4].text is None and kept[5].text == ""
    assert kept[2].text == "own words\n\tkept the  end" and kept[2].n_chars == len(kept[2].text)
    assert kept[2].source is None and kept[2].carried == "x" and kept[2].block == 1


def test_empty_table(make, spark):
    empty = make(EDGES).limit(0)
    assert factored(empty).count() == 0 and deduplicated(empty).count() == 0


def test_digest_matches_hashlib(make):
    rows = [(1, prose(3, 40)), (2, "before " + prose(3, 40) + " after")]
    got = {r.id: r.d for r in factored(make(rows)).select("id", F.sha2("kept", 256).alias("d")).collect()}
    assert got[2] == hashlib.sha256(b"before after").hexdigest()
