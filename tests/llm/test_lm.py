import collections
import math
import zlib

import numpy as np
import pytest
from conftest_llm import EDGES, lowered, prose

from topicdrift.llm.lm import LEVEL_COUNT, LogFrequencyFilter, fill_segment, scored, segment_size
from topicdrift.llm.words import mix

ROWS = EDGES + [(50 + i, prose(i % 9, 120, 60)) for i in range(40)]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("per_block", [5, 2048])
def test_base_score_and_counts(make, per_block):
    tokens = [(i, [*lowered(t), None]) for i, t in ROWS]
    counts = collections.Counter(w for i, own in tokens if not is_held(i) for w in own)
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted(
        (repr(i), is_held(i), len(own), sum(counts[w] > 0 for w in own), total,
         round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own), 4))
        for i, own in tokens
    )
    found = scored(make(ROWS), rows_per_block=per_block).collect()
    assert sorted((repr(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == expected
    assert all(r.score < 0 for r in found)


def test_known_sequences_score_better(make):
    """Held-out copies of training texts gain from word pairs; an overfull filter takes the gain away."""
    rows = [(i, prose(i % 6, 300, 4000)) for i in range(120)]
    found = [r for r in scored(make(rows)).collect() if r.held_out]
    assert len(found) > 10
    gain = sum(r.score - r.base_score for r in found)
    assert gain > 0.3 * sum(r.n_tokens for r in found)
    full = [r for r in scored(make(rows), filter_bytes=64).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in full) < gain / 2


def test_filter_levels_are_those_of_the_counts():
    rng = np.random.default_rng(4)
    keys = np.unique(mix(rng.integers(0, 2**63, 40_000, dtype=np.uint64)))
    counts = rng.zipf(1.5, len(keys))
    parts, segment_bytes = 7, 40_000
    owner = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    segments = [(p, *fill_segment(keys[owner == p], counts[owner == p], segment_bytes)) for p in range(parts)]
    table = LogFrequencyFilter(segments, parts, segment_bytes)
    wanted = np.minimum(np.floor(np.log2(counts)).astype(int) + 1, 40)
    found = table.levels(keys)
    assert (found >= wanted).all() and (found == wanted).mean() > 0.97
    assert (table.levels(mix(keys + np.uint64(1))) > 0).mean() < 0.03
    assert LEVEL_COUNT[1] == 1 and 2 < LEVEL_COUNT[2] < 3


def test_no_training_and_no_rows(make):
    held = [(i, prose(i, 20)) for i in range(200) if is_held(i)]
    for r in scored(make(held)).collect():
        assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(r.base_score)
    assert scored(make(held).limit(0)).count() == 0


@pytest.mark.parametrize("n", [2_000, 200_000])
def test_segments_grow_with_their_entries(n):
    """The error rate is that of the bits of an entry, however many entries there are."""
    keys = mix(np.arange(n, dtype=np.uint64))
    counts = np.random.default_rng(5).zipf(1.6, n)
    size = segment_size(counts)
    assert LogFrequencyFilter([(0, *fill_segment(keys, counts, size))], 1, size).trust > 0.995


def test_no_size_bounds_the_pairs(make, spark, monkeypatch):
    """Nothing is broadcast, and every pair is found at its level, whatever the number of pairs."""
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("the filter is broadcast"))
    rows = [(i, prose(i % 6, 300, 4000)) for i in range(120)]
    found = {r.id: r.score for r in scored(make(rows), rows_per_block=7).collect()}
    wide = {r.id: r.score for r in scored(make(rows), rows_per_block=7, filter_bytes=64 << 20).collect()}
    assert found == pytest.approx(wide, rel=1e-2)  # a pair in 1000 is taken for a known one
