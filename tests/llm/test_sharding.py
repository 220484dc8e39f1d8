"""Shards: scheduling against a plain version, groups, sizes, slots."""

import zlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import EDGES, prose
from hypothesis import given, strategies as st

from topicdrift.llm import sharding


@given(st.lists(st.integers(0, 1000)), st.integers(1, 9))
def test_least_loaded_first(sizes, shards):
    sizes = sorted(sizes, reverse=True)
    loads = [0] * shards
    for size, shard in zip(sizes, sharding.scheduled(sizes, shards), strict=True):
        assert shard == min(range(shards), key=lambda i: (loads[i], i))
        loads[shard] += size
    if sizes:
        assert max(loads) - min(loads) <= sizes[0]


def run(make, rows, shards):
    return [tuple(r) for r in sharding.sharded(make(rows), shards).select("id", "size", "text_crc32", "shard", "slot").collect()]


def check(rows, found, shards):
    plain = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    assert Counter(r[:3] for r in found) == Counter(plain)
    places = defaultdict(set)
    by_shard = defaultdict(list)
    for i, size, crc, shard, slot in found:
        places[size, crc].add(shard)
        by_shard[shard].append((slot, i is not None, i or 0))
    assert all(len(one) == 1 for one in places.values())  # no two texts here share size and checksum
    for listed in by_shard.values():
        listed.sort()
        assert [one[0] for one in listed] == list(range(len(listed)))
        assert [one[1:] for one in listed] == sorted(one[1:] for one in listed)
    assert set(by_shard) <= set(range(shards))


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_groups_sizes_slots(make, shards):
    rows = EDGES + [(i, prose(i % 40, 3 + i % 90)) for i in range(20, 200)]
    check(rows, run(make, rows, shards), shards)


def test_near_equal(make):
    rows = [(i, prose(i, 20 + i * 7 % 200)) for i in range(2000)]
    loads = Counter()
    for _, size, _, shard, _ in run(make, rows, 24):
        loads[shard] += size
    assert len(loads) == 24 and max(loads.values()) / min(loads.values()) < 1.01


def test_one_group_and_one_id_in_a_third_of_the_rows(make):
    rows = [(i, prose(i, 30)) for i in range(200)] + [(i, "copy of one text") for i in range(300, 400)] + [(5, prose(900 + i, 30)) for i in range(100)] + [(None, None)] * 60
    found = run(make, rows, 4)
    check(rows, found, 4)
    loads = Counter()
    for _, size, _, shard, _ in found:
        loads[shard] += size
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values())


def test_empty_table(make):
    assert run(make, [], 24) == []
