"""Importance resampling against a version in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import EDGES, prose

from topicdrift.llm import target_resampling as op


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(rows, target, words=1, buckets=10_000, least=20, percent=10, seed=2024):
    def features(text):
        listed = words_of(text)
        return [zlib.crc32(" ".join(listed[i : i + n]).encode()) % buckets for n in range(1, words + 1) for i in range(len(listed) - n + 1)]

    found = [features(text) for _, text in rows]
    raw, wanted = Counter(b for one in found for b in one), Counter(b for text in target for b in features(text))
    s, t = sum(raw.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in raw}
    out = []
    for (i, text), one in zip(rows, found):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in one)
        out.append([i, len(words_of(text)), len(one), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: len(able) * percent // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=str)


def run(make, rows, target, **settings):
    given = make([(None, text) for text in target])
    return sorted((tuple(r) for r in op.resampled(make(rows), given, **settings).collect()), key=str)


TARGET = [prose(3, 300), None, "", "One two THREE", prose(8, 50, 30)]
MANY = [(i, prose(i, 5 + i % 60, 100 if i % 3 else 30)) for i in range(20, 150)]


@pytest.mark.parametrize("words", [1, 2])
@pytest.mark.parametrize("percent", [10, 100])
def test_against_plain_python(make, words, percent):
    rows = EDGES + MANY
    assert run(make, rows, TARGET, words=words, percent=percent, buckets=500) == brute(rows, TARGET, words, 500, percent=percent)


def test_no_rows_and_no_target(make):
    assert run(make, [], TARGET) == []
    assert run(make, EDGES, []) == brute(EDGES, [])
    short = [(1, "a b"), (2, None)]
    assert run(make, short, TARGET) == brute(short, TARGET)


def test_one_id_in_a_third_of_the_rows(make):
    rows = MANY + [(7, prose(1, 40))] * 40 + [(7, prose(2, 40))] * 40 + [(None, prose(i, 30)) for i in range(60)]
    found, wanted = run(make, rows, TARGET, percent=50), brute(rows, TARGET, percent=50)
    drop = lambda listed: sorted((r[:5] for r in listed), key=str)
    assert drop(found) == drop(wanted)
    assert sorted((r[5], r[4]) for r in found if r[5]) == sorted((r[5], r[4]) for r in wanted if r[5])


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "Ab-cd é中文 12\x0034 " * 50 + "z" * 200 + " end"
    whole = words_of(text)
    monkeypatch.setattr(op, "PIECE_CHARS", 40)
    split = op.splitter()
    pieces = list(op.word_offsets(text.encode().lower().decode(), split))
    assert len(pieces) > 5
    assert [piece[a:b] for piece, pairs in pieces for a, b in pairs] == whole
    assert "".join(piece for piece, _ in pieces) == text.lower()
