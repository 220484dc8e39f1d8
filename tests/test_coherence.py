import math
import random

import pytest

from topicdrift.operators import coherence

RANDOM = random.Random(5)
TERMS = list("abcdefgh")
DOCS = [(i, [RANDOM.choice(TERMS + ["x"] * 12) for _ in range(RANDOM.choice([0, 1, 3, 9, 10, 11, 40, 90]))]) for i in range(60)]
TOPICS = [(0, term) for term in "abcde"] + [(1, term) for term in "defgh"] + [(2, "a"), (2, "never")]


def brute(window):
    """Sets of words of every window, listed one by one."""
    windows = []
    for _, tokens in DOCS:
        if tokens:
            windows += [set(tokens[start : start + window]) for start in range(max(len(tokens) - window, 0) + 1)]
    return windows


@pytest.fixture(scope="module")
def inputs(spark):
    documents = spark.createDataFrame(DOCS, "doc_id int, tokens array<string>").repartition(3)
    return documents, spark.createDataFrame(TOPICS, "topic int, term string")


@pytest.mark.parametrize("window", [1, 2, 10, 200])
def test_counts_equal_listed_windows(inputs, window):
    documents, topics = inputs
    windows = brute(window)
    assert coherence.window_total(documents, window=window).first()[0] == len(windows)
    found = {(row["topic"], row["a"], row["b"]): row["n"] for row in coherence.window_cooccurrence(documents, topics, "doc_id", window=window).collect()}
    expected = {
        (topic, a, b): sum(a in seen and b in seen for seen in windows)
        for topic in (0, 1, 2)
        for t, a in TOPICS if t == topic
        for u, b in TOPICS if u == topic and a <= b
    }
    assert found == expected


def test_score_equals_the_formula(inputs):
    documents, topics = inputs
    windows, eps = brute(10), 1e-12
    total = len(windows)

    def npmi(a, b):
        n_a, n_b = (sum(t in seen for seen in windows) for t in (a, b))
        n = sum(a in seen and b in seen for seen in windows)
        if n_a == 0 or n_b == 0:
            return 0.0
        joint = n / total
        return math.log((joint + eps) / (n_a * n_b / total**2)) / -math.log(joint + eps)

    for row in coherence.coherence_cv(documents, topics, "doc_id", window=10).collect():
        listed = [term for topic, term in TOPICS if topic == row["topic"]]
        vectors = [[npmi(a, b) for b in listed] for a in listed]
        whole = [sum(column) for column in zip(*vectors)]
        norm = lambda v: math.sqrt(sum(x * x for x in v))
        cosines = [sum(x * y for x, y in zip(v, whole)) / (norm(v) * norm(whole)) if norm(v) else 0.0 for v in vectors]
        assert row["coherence"] == pytest.approx(sum(cosines) / len(cosines), abs=1e-9)


def test_terms_in_every_window(spark):
    documents = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a", "a"])], "doc_id int, tokens array<string>")
    topics = spark.createDataFrame([(0, "a"), (0, "b")], "topic int, term string")
    assert coherence.coherence_cv(documents, topics, "doc_id").first()["coherence"] == pytest.approx(1.0)


@pytest.mark.parametrize("literal", [10_000, 0])
def test_topics_of_a_hundred_terms(spark, monkeypatch, literal):
    monkeypatch.setattr(coherence, "LITERAL_TERMS", literal)
    rng = random.Random(2)
    terms = [f"t{i:03d}" for i in range(100)]
    rows = [(i, [rng.choice(terms + ["x"] * 30) for _ in range(rng.choice([0, 5, 60]))]) for i in range(30)]
    documents = spark.createDataFrame(rows, "doc_id int, tokens array<string>")
    listed = spark.createDataFrame([(0, term) for term in terms], "topic int, term string")
    found = {(r["a"], r["b"]): r["n"] for r in coherence.window_cooccurrence(documents, listed, "doc_id", window=10).collect()}
    windows = [set(t[k : k + 10]) for _, t in rows if t for k in range(max(len(t) - 10, 0) + 1)]
    assert len(found) == 5050
    assert all(n == sum(a in seen and b in seen for seen in windows) for (a, b), n in found.items())
