"""Whitening against plain numpy on the distinct vectors."""

import math

import numpy as np
import pytest

from topicdrift.llm import whitening
from topicdrift.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, x array<long>, copies int, share int, d int, n long, deviation string, `a.b` int"


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, 1, [5], 2, 3, 4, 6, "q", 0) for i, v in rows], SCHEMA).repartition(partitions)


def brute(rows, components=4, weighting="one"):
    """{(id, place of the row): per component (n, deviation, whitened, explained)} and the fit's identity error."""
    valid = [(i, tuple(math.floor(float(np.float32(c)) * 256) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out, errors = [], {}
    for d in {len(x) for _, x in valid}:
        own = [(i, x) for i, x in valid if len(x) == d]
        distinct = sorted({x for _, x in own})
        w = np.array([sum(1 for _, y in own if y == x) if weighting == "count" else 1 for x in distinct])
        n, sums = int(w.sum()), [int(sum(int(k) * x[j] for k, x in zip(w, distinct))) for j in range(d)]
        matrix = np.array(distinct, dtype=float).reshape(len(distinct), d) - np.array(sums) / n
        values, vectors = np.linalg.eigh((matrix * w[:, None]).T @ matrix / n) if d else ([], np.zeros((0, 0)))
        order = np.argsort(values)[::-1][:components]
        for i, x in own:
            for rank, j in enumerate(order, 1):
                z = (np.array(x) - np.array(sums) / n) @ vectors[:, j] / math.sqrt(values[j]) if values[j] > 1e-9 else None
                deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
                out.append((i, rank, n, deviation, z, values[j] / sum(values) if sum(values) > 1e-9 else None))
    return out


def same(found, wanted):
    assert len(found) == len(wanted)
    signs = {}
    keyed = lambda one: (one[0] is None, one[0] or 0, one[1], one[2], int(one[3]), abs(round(one[4], 6)) if one[4] is not None else -1)
    for a, b in zip(sorted(found, key=keyed), sorted(wanted, key=keyed), strict=True):
        assert (a[0], a[1], a[2], int(a[3])) == (b[0], b[1], b[2], b[3])
        assert (a[4] is None) == (b[4] is None) and (a[5] is None) == (b[5] is None)
        if a[4] is not None:
            assert abs(a[4]) == pytest.approx(abs(b[4]), abs=1e-6)
            if abs(b[4]) > 1e-3:
                signs.setdefault((a[1], a[2]), set()).add(a[4] * b[4] > 0)
            assert a[5] == pytest.approx(b[5], rel=1e-6)
    assert all(len(one) == 1 for one in signs.values())


def rows_of(frame):
    return [(r["id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in frame.collect()]


def vectors(count, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(count, d)) * (1 + np.arange(d)) @ rng.normal(size=(d, d))).astype(np.float32).tolist()


def test_against_numpy(spark):
    listed = vectors(60, 7)
    rows = [(i, v) for i, v in enumerate(listed)] + [(i, listed[3]) for i in range(100, 180)] + [(3, listed[5]), (None, listed[5]), (None, listed[3])]
    rows += [(200, None), (201, []), (202, [None] + listed[0][1:]), (203, [float("nan")] + listed[0][1:]), (204, [float("inf")] * 7), (205, [-0.0] * 7), (206, [0.0] * 7)]
    for weighting in ("one", "count"):
        found = whitening.whitened(table(spark, rows), weighting=weighting)
        same(rows_of(found), brute(rows, weighting=weighting))
        errors = {r["identity_error"] for r in found.collect()}
        assert len(errors) == 1 and errors.pop() < 1e-9


def test_other_lengths_and_few_components(spark):
    rows = [(i, v) for i, v in enumerate(vectors(9, 3))] + [(20 + i, v) for i, v in enumerate(vectors(6, 1))] + [(40, [1.5, 2.5]), (41, [1.5, 2.5])]
    same(rows_of(whitening.whitened(table(spark, rows))), brute(rows))
    same(rows_of(whitening.whitened(table(spark, rows), components=1)), brute(rows, components=1))


def test_no_rows_and_no_variance(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None), (2, [])])).count() == 0
    found = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).orderBy("component").collect()
    shown = [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in found]
    assert shown == [(component, 1, 0, None, None, None) for component in (1, 1, 2, 2)]
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(5)]
    found = rows_of(whitening.whitened(table(spark, line)))
    same(found, brute(line))
    assert all((r[4] is None) == (r[1] > 1) for r in found)


def test_large_entries_are_exact(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1e12, 3.0]), (4, [1e12, 4.0])]
    found = whitening.whitened(table(spark, rows)).where("component = 1").collect()
    least, most = -(2**63), 2**63 - 1
    xs = {1: (most, 256), 2: (least, 512), 3: (256 * int(np.float32(1e12)), 768), 4: (256 * int(np.float32(1e12)), 1024)}
    sums = [sum(x[j] for x in xs.values()) for j in (0, 1)]
    for row in found:
        exact = sum((4 * c - s) ** 2 for c, s in zip(xs[row["id"]], sums))
        assert row["deviation"] is None if exact >= 10**38 else int(row["deviation"]) == exact


def test_one_vector_in_a_third_of_the_rows(spark):
    listed = vectors(200, 4, seed=2)
    rows = [(i, v) for i, v in enumerate(listed)] + [(7, listed[7])] * 100 + [(None, listed[8])] * 100
    found = whitening.whitened(table(spark, rows, 5))
    same(rows_of(found), brute(rows))


def test_query(spark):
    frame = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001")
    assert dict(frame.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    same([(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in frame.collect()], brute([(r["vec_id"], r["embedding"]) for r in given]))
    assert frame.agg({"identity_error": "max"}).first()[0] < 1e-4
