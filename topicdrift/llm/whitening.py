"""Whitening of embeddings: each distinct vector once, weighted centred products, joined back.

1. Entries become integers (steps of 1 / `STEPS`), so that equal vectors are equal and sums are exact.
   Identical vectors are grouped; the group's weight in every sum is 1 or its number of rows.
2. Tasks add up the exact sums of each dimension, then the products of centred vectors (one matrix
   product a batch). Sums of tasks are added up by Spark; the driver gets d numbers and d rows of d.
3. Eigenvectors of that d x d matrix are found on the driver. Each distinct vector is projected once.
4. Rows are joined with the projections by their vector. A vector of more than 1 / `SHARES` of all
   rows (fewer than `SHARES` of these, broadcast) is dealt to as many tasks as it has such shares.

Vectors of different lengths are fitted apart, each length by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicdrift.runtime import stored

STEPS = 256
COMPONENTS = 4
SHARES = 1024
ONE, COUNT = "one", "count"
_SAFE = 1 << 62
_SLICES = 64


@dataclass(frozen=True)
class Fit:
    """Of the vectors of one length: their number (or weight), exact sums, projection and eigenvalues' shares."""

    n: int
    sums: tuple[int, ...]
    #: A column for each component; a component without variance is None.
    projection: np.ndarray
    known: tuple[bool, ...]
    explained: tuple[float | None, ...]


def stepped(rows: DataFrame, vector_col: str) -> DataFrame:
    """`rows` with `x`, the vector in whole steps rounded down; rows without a whole finite vector are left out.

    Steps beyond the range of a long are its ends.
    """
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(vector.isNotNull() & finite).withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("bigint")))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of the rows, their vectors as a matrix) for each length in the batch; x is its first column."""
    column = batch.column(0)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == d)
        yield d, places, column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(len(places), d)


def _from_centre(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact: 64-bit where that holds them, else Python integers."""
    largest = max(int(x.max()), -int(x.min()), 0) if x.size else 0
    if n * largest + max((abs(one) for one in sums), default=0) < _SAFE:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _deviations(centred: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    largest = max((abs(int(one)) for one in (centred.max(), centred.min())), default=0) if centred.size else 0
    if largest * largest * max(centred.shape[1], 1) >= _SAFE:
        centred = centred.astype(object)
    return [int(one) for one in (centred * centred).sum(axis=1).tolist()]


def _weights(batch: pa.RecordBatch, weighting: str) -> np.ndarray:
    return batch.column(1).to_numpy() if weighting == COUNT else np.ones(len(batch), dtype=np.int64)


def _sums(groups: DataFrame, weighting: str) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Number and sums of the vectors of each length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            weights = _weights(batch, weighting)
            for d, places, x in _matrices(batch):
                w = weights[places]
                n, total = own.get(d, (0, np.zeros(d, dtype=object)))
                largest = max(int(x.max()), -int(x.min())) if x.size else 0
                safe = largest * int(w.sum()) < _SAFE
                own[d] = n + int(w.sum()), total + ((x if safe else x.astype(object)) * w[:, None]).sum(axis=0).astype(object)
        rows = [(d, i, Decimal(int(one))) for d, (n, total) in own.items() for i, one in enumerate([n, *total], -1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.decimal128(38, 0)))], ["d", "i", "part"])

    parts = groups.mapInArrow(add, "d int, i int, part decimal(38,0)").groupBy("d", "i").agg(F.sum("part").alias("total")).collect()
    found: dict[int, dict[int, int]] = {}
    for row in parts:
        found.setdefault(row["d"], {})[row["i"]] = int(row["total"])
    return {d: (one[-1], tuple(one[i] for i in range(d))) for d, one in found.items()}


def _products(groups: DataFrame, sums: dict[int, tuple[int, tuple[int, ...]]], weighting: str) -> dict[int, np.ndarray]:
    """Weighted sum of products of centred vectors, of each length."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = _weights(batch, weighting)
            for d, places, x in _matrices(batch):
                n, total = sums[d]
                centred = _from_centre(x, n, total).astype(float) / n
                own[d] = own.get(d, np.zeros((d, d))) + (centred * weights[places][:, None]).T @ centred
        part = TaskContext.get().partitionId() % _SLICES
        for d, matrix in own.items():
            columns = [pa.array(np.full(d, d, dtype=np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, part, dtype=np.int32)), pa.array(list(matrix), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["d", "i", "part", "products"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(one.as_py()) for one in table["products"]], axis=0)
        return table.slice(0, 1).set_column(3, "products", pa.array([total], pa.list_(pa.float64())))

    kind = "d int, i int, part int, products array<double>"
    sliced = groups.mapInArrow(multiply, kind).groupBy("d", "i", "part").applyInArrow(add, kind)
    out = {d: np.zeros((d, d)) for d in sums}
    for row in sliced.groupBy("d", "i").applyInArrow(add, kind).collect():
        out[row["d"]][row["i"]] = row["products"]
    return out


def fit(groups: DataFrame, components: int = COMPONENTS, weighting: str = ONE) -> dict[int, Fit]:
    """A fit for each length of the distinct vectors `(x, copies)`; the driver holds a d x d matrix of each."""
    groups = groups.select("x", "copies")
    sums = _sums(groups, weighting)
    fits = {}
    for d, products in _products(groups, sums, weighting).items():
        n, total = sums[d]
        values, vectors = np.linalg.eigh(products / n) if d else (np.zeros(0), np.zeros((0, 0)))
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        trace = float(np.trace(products)) / n
        known = values > trace * d * np.finfo(float).eps
        fits[d] = Fit(
            n, total, vectors / np.sqrt(np.where(known, values, 1.0)), tuple(known.tolist()),
            tuple(float(max(one, 0.0)) / trace if trace > 0 else None for one in values),
        )
    return fits


def projected(groups: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """x, copies, deviation (sum of (n * x - sums)**2, null beyond 38 digits), whitened (null where a component has no variance)."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation: list = [None] * len(batch)
            whitened: list = [None] * len(batch)
            for d, places, x in _matrices(batch):
                one = fits[d]
                centred = _from_centre(x, one.n, one.sums)
                z = centred.astype(float) / one.n @ one.projection
                for place, square, row in zip(places.tolist(), _deviations(centred), z.tolist(), strict=True):
                    deviation[place] = Decimal(square) if square < 10**38 else None
                    whitened[place] = [value if known else None for value, known in zip(row, one.known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(deviation, pa.decimal128(38, 0)), pa.array(whitened, pa.list_(pa.float64()))],
                ["x", "copies", "deviation", "whitened"],
            )

    return groups.select("x", "copies").mapInArrow(project, "x array<bigint>, copies bigint, deviation decimal(38,0), whitened array<double>")


def identity_errors(vectors: DataFrame, fits: dict[int, Fit], weighting: str = ONE) -> dict[int, float]:
    """For each length the largest absolute entry of the whitened vectors' covariance minus the identity."""
    weight = F.col("copies") if weighting == COUNT else F.lit(1)
    errors = {}
    for d, one in fits.items():
        known = [i for i, there in enumerate(one.known) if there]
        if not known:
            continue
        own = vectors.where(F.size("x") == d)
        z = [F.get("whitened", F.lit(i)) for i in known]
        means = own.agg(*[(F.sum(weight * value) / one.n).alias(f"m{i}") for i, value in enumerate(z)]).first()
        pairs = [(i, j) for i in range(len(z)) for j in range(i + 1)]
        covariance = own.agg(*[(F.sum(weight * (z[i] - means[i]) * (z[j] - means[j])) / one.n).alias(f"c{i}_{j}") for i, j in pairs]).first()
        errors[d] = max(abs(value - (i == j)) for (i, j), value in zip(pairs, covariance, strict=True))
    return errors


def whitened(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weighting: str = ONE,
) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: rows of each vector and component.

    Null vectors and those with a null or non-finite entry are left out; repeated rows and ids stay. A vector
    of d < `components` entries has d components, an empty one none. A component without variance (as when all
    vectors are equal) has `whitened` null; without any variance `explained` and `identity_error` are null, too.
    n, sums and components are those of the vectors of the same length. Other columns are ignored.
    """
    named = stepped(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector").select("id", "x")
    groups = stored(named.groupBy("x").agg(F.count("*").alias("copies")))
    fits = fit(groups, components, weighting)
    vectors = stored(projected(groups, fits))
    errors = identity_errors(vectors, fits, weighting)

    everything = groups.agg(F.sum("copies")).first()[0] or 0
    shares = F.ceil(F.col("copies") * SHARES / F.lit(max(everything, 1))).cast("int")
    hot = F.broadcast(groups.where(F.col("copies") * SHARES > everything).select("x", shares.alias("shares")))
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("shares", F.lit(1))).cast("int")
    dealt = named.join(hot, "x", "left").select("id", "x", share.alias("share"))
    copied = vectors.join(hot, "x", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    back = dealt.join(copied.select("x", "share", "deviation", "whitened"), ["x", "share"])
    models = [
        (d, component, one.n, value, errors.get(d)) for d, one in fits.items() for component, value in enumerate(one.explained, 1)
    ]
    model = rows.sparkSession.createDataFrame(models, "d int, component int, n bigint, explained double, identity_error double")
    parts = back.select("id", F.size("x").alias("d"), "deviation", F.posexplode("whitened").alias("place", "whitened")).withColumn("component", F.col("place") + 1)
    return parts.join(F.broadcast(model), ["d", "component"]).select("id", "component", "n", "deviation", "whitened", "explained", "identity_error")
