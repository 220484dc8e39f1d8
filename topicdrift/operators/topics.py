"""Topic models by online variational inference, with the topics as a table of terms.

A model is a table ``(term_id, weights)``, an array of k weights per term; the driver holds a few
numbers per topic only, so a vocabulary has no limit.

* Rows are dealt once, by a hash of their keys, into slices (mini-batches); an iteration reads one
  slice. Inside a slice, rows are in blocks of about `BLOCK_ENTRIES` entries, and a block asks for
  each of its distinct terms once, however many of its rows hold it.
* Terms are dealt into parts. What a block and a part tell each other is one row of packed numbers, so
  what Spark shuffles are some thousand rows an iteration, however many terms these hold.
* A term's weights are written by the slice that touched it, addressed to the slice that will ask
  for it next. An iteration thus reads and writes the terms of its own slice only.
* Weights that are not touched decay by the same factor; it is applied when they are read.
* Starting weights follow from a hash of term, topic and seed and are not stored.
* Topics of at most `FIT_LIMIT_BYTES` are held by the driver instead, which broadcasts those of the slice's terms in each
  iteration: blocks need not ask, rows stay where they are, and only sums of the slice's terms are shuffled.

Without the broadcast every iteration is a written table, so a lost executor costs a part of one iteration. The same rows
and seed give the same model, up to the order in which tasks' sums are added.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.special import digamma, exp_digamma, gamma_drawn, log_gamma, mixed, trigamma
from ..runtime import (
    BROADCAST_LIMIT_BYTES, PACKED, broadcast_if_small, discard, intermediate_tables, new_table_path, release_shuffles, side_by_side, stored,
)
from .vectors import entries

DISTRIBUTION = "topicDistribution"

#: Entries (terms of a row) of a block, and blocks of a slice at least.
BLOCK_ENTRIES = 1 << 19
LEAST_BLOCKS = 24

#: Terms of a part, and parts at least.
PART_TERMS = 1 << 18
LEAST_PARTS = 16

#: Weights of a row of a written table, in bytes, and iterations after which shuffle files are released.
ROW_BYTES = 1 << 20
RELEASE_EVERY = 10

#: Topics of at most this size are held by the driver while they are fitted, and broadcast.
FIT_LIMIT_BYTES = BROADCAST_LIMIT_BYTES
#: Bytes of sums that travel as one row, and sums a task may send to the driver without a shuffle.
PART_BYTES = 1 << 20

#: Rows whose topic weights are found together: numbers they fill, and the longest row that joins others.
GROUP_NUMBERS = 1 << 17
GROUP_LENGTH = 1 << 11

# The usual learning rate (offset + iteration) ** -decay, and the start of the weights.
LEARNING_OFFSET = 1024.0
LEARNING_DECAY = 0.51
START_SHAPE = 100.0

#: A row's topic weights are found when they change by less than this on average.
CHANGE = 1e-3
ROUNDS = 100

_SCORE = "gamma array<double>, score double, mass double"
#: A block: its rows (part -1), and the terms it asks of each part, in the order of parts; and weights that slices have left.
_BLOCK = "slice int, block int, part int, ids binary, starts binary, places binary, values binary"
_BLOCK_NAMES = [field.split()[0] for field in _BLOCK.split(", ")]
_STATE = "part int, t int, ids binary, m binary"


@dataclass(frozen=True)
class TopicModel:
    """Topics as a stored table ``(term_id, weights)``; `totals` are the sums of the weights of each topic."""

    k: int
    terms: int
    alpha: tuple[float, ...]
    eta: float
    totals: tuple[float, ...]
    topics: DataFrame


@dataclass(frozen=True)
class Prepared:
    """Vectors dealt into slices and blocks, for one or more fits.

    `docs` ``(slice, block, indices, values)``; `asked` says which terms blocks and slices need, None if topics
    are small enough to be broadcast.
    Slices are numbered from 0 in the order of iterations; `rows` counts the rows of each. `touched` has a bit for each
    term of each slice, None if no topics will be broadcast.
    """

    docs: DataFrame
    asked: Asked | None
    rows: tuple[int, ...]
    terms: int
    touched: tuple[bytes, ...] | None = None


@dataclass(frozen=True)
class Asked:
    """`blocks` (see `_BLOCK`); `routes` ``(slice, part, next, ids)``: a slice's distinct terms by the slice that needs
    them next; `pairs` are the slices and next slices there are."""

    parts: int
    blocks: DataFrame
    routes: DataFrame
    pairs: frozenset[tuple[int, int]]


def _blocked(keys: Sequence[str | Column], seed: int, entry_count: int) -> Column:
    blocks = max(LEAST_BLOCKS, -(-entry_count // BLOCK_ENTRIES))
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), *keys), F.lit(blocks)).cast("int")


def prepare(
    vectors: DataFrame, keys: Sequence[str], seed: int, subsampling_rate: float = 0.05, k: int | None = None, least: int | None = None
) -> Prepared:
    """Slices of about `subsampling_rate` of the rows of ``features``; rows without entries take no part.

    ``keys`` identify a row and decide, with the seed, where it goes. ``k`` is the largest number of topics
    that will be fitted, ``least`` the smallest (else ``k``); if the largest are small enough to be broadcast, no block's
    terms are listed, and if not even the smallest are, rows are written as blocks only.
    """
    slices = max(1, round(1 / subsampling_rate))
    number = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(slices)).cast("int")
    rows = entries(vectors, keys).withColumn("raw", number)
    counted = rows.groupBy("raw").agg(
        F.count_if(F.size("indices") > 0).alias("rows"), F.sum(F.size("indices")).alias("entries"), F.max("size").alias("terms")
    ).collect()
    full = sorted((row for row in counted if row["rows"]), key=lambda row: row["raw"])
    if not full:
        raise ValueError("no row has a term of the vocabulary")
    order = F.array_position(F.array(*[F.lit(row["raw"]) for row in full]), F.col("raw")).cast("int") - 1
    block = _blocked(keys, seed, max(row["entries"] for row in full))
    dealt = rows.where(F.size("indices") > 0).select(order.alias("slice"), block.alias("block"), "indices", "values")
    terms = max(row["terms"] for row in counted)
    held = k is not None and _held(terms, least or k)
    docs = stored(dealt, partition_by=["slice"]) if k is None or held else dealt
    asked = None if k is not None and _held(terms, k) else _asked(docs, terms)
    return Prepared(docs, asked, tuple(row["rows"] for row in full), terms, _touched(docs, terms) if held else None)


def _held(terms: int, k: int) -> bool:
    """Whether topics are broadcast while they are fitted."""
    return 8 * k * terms <= FIT_LIMIT_BYTES


def _touched(docs: DataFrame, terms: int) -> tuple[bytes, ...]:
    """For each slice a bit for each term that its rows hold."""

    def mark(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            ids, starts = _lists(pa.chunked_array([batch.column(1)]), np.int64)
            of_entry = np.repeat(numbers, np.diff(starts))
            for number in np.unique(numbers).tolist():
                found.setdefault(number, np.zeros(terms, dtype=bool))[ids[of_entry == number]] = True
        yield from _bit_rows({number: np.packbits(own) for number, own in found.items()})

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, bits in zip(*(column.to_pylist() for column in batch.columns)):
                own = np.frombuffer(bits, np.uint8)
                found[number] = found[number] | own if number in found else own
        yield from _bit_rows(found)

    schema = "slice int, bits binary"
    rows = docs.select("slice", "indices").mapInArrow(mark, schema).repartition("slice").mapInArrow(merge, schema).toArrow()
    found = dict(zip(*(rows[name].to_pylist() for name in ("slice", "bits"))))
    return tuple(found[number] for number in range(len(found)))


def _bit_rows(found: Mapping[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for number, bits in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["slice", "bits"])


def _asked(docs: DataFrame, terms: int) -> Asked:
    """Blocks packed, with the terms they ask for; see `Asked`. A term's part is its id modulo their number."""
    parts = max(LEAST_PARTS, -(-terms // PART_TERMS))

    def pack(rows: pa.Table) -> pa.Table:
        (ids, starts), (values, _) = _lists(rows["indices"], np.int64), _lists(rows["values"], float)
        own, places = np.unique(ids % parts << 32 | ids, return_inverse=True)
        listed = (own & 0xFFFFFFFF).astype(np.int32)
        bounds = np.searchsorted(own >> 32, np.arange(parts + 1))
        full = np.flatnonzero(np.diff(bounds)).tolist()
        none = [None] * len(full)
        columns = [
            [rows["slice"][0].as_py()] * (1 + len(full)), [rows["block"][0].as_py()] * (1 + len(full)), [-1, *full],
            [None, *(listed[bounds[part]:bounds[part + 1]].tobytes() for part in full)],
            [starts.tobytes(), *none], [places.astype(np.int32).tobytes(), *none], [values.tobytes(), *none],
        ]
        return pa.table([pa.array(column, kind) for column, kind in zip(columns, [pa.int32()] * 3 + [pa.binary()] * 4)], _BLOCK_NAMES)

    def route(asks: pa.Table) -> pa.Table:
        listed = [np.frombuffer(ids, np.int32) for ids in asks["ids"].to_pylist()]
        slices = np.repeat(asks["slice"].to_numpy().astype(np.int64), [len(ids) for ids in listed])
        # Distinct pairs of term and slice, by term: the next one, or a term's first behind its last.
        pairs = np.unique(np.concatenate(listed).astype(np.int64) << 32 | slices)
        ids, slices = pairs >> 32, pairs & 0xFFFFFFFF
        first = np.r_[True, ids[1:] != ids[:-1]]
        starts = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
        following = np.where(np.r_[first[1:], True], slices[starts], np.r_[slices[1:], 0])
        way = slices << 32 | following
        order = np.argsort(way, kind="stable")
        ways, begins = np.unique(way[order], return_index=True)
        packed = [one.astype(np.int32).tobytes() for one in np.split(ids[order], begins[1:])]
        return pa.table({
            "slice": pa.array(ways >> 32, pa.int32()), "part": pa.array(np.full(len(ways), asks["part"][0].as_py()), pa.int32()),
            "next": pa.array(ways & 0xFFFFFFFF, pa.int32()), "ids": pa.array(packed, pa.binary()),
        })

    blocks = stored(docs.groupBy("slice", "block").applyInArrow(pack, _BLOCK), partition_by=["slice"], options=PACKED | {"compression": "zstd"})
    asks = blocks.where("part >= 0").select("slice", "part", "ids")
    routes = stored(asks.groupBy("part").applyInArrow(route, "slice int, part int, next int, ids binary"), partition_by=["slice"], options=PACKED)
    pairs = frozenset((row["slice"], row["next"]) for row in routes.select("slice", "next").distinct().collect())
    return Asked(parts, blocks, routes, pairs)


def _start(ids: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Starting weights of terms, a row of k for each."""
    places = ids.astype(np.uint64)[:, None] * np.uint64(k) + np.arange(k, dtype=np.uint64)
    return gamma_drawn(places + mixed(np.array([seed], dtype=np.int64)), START_SHAPE)


def _lists(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a list column and where each list starts (one more at the end); nulls are empty."""
    sizes = [0 if one is None else one for one in pa.compute.list_value_length(column).to_pylist()]
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(kind), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _matrix(column: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of k numbers, and which rows are null (their numbers are 0)."""
    null = column.is_null().to_numpy(zero_copy_only=False).astype(bool)
    out = np.zeros((len(null), k))
    if not null.all():
        out[~null] = column.drop_null().combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out, null


def _infer(counts: np.ndarray, weights: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Topic weights of a row, exp(E[log share]), and the normalisers of its terms.

    A factor that all shares have in common drops out of a round, so digamma of their sum is taken at the end only.
    """
    gamma = np.ones(len(alpha))
    share = exp_digamma(gamma)
    across = np.ascontiguousarray(weights.T)
    norm = share @ across + 1e-100
    for _ in range(ROUNDS):
        before = gamma
        gamma = share * (across @ (counts / norm)) + alpha
        share = exp_digamma(gamma)
        norm = share @ across + 1e-100
        if np.abs(gamma - before).mean() < CHANGE:
            break
    scale = np.exp(-digamma(gamma.sum(keepdims=True)))
    return gamma, share * scale, norm * scale


def _groups(sizes: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Rows with entries, in groups of about the same length that fill at most `GROUP_NUMBERS` numbers; long rows alone."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    first = 0
    while first < len(order):
        most = max(1, GROUP_NUMBERS // (k * int(sizes[order[first]])))
        rows = order[first:first + most]
        # Lengths rise: those that fit with the last one's length, none much longer than the first.
        lengths = sizes[rows]
        fits = (np.arange(1, len(rows) + 1) * lengths * k <= GROUP_NUMBERS) & (lengths <= GROUP_LENGTH) & (lengths <= 2 * lengths[0] + 8)
        rows = rows[:max(1, len(rows) if fits.all() else int(fits.argmin()))]
        yield rows
        first += len(rows)


def _infer_all(
    places: np.ndarray, starts: np.ndarray, counts: np.ndarray, weights: np.ndarray, alpha: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_infer` of every row with entries: gammas and shares, a row of k for each (1 and 0 without entries), and the norms of all entries.

    Rows of about the same length go through the rounds together, as matrices filled up with terms of no
    weight; rows that have settled leave, and when half of the room is free the next group joins those
    that go on, so that few slow rows never fill rounds of their own.
    """
    k, sizes = len(alpha), np.diff(starts)
    gammas, shares, norms = np.ones((len(sizes), k)), np.zeros((len(sizes), k)), np.ones(len(counts))
    rows, done = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    n, own, gamma = np.empty((0, 0)), np.empty((0, k, 0)), np.empty((0, k))
    share, norm, still = gamma, n, np.empty(0, dtype=bool)
    scaled = sizes == 0
    groups = _groups(sizes, k)
    group = next(groups, None)
    while len(rows) or group is not None:
        while group is not None and 2 * len(rows) * int(sizes[group[-1]]) * k <= GROUP_NUMBERS:
            if len(group) == 1:
                place, entries_of = int(group[0]), slice(starts[group[0]], starts[group[0] + 1])
                gammas[place], shares[place], norms[entries_of] = _infer(counts[entries_of], weights[places[entries_of]], alpha)
                scaled[place] = True
            else:
                width = int(sizes[group].max())
                there = np.arange(width) < sizes[group][:, None]
                at = np.where(there, starts[group][:, None] + np.arange(width), 0)
                wider, wider_own = np.zeros((len(rows) + len(group), width)), np.zeros((len(rows) + len(group), k, width))
                wider[:len(rows), :n.shape[1]], wider_own[:len(rows), :, :n.shape[1]] = n, own
                wider[len(rows):] = np.where(there, counts[at], 0.0)
                np.multiply(weights.take(places[at], axis=0).transpose(0, 2, 1), there[:, None, :], out=wider_own[len(rows):])
                n, own = wider, wider_own
                gamma = np.concatenate([gamma, np.ones((len(group), k))])
                share = np.concatenate([share, exp_digamma(np.ones((len(group), k)))])
                norm = np.matmul(share[:, None, :], own)[:, 0] + 1e-100
                rows, still = np.concatenate([rows, group]), np.concatenate([still, np.ones(len(group), dtype=bool)])
                done = np.concatenate([done, np.zeros(len(group), dtype=np.int64)])
            group = next(groups, None)
        if not len(rows):
            continue
        before = gamma
        gamma = np.matmul(own, (n / norm)[:, :, None])[:, :, 0]
        gamma *= share
        gamma += alpha
        share = exp_digamma(gamma)
        norm = np.matmul(share[:, None, :], own)[:, 0]
        norm += 1e-100
        done += 1
        settled = still & ((np.abs(gamma - before).sum(axis=1) < CHANGE * k) | (done >= ROUNDS))
        if settled.any():
            ended = rows[settled]
            gammas[ended], shares[ended] = gamma[settled], share[settled]
            there = np.arange(norm.shape[1]) < sizes[ended][:, None]
            norms[(starts[ended][:, None] + np.arange(norm.shape[1]))[there]] = norm[settled][there]
            still &= ~settled
            # Leaving costs a copy of all others, so several leave at once.
            if 4 * np.count_nonzero(still) <= 3 * len(rows):
                width = int(sizes[rows[still]].max(initial=0))
                left = np.flatnonzero(still)
                own = np.ascontiguousarray(own.take(left, axis=0)[:, :, :width])
                n, norm = n.take(left, axis=0)[:, :width], norm.take(left, axis=0)[:, :width]
                rows, done, gamma, share, still = rows[left], done[left], gamma[left], share[left], still[left]
    scale = np.where(scaled, 1.0, np.exp(-digamma(gammas.sum(axis=1))))
    return gammas, shares * scale[:, None], norms * np.repeat(scale, sizes)


def _infer_rows(
    places: np.ndarray, starts: np.ndarray, counts: np.ndarray, weights: np.ndarray, alpha: np.ndarray
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """`_infer` of every row with entries: ``(row, gamma, share, norm)``, in order."""
    gammas, shares, norms = _infer_all(places, starts, counts, weights, alpha)
    for row in np.flatnonzero(np.diff(starts)).tolist():
        yield row, gammas[row], shares[row], norms[starts[row]:starts[row + 1]]


def _learned(
    places: np.ndarray, starts: np.ndarray, counts: np.ndarray, weights: np.ndarray, alpha: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """What rows add to each of their terms, a row of k for each row of `weights`, and the rows' summed expected log shares."""
    gammas, shares, norms = _infer_all(places, starts, counts, weights, alpha)
    full = np.diff(starts) > 0
    rows, ratios = np.repeat(np.arange(len(full)), np.diff(starts)), counts / norms
    added = np.empty_like(weights)
    for topic in range(len(alpha)):
        added[:, topic] = np.bincount(places, ratios * shares[rows, topic], minlength=len(weights))
    added *= weights
    return added, (digamma(gammas[full]) - digamma(gammas[full].sum(axis=1, keepdims=True))).sum(axis=0)


def _expected(weights: np.ndarray, eta: float, totals: np.ndarray) -> np.ndarray:
    """exp(E[log share of a term]) for rows of weights above `eta`, some rows at a time."""
    out, rows, total = np.empty_like(weights), max(1, GROUP_NUMBERS // weights.shape[1]), exp_digamma(totals)
    for first in range(0, len(weights), rows):
        out[first:first + rows] = exp_digamma(weights[first:first + rows] + eta) / total
    return out


def _alpha_step(alpha: np.ndarray, log_shares: np.ndarray, rows: int, rate: float) -> np.ndarray:
    """A Newton step for the prior of rows, given their summed expected log shares."""
    if len(alpha) < 2:
        return alpha
    gradient = rows * (digamma(alpha.sum(keepdims=True)) - digamma(alpha) + log_shares / rows)
    c, q = rows * trigamma(alpha.sum(keepdims=True)), -rows * trigamma(alpha)
    step = -(gradient - (gradient / q).sum() / (1 / c + (1 / q).sum())) / q
    after = alpha + rate * step
    return after if (after > 0).all() else alpha


def fit(
    vectors: DataFrame, keys: Sequence[str], k: int, max_iter: int, seed: int, subsampling_rate: float = 0.05,
    learning_offset: float = LEARNING_OFFSET, learning_decay: float = LEARNING_DECAY,
) -> TopicModel:
    """Online LDA over ``features``; the same seed and rows give the same model.

    Rows without entries take no part. Raises if no row has any.
    """
    path = new_table_path(vectors.sparkSession)
    with intermediate_tables(vectors.sparkSession):
        return _fit(prepare(vectors, keys, seed, subsampling_rate, k), k, max_iter, seed, learning_offset, learning_decay, path)


def fit_prepared(
    prepared: Prepared, k: int, max_iter: int, seed: int,
    learning_offset: float = LEARNING_OFFSET, learning_decay: float = LEARNING_DECAY,
) -> TopicModel:
    """A fit over vectors that are dealt already."""
    spark = prepared.docs.sparkSession
    path = new_table_path(spark)
    with intermediate_tables(spark):
        return _fit(prepared, k, max_iter, seed, learning_offset, learning_decay, path)


def _fit(prepared: Prepared, k: int, max_iter: int, seed: int, offset: float, exponent: float, path: str) -> TopicModel:
    spark, slices, terms, corpus = prepared.docs.sparkSession, len(prepared.rows), prepared.terms, sum(prepared.rows)
    if _held(terms, k):
        return _fit_held(prepared, k, max_iter, seed, offset, exponent, path)
    asked = prepared.asked or _asked(prepared.docs, terms)
    eta, alpha = 1.0 / k, np.full(k, 1.0 / k)
    above = _start_totals(spark, terms, k, seed) - terms * eta  # sums of what weights have above eta
    rates = [(offset + t) ** -exponent for t in range(1, max_iter + 1)]
    tables: list[str] = []

    def left(last: int) -> list[float]:
        """For t from 0 to `last`, what is left after iteration `last` of weights that none after t touched."""
        return [float(np.prod([1 - rate for rate in rates[t:last]])) for t in range(last + 1)]

    def written(last: int, wanted) -> DataFrame:
        """Rows of the last tables that are addressed to a slice that is `wanted` in an iteration."""
        paths = [
            f"{tables[t - 1]}/next={following}"
            for t in range(max(0, last - slices) + 1, last + 1)
            for number, following in sorted(asked.pairs) if number == (t - 1) % slices and wanted(t, following)
        ]
        return spark.read.schema(_STATE).parquet(*paths) if paths else spark.createDataFrame([], _STATE)

    for t in range(1, max_iter + 1):
        number, rate = (t - 1) % slices, rates[t - 1]
        batch = prepared.rows[number]
        blocks, routes = (table.where(F.col("slice") == number) for table in (asked.blocks, asked.routes))
        had = written(t - 1, lambda _, following: following == number)
        known = _known(k, eta, seed, left(t - 1))
        needs = blocks.where("part >= 0").select("part", "block", "ids").unionByName(routes.select("part", "next", "ids"), True).unionByName(had, True)
        answers = needs.groupBy("part").applyInArrow(_answer(known, eta, terms * eta + above), "block int, part int, weights binary")
        docs = blocks.where("part < 0").select("block", "starts", "places", "values")
        sums = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_learn(alpha, rate * corpus / batch), "block int, part int, sums binary")
        after = sums.groupBy("part").cogroup(needs.groupBy("part")).applyInArrow(_merge(known, k, t, rate), f"next int, {_STATE}")
        tables.append(new_table_path(spark))
        # One file for each slice that comes next and some parts.
        some = F.pmod("part", F.lit(-(-asked.parts // LEAST_PARTS)))
        after.repartition("next", some).write.options(**PACKED, compression="none").partitionBy("next").parquet(tables[-1])
        totals = sum(np.frombuffer(row["m"]) for row in spark.read.schema(_STATE).parquet(f"{tables[-1]}/next=-1").collect())
        above = (1 - rate) * above + totals[:k]
        alpha = _alpha_step(alpha, totals[k:], batch, rate)
        # All that this one addressed has been read by now.
        if t > slices:
            discard(spark, tables[t - slices - 1])
        if t % RELEASE_EVERY == 0:
            release_shuffles(spark)

    # A row is up to date if the slice it is addressed to has not come since it was written.
    touched = written(max_iter, lambda t, following: t + 1 + (following - (t - 1) % slices - 1) % slices > max_iter)
    finish = _finish(_known(k, eta, seed, left(max_iter)), eta, terms, asked.parts)
    every = spark.range(asked.parts).select(F.col("id").cast("int").alias("part"))
    every.groupBy("part").cogroup(touched.groupBy("part")).applyInArrow(finish, "term_id int, weights array<double>").write.parquet(path)
    topics = spark.read.schema("term_id int, weights array<double>").parquet(path)
    return TopicModel(k, terms, tuple(alpha.tolist()), eta, tuple((terms * eta + above).tolist()), topics)


def _fit_held(prepared: Prepared, k: int, max_iter: int, seed: int, offset: float, exponent: float, path: str) -> TopicModel:
    """The iterations of `_fit` for topics of at most `FIT_LIMIT_BYTES`, which the driver holds and broadcasts."""
    spark, slices, terms, corpus = prepared.docs.sparkSession, len(prepared.rows), prepared.terms, sum(prepared.rows)
    eta, alpha = 1.0 / k, np.full(k, 1.0 / k)
    span = max(1, PART_BYTES // (8 * k))
    had = np.empty((terms, k))
    for first in range(0, terms, span):
        had[first:first + span] = _start(np.arange(first, min(first + span, terms)), k, seed) - eta
    touched = prepared.touched or _touched(prepared.docs, terms)
    batches = [prepared.docs.where(F.col("slice") == number).select("indices", "values") for number in range(slices)]
    for t in range(1, max_iter + 1):
        number, rate = (t - 1) % slices, (offset + t) ** -exponent
        batch = prepared.rows[number]
        own = np.flatnonzero(np.unpackbits(np.frombuffer(touched[number], np.uint8), count=terms)).astype(np.int32)
        held, parts = spark.sparkContext.broadcast((own, had[own])), -(-len(own) // span)
        step = _held_step(held, terms, span, alpha, eta, terms * eta + had.sum(axis=0), rate * corpus / batch)
        found = batches[number].mapInArrow(step, _PART)
        if parts > 1:
            found = found.repartition(min(parts, spark.sparkContext.defaultParallelism), "part").mapInArrow(_added_up(k), _PART)
        had *= 1 - rate
        log_shares = np.zeros(k)
        for piece in found.toArrow().to_batches():
            for part, places, sums in zip(*(column.to_pylist() for column in piece.columns)):
                numbers = np.frombuffer(sums).reshape(-1, k)
                if part < 0:
                    log_shares += numbers[0]
                else:
                    had[own[np.frombuffer(places, np.int32)]] += numbers
        held.destroy()
        alpha = _alpha_step(alpha, log_shares, batch, rate)
        if t % RELEASE_EVERY == 0:
            release_shuffles(spark)

    held = spark.sparkContext.broadcast(had)

    def finish(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            weights = pa.array((held.value[ids] + eta).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(ids) + 1, k, dtype=np.int32)), weights)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), lists], ["term_id", "weights"])

    spark.range(terms).mapInArrow(finish, "term_id int, weights array<double>").write.parquet(path)
    held.destroy()
    topics = spark.read.schema("term_id int, weights array<double>").parquet(path)
    return TopicModel(k, terms, tuple(alpha.tolist()), eta, tuple((terms * eta + had.sum(axis=0)).tolist()), topics)


#: Sums of some terms: their places and k numbers for each, as bytes; part -1 has sums over rows.
_PART = "part int, ids binary, sums binary"


def _part_rows(rows: Sequence[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], ["part", "ids", "sums"])


def _held_step(held, terms: int, span: int, alpha: np.ndarray, eta: float, totals: np.ndarray, scale: float):
    """Of all rows of a task: what they add to each of their terms, in parts of `span` terms, and their expected log shares.

    `held` has the slice's terms and their weights; a term is named by its place there.
    """
    k = len(alpha)

    def step(batches):
        ids, had = held.value
        place = np.zeros(terms, dtype=np.int32)
        place[ids] = np.arange(len(ids))
        sums, touched, log_shares = np.zeros_like(had), np.zeros(len(had), dtype=bool), np.zeros(k)
        for batch in batches:
            docs = pa.Table.from_batches([batch])
            (indices, starts), (counts, _) = _lists(docs["indices"], np.int64), _lists(docs["values"], float)
            indices = place[indices]
            own = np.zeros(len(had), dtype=bool)
            own[indices] = True
            listed = np.flatnonzero(own)
            places = (np.cumsum(own) - 1)[indices]
            weights = _expected(had[listed], eta, totals)
            added, logs = _learned(places, starts, counts, weights, alpha)
            log_shares += logs
            sums[listed] += added
            touched |= own
        places = np.flatnonzero(touched).astype(np.int32)
        yield _part_rows([(-1, b"", log_shares.tobytes())])
        for part, first in enumerate(range(0, len(had), span)):
            listed = places[slice(*np.searchsorted(places, [first, first + span]))]
            if len(listed):
                yield _part_rows([(part, listed.tobytes(), (sums[listed] * scale).tobytes())])

    return step


def _added_up(k: int):
    """Rows of the same part added up."""

    def add(batches):
        found: dict[int, dict] = {}
        for batch in batches:
            for part, ids, sums in zip(*(column.to_pylist() for column in batch.columns)):
                numbers, listed = np.frombuffer(sums).reshape(-1, k), np.frombuffer(ids, np.int32)
                if part not in found:
                    found[part] = listed, numbers
                    continue
                known, so_far = found[part]
                if part < 0:
                    found[part] = known, so_far + numbers
                    continue
                every = np.union1d(known, listed)
                total = np.zeros((len(every), k))
                total[np.searchsorted(every, known)] = so_far
                total[np.searchsorted(every, listed)] += numbers
                found[part] = every, total
        for part, (ids, numbers) in found.items():
            yield _part_rows([(part, ids.astype(np.int32).tobytes(), numbers.tobytes())])

    return add


def _start_totals(spark, terms: int, k: int, seed: int) -> np.ndarray:
    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"sums": [_start(batch.column(0).to_numpy(), k, seed).sum(axis=0).tolist()]})

    sums = spark.range(terms).mapInArrow(add, "sums array<double>")
    return np.array(sums.agg(F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(k)])).first()[0])


def _known(k: int, eta: float, seed: int, left: Sequence[float]):
    """What sorted terms have above `eta`: rows written in iteration t have kept `left[t]`, others so much of their start."""

    def known(ids: np.ndarray, states: pa.Table) -> np.ndarray:
        had, missing = np.empty((len(ids), k)), np.ones(len(ids), dtype=bool)
        for t, own, m in zip(*(states[name].to_pylist() for name in ("t", "ids", "m"))):
            places = np.searchsorted(ids, np.frombuffer(own, np.int32))
            had[places] = np.frombuffer(m).reshape(-1, k) * left[t]
            missing[places] = False
        had[missing] = (_start(ids[missing], k, seed) - eta) * left[0]
        return had

    return known


def _needs(needs: pa.Table) -> tuple[pa.Table, pa.Table, pa.Table, np.ndarray]:
    """Of a part in an iteration: asks of blocks, routes, written rows, and all terms of the slice, sorted."""
    asks, others = needs.filter(needs["block"].is_valid()), needs.filter(needs["block"].is_null())
    routes, states = others.filter(others["next"].is_valid()), others.filter(others["next"].is_null())
    return asks, routes, states, np.sort(np.concatenate([np.frombuffer(ids, np.int32) for ids in routes["ids"].to_pylist()]))


def _answer(known, eta: float, totals: np.ndarray):
    """Of a part: the weights that each block asks for, as exp(E[log share])."""

    def answer(needs: pa.Table) -> pa.Table:
        asks, _, states, ids = _needs(needs)
        weights = _expected(known(ids, states), eta, totals)
        packed = [weights[np.searchsorted(ids, np.frombuffer(own, np.int32))].tobytes() for own in asks["ids"].to_pylist()]
        return pa.table({"block": asks["block"], "part": asks["part"], "weights": pa.array(packed, pa.binary())})

    return answer


def _learn(alpha: np.ndarray, scale: float):
    """Of a block: what its rows add to each of its terms, for each part; for part -1 the sums of that and the expected log shares."""
    k = len(alpha)

    def learn(docs: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        packed = [np.frombuffer(one).reshape(-1, k) for one in answers["weights"].to_pylist()]
        weights = np.concatenate(packed)
        starts, places, counts = (np.frombuffer(docs[name][0].as_py(), kind) for name, kind in (("starts", np.int64), ("places", np.int32), ("values", float)))
        added, log_shares = _learned(places, starts, counts, weights, alpha)
        added *= scale
        split = np.split(added, np.cumsum([len(one) for one in packed])[:-1])
        sums = [*(one.tobytes() for one in split), np.concatenate([added.sum(axis=0), log_shares]).tobytes()]
        block = docs["block"][0].as_py()
        return pa.table({
            "block": pa.array([block] * len(sums), pa.int32()),
            "part": pa.array([*answers["part"].to_pylist(), -1], pa.int32()), "sums": pa.array(sums, pa.binary()),
        })

    return learn


def _merge(known, k: int, t: int, rate: float):
    """Of a part: its terms' weights after iteration t, by the slice that needs them next; -1 has the sums of part -1."""

    def merge(sums: pa.Table, needs: pa.Table) -> pa.Table:
        if not len(needs):
            rows = [(-1, -1, None, np.sum([np.frombuffer(one) for one in sums["sums"].to_pylist()], axis=0).tobytes())]
        else:
            asks, routes, states, ids = _needs(needs)
            after = known(ids, states) * (1 - rate)
            asked = dict(zip(asks["block"].to_pylist(), asks["ids"].to_pylist()))
            for block, added in sorted(zip(sums["block"].to_pylist(), sums["sums"].to_pylist())):
                after[np.searchsorted(ids, np.frombuffer(asked[block], np.int32))] += np.frombuffer(added).reshape(-1, k)
            part, most = needs["part"][0].as_py(), max(1, ROW_BYTES // (8 * k))
            rows = []
            for following, own in zip(routes["next"].to_pylist(), routes["ids"].to_pylist()):
                listed = np.frombuffer(own, np.int32)
                for some in (listed[first:first + most] for first in range(0, len(listed), most)):
                    rows.append((following, part, some.tobytes(), after[np.searchsorted(ids, some)].tobytes()))
        following, parts, own, m = zip(*rows)
        return pa.table({
            "next": pa.array(following, pa.int32()), "part": pa.array(parts, pa.int32()), "t": pa.array([t] * len(rows), pa.int32()),
            "ids": pa.array(own, pa.binary()), "m": pa.array(m, pa.binary()),
        })

    return merge


def _finish(known, eta: float, terms: int, parts: int):
    """Weights of all terms of a part; those never touched have what is left of their start."""

    def finish(part: pa.Table, states: pa.Table) -> pa.Table:
        ids = np.arange(part["part"][0].as_py(), terms, parts, dtype=np.int32)
        weights = known(ids, states) + eta
        starts = np.arange(0, weights.size + 1, weights.shape[1], dtype=np.int32)
        return pa.table({"term_id": pa.array(ids), "weights": pa.ListArray.from_arrays(pa.array(starts), pa.array(weights.ravel()))})

    return finish


def fit_per_period(
    vectors: DataFrame, keys: Sequence[str], periods: Sequence[str], k: int, max_iter: int, seed: int,
    subsampling_rate: float = 0.05, parallelism: int = 1,
) -> dict[str, TopicModel]:
    """One model per period over the same vocabulary; periods without documents are left out.

    Vectors stored by period let each fit read its own folder only.
    """
    found = {row["period"] for row in vectors.select("period").distinct().collect()}
    present = [period for period in periods if period in found]
    models = side_by_side(
        vectors.sparkSession,
        lambda period: fit(vectors.where(F.col("period") == period), keys, k, max_iter, seed, subsampling_rate),
        present,
        parallelism,
    )
    return dict(zip(present, models))


def heaviest(model: TopicModel, n: int) -> DataFrame:
    """``(topic, rank, term_id, weight)``, weights of a topic adding up to 1 over all terms; ties to the smaller id.

    Each task sends its ``n`` heaviest terms of each topic.
    """
    totals, k = np.array(model.totals), model.k

    def best(batches):
        kept: list = [None] * k
        for batch in batches:
            ids, (weights, _) = batch.column(0).to_numpy(), _matrix(pa.chunked_array([batch.column(1)]), k)
            for j in range(k):
                own = np.stack([weights[:, j] / totals[j], ids]) if kept[j] is None else np.hstack([kept[j], [weights[:, j] / totals[j], ids]])
                kept[j] = own[:, np.lexsort((own[1], -own[0]))[:n]]
        for j, own in enumerate(kept):
            if own is not None:
                size = own.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, j, np.int32)), pa.array(own[1].astype(np.int32)), pa.array(own[0])], ["topic", "term_id", "weight"])

    found = model.topics.mapInArrow(best, "topic int, term_id int, weight double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term_id")))
    return ranked.where(F.col("rank") <= n).select("topic", "rank", "term_id", "weight")


def topic_terms(model: TopicModel, vocabulary: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` heaviest terms of each topic: ``(topic, rank, term, weight)``.

    The topics' k x n term ids are the broadcast side, if they measure small.
    """
    named = vocabulary.select("term_id", "term").join(broadcast_if_small(heaviest(model, n)), "term_id")
    return named.select("topic", "rank", "term", "weight")


def _score(ids, raw, indices, values, alpha, totals, complete) -> pa.StructArray:
    """Of each row of term ids and values: topic weights, score and mass; see `_scored`.

    `ids` are the sorted terms whose weights are the rows of `raw`; all terms of the rows are among them.
    """
    shares = raw / totals if complete else None
    (places, starts), (counts, _) = _lists(indices, np.int64), _lists(values, float)
    places = np.searchsorted(ids, places)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    given = (mixed(ids) & np.uint64(1)).astype(bool)[places] if complete else np.ones(len(places), dtype=bool)
    own, n = places[given], counts[given]
    known, own = np.unique(own, return_inverse=True)
    own_starts = np.searchsorted(rows[given], np.arange(len(starts)))
    gammas, _, norms = _infer_all(own, own_starts, n, _expected(raw[known], 0.0, totals), alpha)
    gammas[own_starts[:-1] == own_starts[1:]] = alpha
    scores = np.bincount(rows[given], n * np.log(norms), minlength=len(gammas))
    scored = counts
    if complete:
        scored = np.where(given, 0.0, counts)
        scores = np.zeros(len(gammas))
        for row in np.flatnonzero(np.bincount(rows[~given], minlength=len(gammas))).tolist():
            asked = np.arange(starts[row], starts[row + 1])[~given[starts[row]:starts[row + 1]]]
            scores[row] = (counts[asked] * np.log(shares[places[asked]] @ (gammas[row] / gammas[row].sum()))).sum()
    elif len(gammas):
        totals_of = gammas.sum(axis=1, keepdims=True)
        expected = digamma(gammas) - digamma(totals_of)
        scores += ((alpha - gammas) * expected).sum(axis=1) + (log_gamma(gammas) - log_gamma(alpha)).sum(axis=1)
        scores += log_gamma(alpha.sum(keepdims=True)) - log_gamma(totals_of)[:, 0]
    masses = np.bincount(rows, scored, minlength=len(gammas))
    gammas[starts[:-1] == starts[1:]] = 0.0
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, gammas.size + 1, gammas.shape[1], dtype=np.int32)), pa.array(gammas.ravel()))
    return pa.StructArray.from_arrays([lists, pa.array(scores, pa.float64()), pa.array(masses, pa.float64())], ["gamma", "score", "mass"])


def _scored(model: TopicModel, vectors: DataFrame, complete: bool = False, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``vectors`` with ``_gamma``, ``_score`` and ``_mass`` instead of the features.

    The score is a row's part of the variational bound, its mass the sum of its values. With `complete`,
    half of a row's terms (by a hash of the term) give its topics; the score is the log probability of
    the other half, whose mass it is.

    Topics of at most ``limit`` bytes are broadcast, and rows stay where they are, so that filters reach
    their scan. Otherwise blocks of rows ask for their terms.
    """
    kept = [F.col(f"`{name}`") for name in vectors.columns if name != "features"]
    k, alpha, totals, terms = model.k, np.array(model.alpha), np.array(model.totals), model.terms
    if 8 * k * terms <= limit:
        listed = model.topics.toArrow()
        order = np.argsort(listed["term_id"].to_numpy())
        held = vectors.sparkSession.sparkContext.broadcast(_matrix(listed["weights"], k)[0][order])

        def score(batches):
            for indices, values in batches:
                yield _score(np.arange(terms), held.value, pa.chunked_array([indices]), pa.chunked_array([values]), alpha, totals, complete)

        # The types of an iterator of several columns; annotations of this module are strings.
        score.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        parts = F.unwrap_udt("features")
        scored = vectors.select(*kept, F.arrow_udf(score, _SCORE)(parts["indices"], parts["values"]).alias("_scored"))
        return scored.select(*kept, *[F.col("_scored")[name].alias(f"_{name}") for name in ("gamma", "score", "mass")])

    names = [name for name in vectors.columns if name != "features"]
    rows = entries(vectors, [f"`{name}`" for name in names]).drop("size")
    total = rows.agg(F.coalesce(F.sum(F.size("indices")), F.lit(0))).first()[0]
    rows = rows.withColumn("_block", _blocked([*kept, "indices"], 0, total))
    parts = max(LEAST_PARTS, -(-terms // PART_TERMS))

    def ask(docs: pa.Table) -> pa.Table:
        ids, _ = _lists(docs["indices"], np.int64)
        own = np.unique(ids % parts << 32 | ids)
        bounds = np.searchsorted(own >> 32, np.arange(parts + 1))
        full, listed = np.flatnonzero(np.diff(bounds)).tolist(), own.astype(np.int32)
        block = docs["_block"][0].as_py() if len(docs) else 0
        return pa.table({
            "part": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()),
            "ids": pa.array([listed[bounds[part]:bounds[part + 1]].tobytes() for part in full], pa.binary()),
        })

    def answer(asks: pa.Table, own: pa.Table) -> pa.Table:
        order = np.argsort(own["term_id"].to_numpy())
        ids, weights = own["term_id"].to_numpy()[order], _matrix(own["weights"], k)[0][order]
        packed = [weights[np.searchsorted(ids, np.frombuffer(one, np.int32))].tobytes() for one in asks["ids"].to_pylist()]
        return pa.table({"block": asks["block"], "ids": asks["ids"], "weights": pa.array(packed, pa.binary())})

    def score_block(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(answers["ids"].to_pylist()), np.int32)
        weights = np.frombuffer(b"".join(answers["weights"].to_pylist())).reshape(-1, k)
        order = np.argsort(ids)
        found = _score(ids[order], weights[order], docs["indices"], docs["values"], alpha, totals, complete)
        return pa.table({name: docs[name] for name in names} | {f"_{name}": found.field(name) for name in ("gamma", "score", "mass")})

    asks = rows.select("_block", "indices").groupBy("_block").applyInArrow(ask, "part int, block int, ids binary")
    topics = model.topics.withColumn("part", F.pmod("term_id", F.lit(parts)))
    answers = asks.groupBy("part").cogroup(topics.groupBy("part")).applyInArrow(answer, "block int, ids binary, weights binary")
    fields = [T.StructField(name, rows.schema[name].dataType) for name in names]
    extra = T.StructType.fromDDL("_gamma array<double>, _score double, _mass double").fields
    return rows.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(score_block, T.StructType([*fields, *extra]))


def topic_distribution(model: TopicModel, vectors: DataFrame) -> DataFrame:
    """``vectors`` with the topic shares of each row as an array instead of the features.

    A row without a term of the vocabulary has shares of 0.
    """
    scored = _scored(model, vectors)
    kept = [name for name in vectors.columns if name != "features"]
    total = F.aggregate("_gamma", F.lit(0.0), lambda total, one: total + one)
    shares = F.transform("_gamma", lambda one: F.when(F.col("_total") > 0, one / F.col("_total")).otherwise(0.0))
    return scored.withColumn("_total", total).select(*[F.col(f"`{name}`") for name in kept], shares.alias(DISTRIBUTION))


def period_topic_distribution(models: Mapping[str, TopicModel], vectors: DataFrame) -> DataFrame:
    """Shares of each row under the model of its own period."""
    parts = [
        topic_distribution(model, vectors.where(F.col("period") == period))
        for period, model in models.items()
    ]
    if not parts:
        raise ValueError("no period has a model")
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def _topics_bound(model: TopicModel) -> float:
    """The part of the bound that depends on the topics alone."""
    totals, eta, k = np.array(model.totals), model.eta, model.k

    def add(batches):
        for batch in batches:
            weights, _ = _matrix(pa.chunked_array([batch.column(1)]), k)
            expected = digamma(weights) - digamma(totals)
            yield pa.RecordBatch.from_pydict({"part": [float(((eta - weights) * expected + log_gamma(weights) - log_gamma(np.array([eta]))).sum())]})

    whole = model.topics.mapInArrow(add, "part double").agg(F.sum("part")).first()[0]
    return whole + float((log_gamma(np.array([eta * model.terms])) - log_gamma(totals)).sum())


def log_perplexity(model: TopicModel, vectors: DataFrame) -> float:
    """Upper bound on the log-perplexity per unit of weight, on the given vectors."""
    score, mass = _scored(model, vectors).agg(F.sum("_score"), F.sum("_mass")).first()
    return -(score + _topics_bound(model)) / mass


def held_out(keys: Sequence[str], percent: int = 10, seed: int = 0) -> Column:
    """Whether a row belongs to the `percent` of 100 rows that a fit shall not see; follows from keys and seed."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("held out"), *keys), F.lit(100)) < percent


def held_out_log_perplexity(model: TopicModel, vectors: DataFrame) -> float:
    """Log-perplexity per unit of weight of rows the model has not seen, by completion.

    Half of the terms of each row give its topics (the topics of the model stay as they are); the
    other half is scored by the row's mixture of topics. No bound: values of any models compare.
    """
    score, mass = _scored(model, vectors, complete=True).agg(F.sum("_score"), F.sum("_mass")).first()
    return -score / mass
