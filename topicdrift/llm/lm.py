"""Language-model scores from a log-frequency Bloom filter of word-pair counts.

A block of documents sends each of its distinct words and word pairs once, with the number of
times training documents of the block have it, to the part of an index that owns its hash. Parts
add up and answer the blocks that asked. Counts of words are exact. Counts of pairs are quantised
to powers of two and put into a Bloom filter, a segment for each part: a pair of level q enters as
(pair, 1) .. (pair, q), and a reader asks for level 1, 2, ... until one is missing. A segment is
sized by the entries it holds (`BITS_PER_ENTRY`), so its error rate does not depend on how large the
corpus is, and it stays in the task that owns the part: nothing of it is broadcast or collected.

The probability of a word w after v is (c(v, w) + k * p(w)) / (c(v) + k), with p(w) from exact
counts. A count read from a segment is multiplied by 1 - (its false-positive rate). k is the one of
`STRENGTHS` under which all training documents are likeliest, each without its own occurrences.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicdrift.llm.exchange import ROWS_PER_BLOCK, cells, in_blocks, joined, part_bounds, to_parts
from topicdrift.llm.words import Words, mix, pieces
from topicdrift.runtime import stored

#: Bits of the filter for each entry: with six probes 1 in 1000 absent entries is found by mistake.
BITS_PER_ENTRY = 16
LEAST_BYTES = 64
#: Bytes of text scored at a time.
SCORED_BYTES = 1 << 20
MOST_PROBES = 6
MOST_LEVELS = 40
STRENGTHS = tuple(10.0 ** (x / 2) for x in range(0, 13))

_END = np.uint64(0x3C6EF372FE94F82B)


def _tokens(words: Words) -> np.ndarray:
    """Hashes of the words of all texts, one end after each text."""
    texts = len(words.offsets) - 1
    out = np.full(len(words) + texts, _END)
    out[np.arange(len(words)) + words.doc] = words.hash
    return out


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token and the one before; the first of a text stands after an end."""
    before = np.r_[_END, tokens[:-1]]
    return mix(before * np.uint64(0x9FB21C651E98DF25) + mix(tokens))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = joined([x[0] for x in parts], "u8"), joined([x[1] for x in parts], "i8")
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, "i8")
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them; `_wide` takes the width from their number."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def _wide(cell: bytes, n: int) -> np.ndarray:
    return np.frombuffer(cell, f"u{len(cell) // n}").astype("i8")


class LogFrequencyFilter:
    """Segments of one Bloom filter; a key belongs to the segment that owns its range."""

    def __init__(self, segments: list[tuple[int, bytes, int]], parts: int, segment_bytes: int):
        self.parts, self.bits = parts, np.uint64(segment_bytes * 8)
        self.data = np.zeros((parts, segment_bytes), dtype=np.uint8)
        self.probes = np.ones(parts, dtype=np.int64)
        for part, bits, probes in segments:
            self.data[part], self.probes[part] = np.frombuffer(bits, "u1"), probes
        fill = np.unpackbits(self.data, axis=1).mean(axis=1) if self.data.size < 1 << 20 else _fill(self.data)
        self.trust = float(1 - np.mean(fill**self.probes))
        self.data = self.data.reshape(-1)
        self.segment_bytes = segment_bytes

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Highest level up to which all are found; 0 if the first is missing."""
        out = np.zeros(len(keys), dtype=np.int64)
        alive = np.arange(len(keys))
        segment = (((keys >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)).astype(np.int64)
        most = int(self.probes.max())
        for level in range(1, MOST_LEVELS + 1):
            hashes = _level_hash(keys[alive], level)
            for probe in range(most):
                at = _bit(hashes, probe, self.bits)
                place = segment[alive] * self.segment_bytes + (at >> np.uint64(3)).astype(np.int64)
                hit = (self.data[place] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                hit |= probe >= self.probes[segment[alive]]
                alive, hashes = alive[hit], hashes[hit]
            out[alive] = level
            if not len(alive):
                break
        return out


def _fill(data: np.ndarray) -> np.ndarray:
    ones = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
    return np.array([ones[row].mean() / 8 for row in data])


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64))


def _bit(hashes: np.ndarray, probe: int, bits: np.uint64) -> np.ndarray:
    other = mix(hashes + np.uint64(probe)) if probe else hashes
    return ((other >> np.uint64(32)) * bits) >> np.uint64(32)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def segment_size(counts: np.ndarray) -> int:
    """Bytes of a segment that gives every entry of the quantised counts its bits."""
    return max(LEAST_BYTES, math.ceil(int(_levels(counts).sum()) * BITS_PER_ENTRY / 8))


def fill_segment(keys: np.ndarray, counts: np.ndarray, segment_bytes: int) -> tuple[bytes, int]:
    """Bits of a segment that holds the quantised counts, and the number of probes."""
    levels = _levels(counts)
    entries, bits = max(1, int(levels.sum())), np.uint64(segment_bytes * 8)
    probes = int(min(MOST_PROBES, max(1, round(segment_bytes * 8 / entries * math.log(2)))))
    flags = np.zeros(segment_bytes * 8, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        hashes = _level_hash(keys[levels >= level], level)
        for probe in range(probes):
            flags[_bit(hashes, probe, bits).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes(), probes


#: Count that stands for a level: the geometric mean of its least and largest.
LEVEL_COUNT = np.array([0.0, *[math.sqrt(2.0 ** (q - 1) * max(2.0**q - 1, 1)) for q in range(1, MOST_LEVELS + 1)]])


def held_out(id_col: str, fold: int, folds: int = 5):
    """Whether crc32 of the id as text leaves `fold`; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def scored(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 1,
    filter_bytes: int | None = None, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Scores of all documents under a model of those that are not held out.

    Result: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are words with
    A-Z lowered and one end for each text; null texts are empty (one end). Scores are log10.
    Null ids are training documents. Rows that share an id are rows of their own. Other columns
    are ignored. Without training documents counts are 0 and both scores agree. An empty table
    gives none. The filter grows with the pairs; `filter_bytes` gives it a fixed size instead, and
    counts read from an overfull one fade to p(w).
    """
    held = held_out("id", fold)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("held", held)
    blocked, parts = in_blocks(rows, "id", "text", "held", rows_per_block=rows_per_block)
    fixed_bytes = None if filter_bytes is None else max(LEAST_BYTES, filter_bytes // parts)

    def ask(table: pa.Table) -> pa.Table:
        training, found = ~table["held"].to_numpy(zero_copy_only=False), ([], [])
        for first, data, offsets in pieces(table["text"]):
            words = Words(data, offsets, lower=True)
            tokens = _tokens(words)
            learnt = np.repeat(training[first : first + len(words.per_doc)], words.per_doc + 1).astype("i8")
            for own, keys in zip(found, (tokens, _pairs(tokens)), strict=True):
                own.append(_merged([(keys, learnt)]))
        out = []
        for kind, own in enumerate(found):
            keys, counts = _merged(own)
            sent, bounds = to_parts(table["block"][0].as_py(), keys, parts), part_bounds(keys, parts)
            narrow = [_narrow(counts[bounds[p] : bounds[p + 1]]) for p in sent["part"].to_pylist()]
            sent = sent.append_column("counts", pa.array(narrow, pa.binary()))
            out.append(sent.append_column("kind", pa.array(np.full(len(sent), kind), pa.int32())))
        return pa.concat_tables(out)

    def answer(asked: pa.Table) -> pa.Table:
        wanted = cells(asked["keys"], "u8")
        keys, counts = _merged([(x, _wide(cell, len(x))) for x, cell in zip(wanted, asked["counts"].to_pylist(), strict=True)])
        learnt, reply, trust = counts > 0, counts, 1.0
        if asked["kind"][0].as_py():
            size = fixed_bytes or segment_size(counts[learnt])
            pairs = LogFrequencyFilter([(0, *fill_segment(keys[learnt], counts[learnt], size))], 1, size)
            reply, trust = pairs.levels(keys), pairs.trust
        once = np.arange(len(wanted)) == 0
        return pa.table({
            "block": asked["block"], "part": asked["part"], "kind": asked["kind"],
            "reply": pa.array([_narrow(reply[np.searchsorted(keys, x)]) for x in wanted], pa.binary()),
            "trust": pa.array(np.full(len(wanted), trust)),
            "total": pa.array(once * counts.sum()), "distinct": pa.array(once * np.count_nonzero(learnt)),
        })

    by_block = blocked.groupBy("block")
    asked = by_block.applyInArrow(ask, "part int, block int, keys binary, counts binary, kind int")
    answers = stored(asked.groupBy("kind", "part").applyInArrow(
        answer, "block int, part int, kind int, reply binary, trust double, total long, distinct long"
    ))
    total, distinct = answers.where("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        seen: tuple[list, list] = ([], [])
        for _, data, offsets in pieces(table["text"]):
            tokens = _tokens(Words(data, offsets, lower=True))
            seen[0].append(np.unique(tokens))
            seen[1].append(np.unique(_pairs(tokens)))
        keys, pairs = (np.unique(joined(x, "u8")) for x in seen)
        counts = np.zeros(len(keys), dtype=np.int64)
        levels, trust = np.zeros(len(pairs), dtype=np.uint8), np.zeros(len(pairs))
        bounds = part_bounds(keys, parts), part_bounds(pairs, parts)
        for kind, part, reply, trusted in zip(*(answers[x].to_pylist() for x in ("kind", "part", "reply", "trust")), strict=True):
            own = slice(bounds[kind][part], bounds[kind][part + 1])
            found = _wide(reply, own.stop - own.start)
            if kind:
                levels[own], trust[own] = found, trusted
            else:
                counts[own] = found
        chance = (counts + 0.5) / (total + 0.5 * (distinct + 1))
        log_chance = np.log10(chance)
        training, out = ~table["held"].to_numpy(zero_copy_only=False), []
        for first, data, offsets in pieces(table["text"], SCORED_BYTES):
            texts = len(offsets) - 1
            words = Words(data, offsets, lower=True)
            tokens = _tokens(words)
            starts = words.first[:-1] + np.arange(texts)
            place = np.searchsorted(keys, tokens)
            own, p = counts[place].astype(float), chance[place]
            context = np.r_[float(counts[np.searchsorted(keys, _END)]), own[:-1]]
            pair = np.searchsorted(pairs, _pairs(tokens))
            after = np.minimum(LEVEL_COUNT[levels[pair]], np.minimum(own, context)) * trust[pair]
            learnt = np.repeat(training[first : first + texts], np.diff(np.r_[starts, len(tokens)]))
            less_after, less_context = np.maximum(after - learnt, 0), np.maximum(context - learnt, 0)
            scores, alone = np.empty((texts, len(STRENGTHS))), np.empty((texts, len(STRENGTHS)))
            for i, strength in enumerate(STRENGTHS):
                scores[:, i] = np.add.reduceat(np.log10((after + strength * p) / (context + strength)), starts)
                alone[:, i] = np.add.reduceat(np.where(learnt, np.log10((less_after + strength * p) / (less_context + strength)), 0), starts)
            out.append(pa.table({
                "id": table["id"].combine_chunks().slice(first, texts),
                "held_out": table["held"].combine_chunks().slice(first, texts),
                "n_tokens": pa.array(words.per_doc + 1),
                "n_known": pa.array(np.add.reduceat((own > 0).astype(np.int64), starts)),
                "base_score": pa.array(np.add.reduceat(log_chance[place], starts)),
                "scores": pa.array(list(scores), pa.list_(pa.float64())),
                "alone": pa.array(list(alone), pa.list_(pa.float64())),
            }))
        return pa.concat_tables(out)

    found = stored(by_block.cogroup(answers.groupBy("block")).applyInArrow(
        score, "id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, alone array<double>"
    ))
    sums = found.agg(*[F.sum(F.col("alone")[i]) for i in range(len(STRENGTHS))]).first()
    best = int(np.argmax([x if x is not None else -math.inf for x in sums]))
    return found.select(
        "id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", F.col("scores")[best].alias("score"), F.lit(STRENGTHS[best]).alias("strength"),
    )
