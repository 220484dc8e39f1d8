"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. A bounded sample of labelled rows (`SAMPLE_ROWS`) is drawn by a hash of the id; the rarer
   label gets up to half of it, and weights undo that. Rows of the held-out fold never enter.
2. Voters. Lexicon voters are the words and word beginnings whose rate differs most between the
   labels; each fires above a rate of its own. Pattern voters fire on shouting, exclamations,
   symbols and repeated words. The given label is one more voter.
3. The label model is a latent class with a firing rate of each voter in each class, fitted by
   expectation maximisation. It also estimates how voters correlate within a class: a voter's
   evidence is divided by one plus its correlations, so that voters that say the same thing are
   not counted as independent.
4. A logistic regression is trained on the posterior labels. Its features are the square roots
   of the rates of hashed words and word beginnings; a fifth of the sample is kept back to
   calibrate the score, so that 0.5 is where either label is as likely.

Scoring reads every text once, whole, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicdrift.llm.exchange import where_text
from topicdrift.llm.lm import held_out
from topicdrift.llm.words import Words, mix, pieces

#: Labelled rows that are drawn at most.
SAMPLE_ROWS = 10_000
FEATURE_BITS = 18
#: Bytes of a word's beginning that are features besides the word itself.
BEGINNINGS = (4, 6)
LEXICON_VOTERS = 64
LABEL_ROUNDS = 30
TRAIN_ROUNDS = 80
#: Texts of the sample that must have a feature of the classifier.
LEAST_TEXTS = 4
#: Rows of the sample that are summed together.
CHUNK_ROWS = 500
#: Greatest log-odds of a text without known features.
UNKNOWN = -0.4
_SIZE = 1 << FEATURE_BITS
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".,!?;:|*$%&#\"'()"]] = True


def _features(words: Words) -> list[np.ndarray]:
    """Hashed feature of each word, then of its beginnings (-1 where it is shorter)."""
    end = words.end.copy()
    for _ in range(4):
        end = end - (_STOPS[words.data[end - 1]] & (end - words.start > 1))
    cut = np.uint64(64 - FEATURE_BITS)
    out = [(mix(words.range_hash(words.start, end)) >> cut).astype(np.int64)]
    for size in BEGINNINGS:
        found = words.range_hash(words.start, np.minimum(words.start + size, end)) + np.uint64(size * 0x9E3779B97F4A7C15 % 2**64)
        out.append(np.where(end - words.start >= size, (mix(found) >> cut).astype(np.int64), -1))
    return out


def _counted(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times) of every feature of every text, in order of texts."""
    found = _features(words)
    key = np.concatenate([words.doc * _SIZE + own if i == 0 else (words.doc * _SIZE + own)[own >= 0] for i, own in enumerate(found)])
    key, times = np.unique(key, return_counts=True)
    return key >> FEATURE_BITS, key & (_SIZE - 1), times


def _patterns(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Shares of upper-case letters, of ! and of symbols among the bytes, and of words repeated at once."""
    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(mask)][offsets]) / np.maximum(np.diff(offsets), 1)

    again = np.bincount(words.doc[1:], (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1]), len(offsets) - 1)
    return np.stack([
        share((data >= 65) & (data <= 90)), share(data == 33), share(np.isin(data, np.frombuffer(b"#*$%&|<>", "u1"))),
        again / np.maximum(words.per_doc, 1),
    ], axis=1)


@dataclass
class Model:
    """weights of features, bias, and the calibration of the score (slope, shift)."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def chance(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (value + self.bias) + self.shift, -40, 40)))


def _adam(gradient, start: np.ndarray, rate: float, rounds: int) -> np.ndarray:
    at, first, second = start, np.zeros_like(start), np.zeros_like(start)
    for i in range(1, rounds + 1):
        slope = gradient(at)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        at = at - rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-9)
    return at


def label_model(votes: np.ndarray, given: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Posterior probability of label 1 for each row of the voters' 0/1 votes; `given` is the annotator's vote."""
    every = np.column_stack([given, votes]).astype(float)
    chance = np.where(given > 0, 0.95, 0.05)
    for _ in range(LABEL_ROUNDS):
        evidence, share = np.zeros(len(every)), {}
        rates, divisor = {}, np.ones(every.shape[1])
        for label, own in ((1, chance * weight), (0, (1 - chance) * weight)):
            total = own.sum() + 1e-9
            share[label] = total
            rates[label] = np.clip((own @ every + 0.5) / (total + 1), 1e-4, 1 - 1e-4)
            away = every - rates[label]
            spread = np.sqrt(np.maximum((own @ (away * away)) / total, 1e-9))
            related = (away.T * own) @ away / total / np.outer(spread, spread)
            np.fill_diagonal(related, 0)
            divisor = np.maximum(divisor, 1 + np.maximum(related, 0).sum(axis=1))
        divisor[0] = 1  # the annotator saw the text, not the voters
        yes = np.log(rates[1] / rates[0]) / divisor
        no = np.log((1 - rates[1]) / (1 - rates[0])) / divisor
        evidence = every @ yes + (1 - every) @ no + np.log(share[1] / share[0])
        chance = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
    return chance


class _Rates:
    """Square roots of the rates of the sample's features, row by row; sums go chunk by chunk."""

    def __init__(self, sample: list):
        seen = np.zeros(_SIZE, dtype=np.int32)
        for x in sample:
            seen[np.frombuffer(x.features, "<u4")] += 1
        common = seen >= LEAST_TEXTS  # what only a few texts have would be learnt by heart
        feature, value = [], []
        for x in sample:
            own = np.frombuffer(x.features, "<u4")
            keep = common[own]
            feature.append(own[keep].astype(np.int32))
            value.append(np.sqrt(np.frombuffer(x.times, "<u4")[keep] / max(x.n_words, 1)).astype(np.float32))
        self.rows = len(sample)
        self.starts = np.r_[0, np.cumsum([len(x) for x in feature])]
        self.feature, self.value = np.concatenate(feature), np.concatenate(value)

    def _chunks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        for a in range(0, self.rows, CHUNK_ROWS):
            b = min(self.rows, a + CHUNK_ROWS)
            own = slice(self.starts[a], self.starts[b])
            row = np.repeat(np.arange(b - a), np.diff(self.starts[a : b + 1]))
            yield a, b, row, self.feature[own], self.value[own]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """For each row the sum of its values times the features' weights."""
        return np.concatenate([np.bincount(row, value * weights[feature], b - a) for a, b, row, feature, value in self._chunks()])

    def back(self, weights: np.ndarray, power: int = 1) -> np.ndarray:
        """For each feature the sum of its values, to a power, times the rows' weights."""
        return sum(np.bincount(feature, value**power * weights[a:b][row], _SIZE) for a, b, row, feature, value in self._chunks())

    def columns(self, chosen: np.ndarray) -> np.ndarray:
        """Rates of some features as a dense matrix."""
        slot, out = np.full(_SIZE, -1), np.zeros((self.rows, len(chosen)))
        slot[chosen] = np.arange(len(chosen))
        for a, _, row, feature, value in self._chunks():
            own = slot[feature] >= 0
            out[a + row[own], slot[feature[own]]] = value[own] ** 2
        return out


def _votes(rates: _Rates, patterns: np.ndarray, given: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """0/1 votes of the lexicon and pattern voters."""
    ones, zeros = weight * (given > 0), weight * (given == 0)
    mean = [rates.back(own / own.sum(), 2) for own in (ones, zeros)]
    square = [rates.back(own / own.sum(), 4) for own in (ones, zeros)]
    spread = sum(np.maximum(s - m * m, 0) for s, m in zip(square, mean, strict=True))
    chosen = np.argsort(-(mean[0] - mean[1]) / np.sqrt(spread + 1e-9), kind="stable")[:LEXICON_VOTERS]
    values = np.column_stack([rates.columns(chosen), patterns])
    out = np.zeros(values.shape, dtype=bool)
    for j in range(values.shape[1]):
        positive = values[:, j][values[:, j] > 0]
        limits = np.unique(np.quantile(positive, np.linspace(0, 0.9, 10))) if len(positive) else [np.inf]
        gain = [ones[values[:, j] >= x].sum() / ones.sum() - zeros[values[:, j] >= x].sum() / zeros.sum() for x in limits]
        out[:, j] = values[:, j] >= limits[int(np.argmax(gain))]
    return out


def train(sample: list, share: float) -> Model:
    """Model of sampled rows (label, n_words, features, times, patterns); `share` is label 1's among all labelled rows."""
    given = np.array([x.label for x in sample], dtype=float)
    if not len(given) or given.min() == given.max():
        likely = float(np.clip(given.mean(), 0.01, 0.99)) if len(given) else 0.01
        return Model(np.zeros(_SIZE, dtype=np.float32), float(np.log(likely / (1 - likely))))
    rates, patterns = _Rates(sample), np.array([x.patterns for x in sample])
    sample.clear()
    weight = np.where(given > 0, share / given.mean(), (1 - share) / (1 - given.mean()))
    target = label_model(_votes(rates, patterns, given, weight), given, weight)

    kept = np.arange(rates.rows) % 5 == 0
    mass = np.where(kept, 0, weight) / weight[~kept].sum()
    # the bias is the prior, so that a text without known features has it, too
    prior = float(np.log(share / (1 - share)))

    def gradient(at: np.ndarray) -> np.ndarray:
        off = mass * (1 / (1 + np.exp(-np.clip(rates.dot(at) + prior, -30, 30))) - target)
        return rates.back(off) + 1e-5 * at

    at = _adam(gradient, np.zeros(_SIZE), 0.3, TRAIN_ROUNDS)
    own, mass = (rates.dot(at) + prior)[kept], (weight / weight[kept].sum())[kept]
    bounded = np.clip(target[kept], 0.01, 0.99)

    def calibration(at: np.ndarray) -> np.ndarray:
        off = mass * (1 / (1 + np.exp(-np.clip(at[0] * own + at[1], -30, 30))) - bounded)
        return np.array([(off * own).sum(), off.sum()])

    slope, shift = _adam(calibration, np.array([1.0, 0.0]), 0.05, 1500) if target[kept].min() < 0.5 < target[kept].max() else (1.0, 0.0)
    slope = float(max(slope, 0.1))
    # calibration must not call a text toxic of which nothing is known
    return Model(at.astype(np.float32), prior, slope, float(min(shift, UNKNOWN - slope * prior)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fold: int = 0, rows: int = SAMPLE_ROWS) -> Model:
    """Model of `rows` labelled documents at most, none of the held-out fold.

    Labels without an id or a value do not count; an id labelled twice has its larger label.
    Of rows with one id the smallest text counts. Documents without text are empty. Without both
    labels the score is a constant.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id", fold))
    own = own.groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    ones, every = own.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    rare = 1 if ones * 2 <= every else 0
    few = min(rows // 2, ones if rare else every - ones)
    order = F.xxhash64("id", F.lit(5))
    drawn = own.where(F.col("label") == rare).orderBy(order, "id").limit(few).union(own.where(F.col("label") != rare).orderBy(order, "id").limit(rows - few))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in pieces(batch.column("text")):
                texts = len(offsets) - 1
                words = Words(data, offsets, lower=True)
                row, feature, times = _counted(words)
                cuts = np.searchsorted(row, np.arange(texts + 1))
                cut = lambda x: [x[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(first, texts), batch.column("label").slice(first, texts), pa.array(words.per_doc),
                    pa.array(cut(feature), pa.binary()), pa.array(cut(times), pa.binary()),
                    pa.array(list(_patterns(data, offsets, words)), pa.list_(pa.float64())),
                ], ["id", "label", "n_words", "features", "times", "patterns"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(drawn), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))
    found = texts.select("id", "label", "text").mapInArrow(count, "id long, label int, n_words long, features binary, times binary, patterns array<double>")
    sample = sorted(found.collect(), key=lambda x: (mix(np.array([x.id], dtype=np.int64).view(np.uint64))[0], x.id, x.n_words))
    return train(sample, ones / max(every, 1))


def _chances(texts: pa.Array, model: Model) -> np.ndarray:
    values = []
    for _, data, offsets in pieces(texts):
        words = Words(data, offsets, lower=True)
        row, feature, times = _counted(words)
        share = np.sqrt(times / words.per_doc[row]) if len(row) else times
        values.append(np.bincount(row, share * model.weights[feature], len(offsets) - 1))
    return model.chance(np.concatenate(values) if values else np.zeros(0))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """id and score (0 to 1) of every document.

    Null and empty texts have the score of a text without features. Null ids stay null; repeated
    rows are scored each. An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = _chances(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(chance, pa.float64())], ["id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(score, "id long, score double")


def kept(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """Rows whose score is below the limit; same columns. Every row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return where_text(docs, lambda texts: _chances(texts, shared.value) < limit)
