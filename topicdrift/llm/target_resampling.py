"""Importance resampling towards a target: hashed word histograms, gains, Gumbel top-k.

1. An untrained pre-tokeniser (a Split on a pattern) returns the words of the ASCII-lowered text as
   pairs of offsets. Every window of 1 to `words` neighbouring pairs is a feature; its bucket is a
   CRC-32 modulo `buckets`. Texts are cut once; the bucket numbers are a written table.
2. Tasks add up one histogram each; Spark adds these up. Histograms have `buckets` entries at
   most, whatever the input, so gains (log ratio of target to raw, in thousandths) fit a closure.
3. A document's weight is the sum of its features' gains. With a Gumbel number from a hash of its id
   added, the highest scores are a sample without replacement in proportion to exp(weight).
4. The draw is a rank: range partitions and their offsets, no task sees all rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicdrift.operators.corpus import running_total
from topicdrift.runtime import stored

#: A word is a run of letters and digits of ASCII and of all other characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10

#: Characters handed to the pre-tokeniser at a time; cut where a word cannot be.
PIECE_CHARS = 1 << 20
#: Features whose buckets a task remembers, and bytes of buckets in a batch.
REMEMBERED = 1 << 20
BATCH_BYTES = 1 << 23


def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(WORD), "removed", invert=True)


def word_offsets(text: str, split) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Pieces of the text with the offsets of their words; no word crosses two pieces."""
    first = 0
    while first < len(text):
        end = len(text)
        if end - first > PIECE_CHARS:
            between = _BETWEEN.search(text, first + PIECE_CHARS)
            end = between.end() if between else end
        piece = text[first:end]
        yield piece, [pair for _, pair in split.pre_tokenize_str(piece)]
        first = end


def feature_buckets(text: str, split, words: int, buckets: int, known: dict[str, int]) -> tuple[int, np.ndarray]:
    """How many words the text has, and the bucket of each of its features."""
    listed = [piece[start:end] for piece, pairs in word_offsets(text.encode().lower().decode(), split) for start, end in pairs]
    out = []
    for n in range(1, words + 1):
        for window in listed if n == 1 else (" ".join(listed[i : i + n]) for i in range(len(listed) - n + 1)):
            bucket = known.get(window)
            if bucket is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                bucket = known[window] = zlib.crc32(window.encode()) % buckets
            out.append(bucket)
    return len(listed), np.array(out, dtype="<u4")


def featured(docs: DataFrame, words: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, found (buckets of all features as little-endian unsigned 32-bit integers). Null texts have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = splitter(), {}
        for batch in batches:
            ids, counts, cells, held = [], [], [], 0
            for i, text in enumerate(batch.column(1)):
                n, found = feature_buckets(text.as_py() or "", split, words, buckets, known)
                ids.append(i)
                counts.append(n)
                cells.append(found.tobytes())
                held += found.nbytes
                if held > BATCH_BYTES or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(ids)), pa.array(counts, pa.int64()), pa.array(cells, pa.binary())], ["id", "n_words", "found"],
                    )
                    ids, counts, cells, held = [], [], [], 0

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "id bigint, n_words bigint, found binary")


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for cell in batch.column(0):
                own += np.bincount(np.frombuffer(cell.as_buffer(), dtype="<u4"), minlength=buckets)
        full = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(own[full])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in features.select("found").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the smoothed log ratio of target to raw, in thousandths, rounded down."""
    all_raw, all_target, size = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([
        math.floor(1000 * math.log((t + 1) * (all_raw + size) / ((s + 1) * (all_target + size)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)
    ], dtype=np.int64)


def gumbel(key: str) -> int:
    """A standard Gumbel number in thousandths, rounded down, from 32 bits of a hash."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score. A null id is hashed as an empty text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(cell.as_buffer(), dtype="<u4") for cell in batch.column(2)]
            weights = [int(gain[one].sum()) for one in found]
            noise = [gumbel(f"{seed}:{'' if one is None else one}") for one in batch.column(0).to_pylist()]
            columns = [[len(one) for one in found], weights, [weight + more for weight, more in zip(weights, noise, strict=True)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in columns)], ["id", "n_words", "n_features", "weight", "score"])

    return features.mapInArrow(weigh, "id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def resampled(
    docs: DataFrame, target: DataFrame, *, words: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """id, n_words, n_features, weight, score, rank (1, 2, ... for drawn rows, else null); every row once.

    Drawn are `percent` of 100 of the rows with at least `least_words` words, highest scores first, ties
    to the smaller id, null ids last; rows of one id and score in any order. Null and empty texts have no
    feature and the weight 0. An empty target or an empty table is a histogram of zeros. Other columns are ignored.
    """
    features = stored(featured(docs, words, buckets, id_col, text_col))
    wanted = histogram(featured(target.select(F.lit(None).cast("bigint").alias("id"), F.col(target_text).alias("text")), words, buckets, "id"), buckets)
    gain = gains(histogram(features, buckets), wanted)
    rows = scored(features, gain, seed)
    rows = stored(rows.withColumns({"row": F.monotonically_increasing_id(), "fall": -F.col("score"), "nameless": F.col("id").isNull(), "one": F.lit(1).cast("bigint")}))
    able = F.col("n_words") >= least_words
    drawn = (rows.agg(F.count_if(able)).first()[0] * percent) // 100
    kept = ["n_words", "n_features", "weight", "score"]
    placed = running_total(rows.where(able), "one", [], ["fall", "nameless", "id", "row"], "place", kept)
    ranked = placed.select("id", *kept, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return ranked.union(rows.where(~able).select("id", *kept, F.lit(None).cast("bigint").alias("rank")))
