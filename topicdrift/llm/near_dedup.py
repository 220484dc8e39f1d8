"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification.

1. Every text becomes a set of hashed word shingles, its size, a 128-bit hash of the set and 512
   MinHash values. Documents with one set are one class, a numbered row; only classes go on, so
   copies cost a row each and no pair.
2. The first 128 values, 16 bits of each, are cut into 32 bands of 4. Classes that agree in a
   band share a bucket. Of all values 8 bits are kept as the signature.
3. In each bucket all members are compared with its smallest one, the hub (no pairs of members).
4. Comparing reads signatures 16 values at a time. Matches so far give a Beta posterior of the
   similarity; a pair goes as soon as the probability that it reaches the threshold is below
   `MISS`. Survivors are verified exactly on their full shingle sets.
5. Verified links give components. Members of a bucket that are in different components may
   still be linked with each other: they are compared tile by tile, by step 4, and survivors are
   verified inside the tile, which holds the members' texts once. Pairs whose components are the
   same, or have been joined by a link found in the tile, need no check, as they cannot change
   the result. A tile returns the links that join components: fewer than it has members.

No pair of members leaves a tile. Joins are hinted to sort and merge, so that plans, and what
they cost, are alike at every size.

At the threshold a pair shares no bucket with probability (1 - 0.75**4)**32 = 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicdrift.llm.components import components
from topicdrift.llm.words import Words, mix, pieces
from topicdrift.runtime import stored

SHINGLE = 5
VALUES = 512
BAND = 4
BANDED = 128
BATCH = 16
#: Similarity in percent.
THRESHOLD = 75
MISS = 1e-6
#: Members of a side of a tile, and their shingles, on average; members compared at a time.
TILE = 1024
TILE_SHINGLES = 1 << 20
SLICE = 64

_RNG = np.random.default_rng(11)
_FLIP = _RNG.integers(0, 2**32, VALUES, dtype=np.uint32)
_FACTOR = _RNG.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array | pa.ChunkedArray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` lower-cased words.

    Fewer words give one hash of them all; no words and null texts give none.
    """
    for _, data, offsets in pieces(texts):
        words = Words(data, offsets, lower=True)
        grams = words.windows(size)
        for first, n in zip(words.first.tolist(), words.per_doc.tolist(), strict=False):
            if n >= size:
                own = np.sort(grams[first : first + n - size + 1])
                yield own[np.r_[True, own[1:] != own[:-1]]]
            elif n:
                whole = n
                for one in words.hash[first : first + n].tolist():
                    whole = (whole * 0x9E3779B97F4A7C15 + one) % 2**64
                yield mix(np.array([whole], dtype=np.uint64))
            else:
                yield grams[:0]


def signatures(sets: list[np.ndarray]) -> list[tuple[bytes, list[int]] | tuple[None, None]]:
    """Signature and band keys of each set; None for an empty one."""
    full = [i for i, own in enumerate(sets) if len(own)]
    out: list = [(None, None)] * len(sets)
    if full:
        values = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        found = np.empty((len(full), VALUES), dtype=np.uint32)
        for j in range(VALUES):
            found[:, j] = np.minimum.reduceat((values ^ _FLIP[j]) * _FACTOR[j], starts)
        found *= np.uint32(0x9E3779B1)
        bands = np.ascontiguousarray((found[:, :BANDED] >> np.uint32(16)).astype("<u2")).view("<i8")
        short = (found >> np.uint32(24)).astype(np.uint8)
        for i, row, keys in zip(full, short, bands, strict=True):
            out[i] = row.tobytes(), keys.tolist()
    return out


def sketched(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """id, key, n_shingles, class_a and class_b (a hash of the set), signature, bands of rows (id, key, text)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, rows = [], []

            def flush(sets=sets, rows=rows) -> None:
                for own, (signature, bands) in zip(sets, signatures(sets), strict=True):
                    a, b = (int(np.sum(mix(own ^ np.uint64(salt)), dtype=np.uint64).astype(np.int64)) for salt in (0, 0x5851F42D4C957F2D))
                    rows.append((len(own), a, b, signature, bands))
                sets.clear()

            held = 0
            for own in shingle_sets(batch.column(2), size):
                sets.append(own)
                held += len(own)
                if held > 1 << 18:
                    flush()
                    held = 0
            flush()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays], ["id", "key", "n_shingles", "class_a", "class_b", "signature", "bands"]
            )

    return docs.mapInArrow(sketch, "id long, key binary, n_shingles long, class_a long, class_b long, signature binary, bands array<long>")


def least_matches(threshold: int = THRESHOLD, miss: float = MISS) -> list[int]:
    """For 16, 32, ... values compared: fewer matches make the threshold less likely than `miss`."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    logs, out = (np.log(grid), np.log1p(-grid)), []
    for n in range(BATCH, VALUES + 1, BATCH):
        least = 0
        for m in range(n + 1):
            weight = m * logs[0] + (n - m) * logs[1]
            weight = np.exp(weight - weight.max())
            if weight[grid >= threshold / 100].sum() / weight.sum() >= miss:
                least = m
                break
        out.append(least)
    return out


def survivors(
    a: np.ndarray, b: np.ndarray, needed: list[int], left: np.ndarray | None = None, right: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows of two signature matrices no batch prunes, and how many of their values match.

    Pairs are (left[0], right[0]), ...; without these, rows are compared one to one.
    """
    left = np.arange(len(a)) if left is None else left
    right = np.arange(len(b)) if right is None else right
    alive, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
    for step, least in enumerate(needed):
        own = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (a[left[alive], own] == b[right[alive], own]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive, matches


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, VALUES)


def _pruned(pairs: DataFrame, classes: DataFrame, threshold: int, miss: float) -> DataFrame:
    """Pairs (a, b) that Bayesian comparison of their signatures leaves."""
    needed = least_matches(threshold, miss)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, _ = survivors(_matrix(batch.column("sa")), _matrix(batch.column("sb")), needed)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    own = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    other = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold
    both = pairs.hint("merge").join(other, "b").hint("merge").join(own, "a").where(fits)
    return both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int, size: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold, with both counts. Stored."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs: dict[int, int] = {}
            first = [hubs.setdefault(a, i) for i, a in enumerate(batch.column("a").to_pylist())]
            own = dict(zip(hubs.values(), shingle_sets(batch.column("ta").take(pa.array(list(hubs.values()), pa.int64())), size), strict=True))
            same, union = [], []
            for i, other in zip(first, shingle_sets(batch.column("tb"), size), strict=True):
                mine = own[i]
                small, large = (mine, other) if len(mine) < len(other) else (other, mine)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                same.append(int((large[place] == small).sum()) if len(small) else 0)
                union.append(len(mine) + len(other) - same[-1])
            found = batch.select(["a", "b"]).append_column("same", pa.array(same, pa.int64())).append_column("united", pa.array(union, pa.int64()))
            yield found.filter(pa.array([100 * x >= threshold * y > 0 for x, y in zip(same, union, strict=True)], pa.bool_()))

    other, own = (texts.select(F.col("rep").alias(name), F.col("text").alias(f"t{name}")) for name in "ba")
    both = pairs.hint("merge").join(other, "b").hint("merge").join(own, "a")
    return stored(both.mapInArrow(check, "a long, b long, same long, united long"))


class _Tile:
    """Two sides of classes of one bucket; finds the links that join their components."""

    def __init__(self, left: pa.Table, right: pa.Table, band: int, threshold: int, size: int, needed: list[int]) -> None:
        self.sides, self.band, self.threshold, self.size, self.needed = (left, right), band, threshold, size, needed
        self.node, self.component, self.n = ([side[name].to_numpy() for side in self.sides] for name in ("rep", "component", "n_shingles"))
        self.signature = [_matrix(side["signature"]) for side in self.sides]
        self.bands = [np.array(side["bands"].to_pylist(), dtype=np.int64).reshape(-1, BANDED // BAND) for side in self.sides]
        self.joined: dict[int, int] = {}
        self._coded: list[list[np.ndarray]] | None = None

    def _root(self, x: int) -> int:
        while (up := self.joined.get(x, x)) != x:
            self.joined[x] = x = self.joined.get(up, up)
        return x

    def coded(self, side: int, place: int) -> np.ndarray:
        """A member's shingles as numbers from 0 to `self.codes`."""
        if self._coded is None:
            sets = [list(shingle_sets(one["text"], self.size)) for one in self.sides]
            lengths = [len(own) for one in sets for own in one]
            known, codes = np.unique(np.concatenate([own for one in sets for own in one]), return_inverse=True)
            parts = np.split(codes.astype(np.int32), np.cumsum(lengths)[:-1])
            self.codes, self._coded = len(known), [parts[: len(sets[0])], parts[len(sets[0]) :]]
        return self._coded[side][place]

    def candidates(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows first to end of the left with the right that survive, in order of the left, most matches first.

        A pair counts in the first band it shares, so that one tile only sees it.
        """
        small, large = (f(self.n[0][first:end, None], self.n[1][None, :]) for f in (np.minimum, np.maximum))
        i, j = np.nonzero((self.component[0][first:end, None] != self.component[1][None, :]) & (small * 100 >= large * self.threshold))
        i += first
        alive, matches = survivors(*self.signature, self.needed, i, j)
        i, j = i[alive], j[alive]
        if not len(i):
            return i, j
        here = (self.bands[0][i] == self.bands[1][j]).argmax(axis=1) == self.band
        i, j, matches = i[here], j[here], matches[here]
        order = np.lexsort((j, -matches, i))
        return i[order], j[order]

    def links(self) -> pa.Table:
        found, mark, marked = [], None, -1
        for first in range(0, len(self.node[0]), SLICE):
            for i, j in zip(*(x.tolist() for x in self.candidates(first, first + SLICE)), strict=True):
                x, y = self._root(int(self.component[0][i])), self._root(int(self.component[1][j]))
                if x == y:
                    continue
                own, other = self.coded(0, i), self.coded(1, j)
                if marked != i:
                    mark = np.zeros(self.codes, dtype=bool)
                    mark[own] = True
                    marked = i
                same = int(mark[other].sum())
                united = len(own) + len(other) - same
                if 100 * same >= self.threshold * united:
                    self.joined[max(x, y)] = min(x, y)
                    found.append((*sorted((int(self.node[0][i]), int(self.node[1][j]))), same, united))
        return pa.table({name: pa.array([row[k] for row in found], pa.int64()) for k, name in enumerate(("a", "b", "same", "united"))})


def _rest(members: DataFrame, classes: DataFrame, texts: DataFrame, labels: DataFrame, threshold: int, miss: float, size: int) -> DataFrame:
    """Links between members of a bucket, the hub's apart, that join different components. Stored.

    The members of a bucket that are in the hub's component are never compared with each other.
    They and the others are cut into chunks; a tile is a chunk of the others against any chunk.
    """
    needed = least_matches(threshold, miss)
    label = labels.select(F.col("node").alias("rep"), "component")
    hubs = labels.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    placed = members.join(label, "rep", "left").join(hubs, "hub", "left").select(
        "bucket", "band", "rep", "hub", F.coalesce("component", "rep").alias("component"),
        (F.coalesce("component", "rep") == F.coalesce("hub_component", "hub")).alias("main"), "n_shingles",
    )
    placed = stored(placed.where("rep <> hub").drop("hub"))

    def count(main: bool):
        own = F.col("main") == main
        shares = F.greatest(F.count_if(own) / TILE, F.sum(F.when(own, F.col("n_shingles")).otherwise(0)) / TILE_SHINGLES)
        return F.ceil(shares).cast("int")

    counts = placed.groupBy("bucket").agg(count(True).alias("mains"), count(False).alias("others"), F.count("*").alias("n"))
    counts = stored(counts.where("others > 0 AND n > 1").drop("n"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    chunked = placed.join(counts, "bucket").withColumn("chunk", own)
    # a tile is (left chunk, right chunk): left is one of the others, right is any; 2 * chunk + main names a chunk
    name = lambda chunk, main: F.lit(2) * chunk + main.cast("int")
    as_left = chunked.where(~F.col("main")).withColumn("right", F.explode(F.concat(
        F.transform(F.expr("sequence(chunk, others - 1)"), lambda i: F.lit(2) * i),
        F.expr("if(mains > 0, transform(sequence(0, mains - 1), i -> 2 * i + 1), array())"),
    ))).select("bucket", "band", F.col("chunk").alias("left"), "right", "rep", "component", F.lit(True).alias("is_left"))
    as_right = chunked.withColumn("left", F.explode(F.expr("if(main, sequence(0, others - 1), sequence(0, chunk))"))).select(
        "bucket", "band", "left", name(F.col("chunk"), F.col("main")).alias("right"), "rep", "component", F.lit(False).alias("is_left"))
    known = classes.select("rep", "n_shingles", "signature", "bands").hint("merge").join(texts, "rep")
    rows = as_left.union(as_right).hint("merge").join(known, "rep")

    def compare(table: pa.Table) -> pa.Table:
        side = table["is_left"].to_numpy(zero_copy_only=False)
        left, right = (table.filter(pa.array(own)) for own in (side, ~side))
        return _Tile(left, right, table["band"][0].as_py(), threshold, size, needed).links()

    return stored(rows.groupBy("bucket", "left", "right").applyInArrow(compare, "a long, b long, same long, united long"))


def _classified(rows: DataFrame, threshold: int, size: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, key, text), key being a hash of the text: id, key, n_shingles, class_id, rep, component,
    component_id; the verified links (a, b, same, united) between classes.

    Classes and components are numbers (null without shingles or id); rep and component_id are the smallest
    ids of these.
    """
    sketches = stored(sketched(rows, size))
    keys = ["class_a", "class_b", "n_shingles"]
    full = sketches.where("n_shingles > 0 AND id IS NOT NULL")
    least = full.groupBy(keys).agg(F.min(F.struct("id", "key", "signature", "bands")).alias("least"))
    classes = stored(least.select(*keys, "least.*").withColumn("rep", F.monotonically_increasing_id()))

    banded = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "hash"))
    banded = banded.select("rep", "n_shingles", "band", F.xxhash64("band", "hash").alias("bucket"))
    buckets = stored(banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("most")).where("hub < most").drop("most"))
    members = stored(banded.join(buckets, "bucket"))

    wanted = classes.select("rep", "id", "key").hint("merge").join(members.select("rep").distinct(), "rep", "left_semi")
    texts = stored(rows.hint("merge").join(wanted, ["id", "key"]).select("rep", "text").dropDuplicates(["rep"]))
    stars = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = _verified(_pruned(stars, classes, threshold, miss), texts, threshold, size)
    labels = components(links)
    more = _rest(members, classes, texts, labels, threshold, miss, size)
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    of_class = classes.select(*keys, "rep", "id").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = stored(of_class.withColumn("component", F.coalesce("component", "rep")))
    least_ids = of_class.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = of_class.join(least_ids, "component").select(*keys, F.col("rep").alias("class_id"), F.col("id").alias("rep"), "component", "component_id")
    named = sketches.withColumn("class_a", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("class_a")))
    return named.select("id", "key", *keys).join(of_class, keys, "left").drop("class_a", "class_b"), links


def _keyed(text: Column) -> Column:
    """128 bits of the text; no bytes for a null text."""
    return F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(text)))


def linked(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, size: int = SHINGLE, miss: float = MISS,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their component, and verified links between classes.

    Documents: id, n_shingles, class_id (a number for each distinct set of shingles), rep (smallest id with the
    same set), component_id (smallest id that links reach). Links: a, b (classes), same and united (shingles of
    both, of either); enough of them to join every component.

    Null and empty texts have no shingles, no class, and are linked with nothing. Equal sets are always linked.
    Rows that share an id are each judged by their own text. Null ids: the row is linked with nothing, its
    component is null. Other columns are ignored. An empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _keyed(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    found, links = _classified(rows, threshold, size, miss)
    own = lambda name: F.coalesce(name, "id").alias(name)
    return found.select("id", "n_shingles", "class_id", own("rep"), own("component_id")), links


def _one_each(rows: DataFrame) -> DataFrame:
    """The rows (row, id, key, text) of the smallest id in each component, one each; of equal ids the smallest key."""
    found, _ = _classified(rows.select("id", "key", "text"), THRESHOLD, SHINGLE, MISS)
    least = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "key")).alias("least"))
    winners = least.select("least.*").union(found.where("component IS NULL").select("id", "key").distinct())
    return rows.select("row", "id", "key").join(winners, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("row.*")


def kept(docs: DataFrame) -> DataFrame:
    """One row of each component, the one of the smallest id; same columns, whatever their names.

    Every row is judged by its own text: rows that share an id and hold other texts are documents of
    their own, and a row repeated with its id and text stays once (any one, if other columns differ).
    Rows without an id are compared with each other only, and one of each group stays.
    """
    whole = F.struct(*[F.col(f"`{name.replace('`', '``')}`") for name in docs.columns]).alias("row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("id"), _keyed(F.col("text")).alias("key"), "text")
    left, nameless = _one_each(rows.where("id IS NOT NULL")), rows.where("id IS NULL")
    return left if nameless.isEmpty() else left.union(_one_each(nameless.withColumn("id", F.lit(0).cast("long"))))
