"""Shards of near equal size by longest-processing-time scheduling of groups that stay together.

1. Rows of equal texts are a group; its size is the sum of its rows' sizes, added up in partial
   sums before the one exchange.
2. A group of more than 1 / (`LARGE` * shards) of all bytes is an item of its own, so there are
   fewer than `LARGE` * shards of these. The other groups go, whole, by a hash of their text into
   `BUNDLES` * shards bundles. These are the items; their number depends on the number of shards only.
3. Items, largest first, go to the least-loaded shard, taken from a heap. A bundle holds about
   1 / `BUNDLES` of a shard, so shards differ by about that much, unless one group is larger than a shard.
4. Items are broadcast to the rows (two tables of bounded size); rows are numbered inside their shard
   by a distributed running total, so neither a shard nor a group passes one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicdrift.operators.corpus import running_total
from topicdrift.runtime import stored

LARGE = 64
BUNDLES = 256
#: Bytes that a row counts besides its text.
ROW_BYTES = 8


def scheduled(sizes: Iterable[int], shards: int) -> list[int]:
    """The shard of each item, given largest first; ties go to the smaller shard number."""
    heap = [(0, shard) for shard in range(shards)]
    placed = []
    for size in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed.append(shard)
    return placed


def sharded(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes of the text + `ROW_BYTES`), text_crc32, shard, slot (from 0 in each shard).

    Slots follow the id, null ids first; rows of one id in any order. A null text counts as an empty one,
    and all of these are one group. Repeated rows are rows of one group, each with a slot of its own. Other
    columns are ignored. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint").alias("group"),
        F.monotonically_increasing_id().alias("row"),
    ))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    large = F.col("bytes") * (LARGE * shards) > total
    item = F.when(large, F.col("group")).otherwise(F.pmod("group", F.lit(BUNDLES * shards)))
    items = groups.groupBy(large.alias("large"), item.alias("item")).agg(F.sum("bytes").alias("bytes")).collect()
    items.sort(key=lambda one: (-one["bytes"], not one["large"], one["item"]))
    placed = [(one["large"], one["item"], shard) for one, shard in zip(items, scheduled([one["bytes"] for one in items], shards), strict=True)]
    session = rows.sparkSession
    alone = session.createDataFrame([x[1:] for x in placed if x[0]], "group bigint, own int")
    bundled = session.createDataFrame([x[1:] for x in placed if not x[0]], "bundle bigint, shared int")
    found = (
        rows.withColumn("bundle", F.pmod("group", F.lit(BUNDLES * shards)))
        .join(F.broadcast(alone), "group", "left").join(F.broadcast(bundled), "bundle", "left")
        .select("id", "size", "text_crc32", "row", F.coalesce("own", "shared").alias("shard"), F.lit(1).cast("bigint").alias("one"))
    )
    numbered = running_total(found, "one", ["shard"], ["id", "row"], "place", ["size", "text_crc32"])
    return numbered.select("id", "size", "text_crc32", "shard", (F.col("place") - 1).alias("slot"))
