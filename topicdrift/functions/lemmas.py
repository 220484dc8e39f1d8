"""Lemmas of token lists from a table held in memory."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from .stemming import map_distinct


def lemmas_of(table: dict[str, str]) -> Callable:
    """A function of token lists; words outside the table stay."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def look_up(tokens: pa.Array) -> pa.Array:
        return map_distinct(tokens, lambda word: table.get(word, word))

    return look_up
