"""Markup removal as column expressions."""

from __future__ import annotations

import html
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from .stemming import map_distinct

# Executors get the helpers of this module with the query; nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTITIES = "entities"

# Rule name -> (pattern, replacement). Dots stop at "\n" only ("(?d)"),
# blanks are Unicode blanks plus the four ASCII separators, and a word character is a
# letter, a number or "_", as in Python's "re". The look behind a word stands after it:
# it then runs only where the word was found.
RULES = {
    "refs": (r"(?d)<ref.*?>.*?</ref>", ""),
    "templates": (r"(?d)\{\{.*?\}\}", ""),
    "urls": (r"(?U)http[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+", "<URL>"),
    "comments": (r"(?d)<!--.*?-->", ""),
    "files": (r"(?d)\[\[File:.*?\]\]", ""),
    "isbn": (r"(?iu)ISBN(?<![\p{L}\p{N}_]ISBN)(?![\p{L}\p{N}_])", ""),
    "redirect": (r"(?iu)REDIRECT(?<![\p{L}\p{N}_]REDIRECT)(?![\p{L}\p{N}_])", ""),
    "tags": (r"<[^>]+>", ""),
}

# Variant name -> rules in the order they apply.
VARIANTS = {
    "none": (),
    "entities": (ENTITIES,),
    "refs": ("refs",),
    "templates": ("templates",),
    "urls": ("urls",),
    "comments": ("comments",),
    "files": ("files",),
    "tags": ("tags",),
    "must_haves": ("refs", "templates", "urls", "comments", ENTITIES),
    "must_and_files": ("refs", "templates", "urls", "comments", "files", ENTITIES),
    "all": ("comments", "templates", "refs", "files", "urls", "isbn", "redirect", ENTITIES),
    "wiki": (ENTITIES, "comments", "templates", "refs", "files", "urls", "isbn", "redirect", "tags"),
}


# What `html.unescape` looks for in a text.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _unescape(references: pa.Array) -> pa.Array:
    return map_distinct(references, html.unescape)


def _decode_entities(df: DataFrame, column: str) -> DataFrame:
    """Character references replaced by the characters they stand for.

    Only the references leave the JVM; a text is cut at them and put together again natively. Texts
    without "&" send NULL.
    """
    text = F.col(column)
    found = F.when(text.contains("&"), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
    sent = df.withColumn("_references", found).withColumn("_references", _unescape("_references"))
    between = F.split(text, REFERENCE, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, "_references", lambda one, decoded: F.array(one, F.coalesce(decoded, F.lit(""))))), "")
    return sent.withColumn(column, F.when(F.col("_references").isNotNull(), joined).otherwise(text)).drop("_references")


def clean(df: DataFrame, variant: str, column: str = "content") -> DataFrame:
    """``df`` with all rules of a variant applied to one column, in their order.

    Neighbouring pattern rules form one native expression; only the references of the entity
    rule leave the JVM, in Arrow batches.
    """
    text = F.col(column)
    for rule in VARIANTS[variant]:
        if rule == ENTITIES:
            df = _decode_entities(df.withColumn(column, text), column)
            text = F.col(column)
        else:
            pattern, replacement = RULES[rule]
            text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return df.withColumn(column, text)
