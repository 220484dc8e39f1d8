"""Markup rules and their chains over marked texts and raw web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as words
from ..functions.cleaning import VARIANTS, clean
from ..plans.sweep import CLEANING_TRIALS
from . import inputs
from .registry import query

# The rules in the dialect of the checking engine; the entity chain covers the basic five.
RULE_SQL = {
    "refs": "regexp_replace({}, '<ref.*?>.*?</ref>', '', 'g')",
    "templates": r"regexp_replace({}, '\{{\{{.*?\}}\}}', '', 'g')",
    "urls": r"regexp_replace({}, 'http\S+|www\.\S+', '<URL>', 'g')",
    "comments": "regexp_replace({}, '<!--.*?-->', '', 'g')",
    "files": r"regexp_replace({}, '\[\[File:.*?\]\]', '', 'g')",
    "isbn": r"regexp_replace({}, '(?i)\bISBN\b', '', 'g')",
    "redirect": r"regexp_replace({}, '(?i)\bREDIRECT\b', '', 'g')",
    "tags": "regexp_replace({}, '<[^>]+>', '', 'g')",
    "entities": "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')",
}


def clean_sql(variant: str, text: str = "content") -> str:
    for rule in VARIANTS[variant]:
        text = RULE_SQL[rule].format(text)
    return text


def _register(variant: str) -> None:
    @query(f"clean_{variant}", inputs.with_marked(f"\nSELECT doc_id, {clean_sql(variant)} AS content FROM marked"))
    def run(spark, folder):
        return clean(inputs.marked(spark, folder), variant).select("doc_id", "content")


for _variant in VARIANTS:
    if _variant != "tags":
        _register(_variant)


@query("clean_tags", f"SELECT page_id, {clean_sql('tags', 'html')} AS html FROM pages")
def clean_tags(spark, folder):
    return clean(inputs.table(spark, folder, "pages").select("page_id", "html"), "tags", "html")


@query("clean_pages_chain", f"""
SELECT page_id, {RULE_SQL['tags'].format(RULE_SQL['urls'].format(RULE_SQL['comments'].format('html')))} AS html FROM pages""")
def clean_pages_chain(spark, folder):
    pages = inputs.table(spark, folder, "pages").select("page_id", "html")
    for rule in ("comments", "urls", "tags"):
        pages = clean(pages, rule, "html")
    return pages


@query("shrink", inputs.with_corpus(r"""
SELECT doc_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS content FROM corpus"""))
def shrink(spark, folder):
    return inputs.corpus(spark, folder).select("doc_id", words.shrink(F.col("content")).alias("content"))


EFFECT_SQL = " UNION ALL ".join(
    f"SELECT '{trial.config}' AS config, CAST(sum(length({clean_sql(trial.cleaning)})) AS BIGINT) AS chars, "
    f"CAST(sum(len({inputs.words_sql(clean_sql(trial.cleaning))})) AS BIGINT) AS tokens FROM marked"
    for trial in CLEANING_TRIALS
)


@query("cleaning_effect", inputs.with_marked("\n" + EFFECT_SQL))
def cleaning_effect(spark, folder):
    """Characters and tokens left by each variant of the cleaning experiment, in one pass."""
    texts = inputs.marked(spark, folder).select("content")
    for i, trial in enumerate(CLEANING_TRIALS):
        texts = clean(texts.withColumn(f"text_{i}", F.col("content")), trial.cleaning, f"text_{i}")
    sums = [
        F.struct(
            F.lit(trial.config).alias("config"),
            F.sum(F.length(f"text_{i}")).alias("chars"),
            F.sum(F.size(words.tokenize(F.col(f"text_{i}")))).alias("tokens"),
        )
        for i, trial in enumerate(CLEANING_TRIALS)
    ]
    return texts.agg(F.array(*sums).alias("effects")).select(F.inline("effects"))


