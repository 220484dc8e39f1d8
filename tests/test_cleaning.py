import html
import re

import pytest
from plan_text import plan_of

from topicdrift.functions.cleaning import VARIANTS, clean

# The same rules in Python's dialect.
PATTERNS = {
    "refs": (r"<ref.*?>.*?</ref>", ""),
    "templates": (r"\{\{.*?\}\}", ""),
    "urls": (r"http\S+|www\.\S+", "<URL>"),
    "comments": (r"<!--.*?-->", ""),
    "files": (r"\[\[File:.*?\]\]", ""),
    "isbn": (r"(?i)\bISBN\b", ""),
    "redirect": (r"(?i)\bREDIRECT\b", ""),
    "tags": (r"<[^>]+>", ""),
}
TEXTS = [
    "",
    "plain",
    "a <ref name=x>one</ref> b <ref>two</ref> c",
    "a <ref name=x/> kept? <b>yes</b> <ref>gone</ref> d",
    "a <ref>over\nlines</ref> b",
    "{{a {{b}} c}} d {{e\nf}} g",
    "{{a\rb}} {{c d}} {{e\u0085f}}",
    "see http://x.y/z]] and www.a.b after xhttps://q\x1cnext www. no",
    "<!-- a --> b <!-- c\nd --> e <!---->",
    "[[File:a.png|thumb [[b]] c]] d [[file:e]]",
    "ISBN 1 isbn-2 xISBN ISBNx Iſbn _ISBN ISBN_ éISBN ISBN² (ISBN) ISBŃ",
    "#REDIRECT [[a]] redirect redirects REDIRECT",
    "<b>x</b> < no > <br\n/> a<b",
    "&lt;ref&gt;a&lt;/ref&gt; &amp;amp; &nbsp;&#65;&#x42; &notin; &notit; & &;",
    "mixed &lt;b&gt; {{x|http://a.b}} <ref>www.c.d</ref> http://e<ref>f</ref> ISBN",
]


def in_python(text, variant):
    for rule in VARIANTS[variant]:
        text = html.unescape(text) if rule == "entities" else re.sub(PATTERNS[rule][0], PATTERNS[rule][1], text)
    return text


@pytest.mark.parametrize("variant", VARIANTS)
def test_equals_python(spark, variant):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")
    found = {row["id"]: row["content"] for row in clean(rows, variant).collect()}
    assert found == {i: in_python(text, variant) for i, text in enumerate(TEXTS)}


@pytest.mark.parametrize("rule", [rule for rule in PATTERNS if rule in ("isbn", "redirect")])
def test_word_rules(spark, rule):
    from pyspark.sql import functions as F

    from topicdrift.functions.cleaning import RULES

    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")
    pattern, replacement = RULES[rule]
    found = rows.select("id", F.regexp_replace("content", F.lit(pattern), F.lit(replacement)).alias("c")).collect()
    assert {row["id"]: row["c"] for row in found} == {i: re.sub(*PATTERNS[rule], text) for i, text in enumerate(TEXTS)}


def test_only_references_leave_the_jvm(spark):
    """The text itself is not sent; odd references are decoded as Python does."""
    parts = ["&", "&amp", "&amp;", "&#65", "&#x1F600;", "&#0;", "&#xD800;", "&#99999999;", "&notin", "&notit;", "&é;", "&#", ";", "é😀", " ", "\t", "<", "x" * 40, "\n", "&#x;"]
    texts = ["".join(parts[(i * 7 + j * (i % 11 + 1)) % len(parts)] for j in range(i % 23)) for i in range(300)]
    found = clean(spark.createDataFrame(list(enumerate(texts)), "id int, content string"), "entities")
    assert re.search(r"_unescape\(case when .{0,60}then regexp_extract_all\(", plan_of(found), re.IGNORECASE), plan_of(found)[250:600]
    assert {row["id"]: row["content"] for row in found.collect()} == {i: html.unescape(text) for i, text in enumerate(texts)}


def test_null_stays_null(spark):
    rows = spark.createDataFrame([(None,)], "content string")
    assert clean(rows, "wiki").first()["content"] is None


@pytest.mark.parametrize("variant", [name for name, rules in VARIANTS.items() if "entities" not in rules])
def test_pattern_rules_stay_in_the_jvm(spark, variant):
    rows = spark.createDataFrame([("a",)], "content string")
    assert "Python" not in plan_of(clean(rows, variant))
