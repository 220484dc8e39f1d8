import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from plan_text import plan_of
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from topicdrift.functions.tokens import rule_tokens
from topicdrift.plans.stage import TokenSteps
from topicdrift.plans.text import TokenConfig, token_table


def cut(spark, texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    return [row["tokens"] for row in rule_tokens(rows, **more).orderBy("id").collect()]


@pytest.mark.parametrize(("text", "tokens"), [
    ("I don't know.", ["I", "don't", "know", "."]),
    ("the U.S. of A.", ["the", "U.S.", "of", "A", "."]),
    ("(a) [b]!?", ["(", "a", ")", "[", "b", "]", "!", "?"]),
    ("well-known --x", ["well", "-", "known", "-", "-", "x"]),
    ("$3.50, 12:30 40% 7th", ["$3.50", ",", "12:30", "40%", "7", "th"]),
    ("e.g. Mr. X e.g.x", ["e.g.", "Mr.", "X", "e.g.", "x"]),
    ("co2 naïve Łódź 中文。🙂x", ["co2", "naïve", "Łódź", "中文", "。", "🙂", "x"]),
    ("  ", []), ("", []),
])
def test_rules(spark, text, tokens):
    (found,) = cut(spark, [text], exceptions=["Mr."])
    assert [one["token"] for one in found] == tokens
    assert all(text[one["begin"] : one["end"]] == one["token"] for one in found)


def test_places_come_from_runs_that_follow_the_length(spark):
    """Neither inside a run nor over the runs does the adding up grow with the square of a text."""
    texts = ["ab, c " * n for n in (0, 1, 2, 7, 9, 27, 300)]
    for text, found in zip(texts, cut(spark, texts)):
        assert [text[one["begin"] : one["end"]] for one in found] == [one["token"] for one in found] == ["ab", ",", "c"] * (len(text) // 6)
    rows = rule_tokens(spark.createDataFrame([(1, "a")], "id int, content string"))
    assert rows.columns == ["id", "content", "tokens"] and "cbrt" in plan_of(rows).lower()


def test_switches_and_nulls(spark):
    (found,) = cut(spark, ["well-known cannot cannots C++"], exceptions=["cannot", "C++", "C+"], hyphens="join")
    assert [one["token"] for one in found] == ["well-known", "cannot", "cannots", "C++"]
    assert cut(spark, [None]) == [None]
    with pytest.raises(ValueError, match="hyphens"):
        cut(spark, ["x"], hyphens="drop")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab.-' 1$%\n\té中("), max_size=400), min_size=1, max_size=5))
def test_tokens_are_the_text_without_blanks(spark, texts):
    for text, found in zip(texts, cut(spark, texts), strict=True):
        places = [place for one in found for place in range(one["begin"], one["end"])]
        assert places == [i for i, c in enumerate(text) if c not in " \t\n\x0b\f\r"]
        assert all(text[one["begin"] : one["end"]] == one["token"] for one in found)


@pytest.mark.parametrize("config", [
    TokenConfig(), TokenConfig(stop_words=None, stem=True, ngrams=(1, 2)), TokenConfig(stop_words=("b", "a"), extend_english=True, lowercase=False, distinct=True)])
def test_saved_stage_gives_the_same_tokens(spark, tmp_path, config):
    rows = spark.createDataFrame([(1, "The Running a-b don't {{x}} a"), (2, None), (3, "")], "id int, content string")
    Pipeline(stages=[TokenSteps.of(config, "templates")]).save(f"{tmp_path}/stage")
    loaded = Pipeline.load(f"{tmp_path}/stage")
    assert loaded.getStages()[0].config() == config
    found = loaded.fit(rows).transform(rows)
    assert found.columns == ["id", "content", "tokens"]
    plain = token_table(rows.withColumn("content", F.regexp_replace("content", "\\{\\{x\\}\\}", "")), config, ["id"])
    assert sorted(map(str, found.select("id", "tokens").collect())) == sorted(map(str, plain.collect()))
    assert sorted(map(str, found.select("id", "content").collect())) == sorted(map(str, rows.collect()))


def test_unknown_variant(spark):
    with pytest.raises(ValueError, match="unknown"):
        TokenSteps(cleaning="nothing of the kind")
