import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from topicdrift.functions import tokens as words
from topicdrift.functions.stemming import porter_stem, stem_tokens
from topicdrift.plans.text import TokenConfig, token_table
from topicdrift.operators.terms import lemmatize


def cut(spark, text, **settings):
    rows = spark.createDataFrame([(1, text)], "doc_id int, content string")
    return token_table(rows, TokenConfig(stop_words=None, **settings), ["doc_id"]).first()["tokens"]


def test_words_are_runs_of_letters(spark):
    assert cut(spark, " Don't  stop, 3rd\tÉtude\n x2y ") == ["don", "t", "stop", "rd", "étude", "x", "y"]
    assert cut(spark, "Don't well-known a1b", punctuation="join") == ["dont", "wellknown", "ab"]
    assert cut(spark, "Ab aB", lowercase=False) == ["Ab", "aB"]
    assert cut(spark, "") == [] and cut(spark, "12 ,.") == []


def test_switches_are_checked(spark):
    with pytest.raises(ValueError):
        cut(spark, "a", cleanup="other")
    with pytest.raises(ValueError):
        cut(spark, "a", punctuation="other")


def test_shrink(spark):
    rows = spark.createDataFrame([(" a \n\t b  c ",)], "t string")
    assert rows.select(words.shrink(F.col("t"))).first()[0] == "a b c"


def test_stop_words_ignore_case_and_replace_the_list(spark):
    rows = spark.createDataFrame([(1, "The URL and THE date")], "doc_id int, content string")

    def kept(**settings):
        return token_table(rows, TokenConfig(lowercase=False, **settings), ["doc_id"]).first()["tokens"]

    assert kept() == ["URL", "date"]
    assert kept(stop_words=("url",)) == ["The", "and", "THE", "date"]
    assert kept(stop_words=("url",), extend_english=True) == ["date"]
    assert kept(stop_words=()) == ["The", "URL", "and", "THE", "date"]


def test_ngrams(spark):
    assert cut(spark, "a b c", ngrams=(2,)) == ["a b", "b c"]
    assert cut(spark, "a b", ngrams=(3,)) == []
    assert cut(spark, "", ngrams=(2,)) == []
    assert cut(spark, "a b a b", ngrams=(1, 2)) == ["a", "b", "a", "b", "a b", "b a", "a b"]
    assert cut(spark, "a b a b", ngrams=(1, 2), distinct=True) == ["a", "b", "a b", "b a"]


# Examples of the published paper.
EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster
bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr
hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


def test_published_stems():
    for word, stem in zip(EXAMPLES[::2], EXAMPLES[1::2]):
        assert porter_stem(word) == stem, word


def test_stems_keep_rows_and_order(spark):
    rows = [(1, ["cats", "running", "cats"]), (2, []), (3, None), (4, ["as", "Ponies", None])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(2)
    found = {row["id"]: row["s"] for row in df.select("id", stem_tokens("tokens").alias("s")).collect()}
    assert found == {1: ["cat", "run", "cat"], 2: [], 3: None, 4: ["as", "poni", None]}


def test_lemmas(spark):
    rows = spark.createDataFrame([(1, ["mice", "run", "mice"]), (2, []), (3, ["x"])], "id int, tokens array<string>")
    lemmas = spark.createDataFrame([("mice", "mouse"), ("mice", "mouse"), ("ran", "run")], "form string, lemma string")
    found = {row["id"]: row["tokens"] for row in lemmatize(rows, lemmas, ["id"]).collect()}
    assert found == {1: ["mouse", "run", "mouse"], 2: [], 3: ["x"]}


def test_ngrams_join_plainly_and_pass_over_missing_words(spark):
    rows = spark.createDataFrame([(0, ["a", None, "b c", "d"]), (1, [None, None]), (2, ["a"]), (3, None)], "id int, tokens array<string>")
    made = rows.select("id", words.ngrams(F.col("tokens"), 2).alias("two"), words.ngrams(F.col("tokens"), 3).alias("three"))
    assert "coalesce(concat(" in plan_of(made)
    found = {row["id"]: (row["two"], row["three"]) for row in made.collect()}
    assert found == {0: (["a", "b c", "b c d"], ["a b c", "b c d"]), 1: ([""], []), 2: ([], []), 3: (None, None)}
