import math
from collections import Counter
from dataclasses import replace

import pyarrow as pa
import pytest
from plan_text import plan_of
from pyspark.ml.feature import IDF, CountVectorizerModel
from pyspark.sql import functions as F

from topicdrift.catalog import counts
from topicdrift.operators import terms, vectors
from topicdrift.plans.text import TokenConfig, form_of, form_table, token_table, tokens_of_form
from topicdrift.runtime import new_table_path, stored

DOCS = [(1, "b a b c".split()), (2, "a".split()), (3, []), (4, "c c d a".split()), (5, None), (6, ["zz"])]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(DOCS, "doc_id int, tokens array<string>")


def test_bag_without_a_shuffle(spark, documents):
    bag = terms.bag_of_words(documents, ["doc_id"])
    expected = {(doc_id, term, n) for doc_id, tokens in DOCS for term, n in Counter(tokens or []).items()}
    assert {tuple(row) for row in bag.collect()} == expected
    assert "Exchange" not in plan_of(bag)
    kept = terms.bag_of_words(documents, ["doc_id"], keep_empty=True)
    assert {tuple(row) for row in kept.collect()} == expected | {(3, None, None), (5, None, None)}


def test_vocabulary_order_cut_and_min_df(spark, documents):
    statistics = stored(terms.term_statistics(terms.bag_of_words(documents, ["doc_id"], keep_empty=True)))
    assert [tuple(row) for row in terms.vocabulary(statistics, size=None).orderBy("term_id").collect()] == [
        (0, "a", 3, 3), (1, "c", 3, 2), (2, "b", 2, 1), (3, "d", 1, 1), (4, "zz", 1, 1)
    ]
    for size in range(1, 6):
        assert [row["term"] for row in terms.vocabulary(statistics, size=size).orderBy("term_id").collect()] == ["a", "c", "b", "d", "zz"][:size]
    assert [row["term"] for row in terms.vocabulary(statistics, min_df=2, size=None).orderBy("term_id").collect()] == ["a", "c"]
    assert terms.vocabulary(statistics, min_df=9, size=None).count() == 0
    sizes = terms.vocabulary_sizes(statistics, [1, 2, 3, 4]).collect()
    assert [tuple(row) for row in sizes] == [(1, 5), (2, 2), (3, 1), (4, 0)]


@pytest.mark.parametrize("weighting", ["tfidf", "count"])
def test_vectors_equal_the_library_s(spark, documents, weighting):
    bag = terms.bag_of_words(documents, ["doc_id"], keep_empty=True)
    statistics = stored(terms.term_statistics(bag))
    weights = stored(terms.idf(terms.vocabulary(statistics, min_df=1, size=4), terms.document_count(documents)))
    made = vectors.stored_vectors(bag, weights, ["doc_id"], weighting)
    alone = vectors.document_vectors(documents, weights, ["doc_id"], weighting)
    listed = [row["term"] for row in weights.orderBy("term_id").collect()]
    filled = documents.withColumn("tokens", F.coalesce("tokens", F.array()))
    counted = CountVectorizerModel.from_vocabulary(listed, inputCol="tokens", outputCol="counts").transform(filled)
    counted = IDF(inputCol="counts", outputCol="weighted").fit(counted).transform(counted)
    column = "weighted" if weighting == "tfidf" else "counts"
    expected = {row["doc_id"]: row[column].toArray().tolist() for row in counted.collect()}
    for rows in (made, alone):
        found = {row["doc_id"]: row["features"].toArray().tolist() for row in rows.collect()}
        assert found.keys() == expected.keys()
        for key in found:
            assert found[key] == pytest.approx(expected[key], abs=1e-12)


def test_document_vectors_move_no_entry(spark, documents, monkeypatch):
    statistics = stored(terms.term_statistics(terms.bag_of_words(documents, ["doc_id"])))
    weights = stored(terms.idf(terms.vocabulary(statistics, size=None), F.lit(6)))
    seen = []
    monkeypatch.setattr(vectors, "stored", lambda df, *more: seen.append(plan_of(df)) or df)
    vectors.document_vectors(spark.read.parquet(_written(documents)), weights, ["doc_id"])
    assert seen and all("Exchange" not in plan for plan in seen)


def _written(df):
    path = new_table_path(df.sparkSession)
    df.write.parquet(path)
    return path


@pytest.mark.parametrize("weighting", [vectors.TFIDF, vectors.COUNT])
@pytest.mark.parametrize("binary", [False, True])
def test_broadcast_and_joined_vocabularies_agree(spark, documents, weighting, binary):
    """Both give one vector per row, also rows without tokens and without a known term."""
    statistics = stored(terms.term_statistics(terms.bag_of_words(documents, ["doc_id"])))
    weights = stored(terms.idf(terms.vocabulary(statistics, 2, size=None), F.lit(6)))
    small, joined = (vectors.document_vectors(documents, weights, ["doc_id"], weighting, binary, limit) for limit in (1 << 26, 0))
    found = sorted(map(str, vectors.entries(small, ["doc_id"]).collect()))
    assert found == sorted(map(str, vectors.entries(joined, ["doc_id"]).collect()))
    assert len(found) == documents.count()


def test_dictionary_pieces_hold_all_terms_in_order(spark):
    listed = spark.range(1000).selectExpr("id AS term_id", "concat('t', id) AS term", "id / 2 AS idf").repartition(7)
    pieces = vectors.dictionary(listed).orderBy("first").collect()
    table = pa.concat_tables([pa.ipc.open_stream(row["piece"]).read_all() for row in pieces])
    assert table["term"].to_pylist() == [f"t{i}" for i in range(1000)]
    assert table["idf"].to_pylist() == [i / 2 for i in range(1000)]


def test_numbering_over_many_slices(spark):
    statistics = spark.range(500).selectExpr("concat('t', id) AS term", "id % 7 AS n", "id AS df")
    listed = terms.vocabulary(statistics.repartition(20), min_df=1, size=None).collect()
    ordered = sorted(((-row["n"], row["term"]) for row in listed))
    assert [(-row["n"], row["term"]) for row in sorted(listed, key=lambda row: row["term_id"])] == ordered
    assert sorted(row["term_id"] for row in listed) == list(range(499))


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_lemmas_looked_up_and_joined_agree(spark, documents, monkeypatch, limit):
    monkeypatch.setattr(terms, "BROADCAST_LIMIT_BYTES", limit)
    lemmas = spark.createDataFrame([("a", "x"), ("a", "y"), ("zz", "z")], "form string, lemma string")
    found = terms.lemmatize(documents, lemmas, ["doc_id"])
    assert limit == 0 or "Exchange" not in plan_of(terms.lemmatize(spark.read.parquet(_written(documents)), lemmas, ["doc_id"]))
    change = {"a": "x", "zz": "z"}
    expected = {doc_id: [change.get(word, word) for word in tokens or []] for doc_id, tokens in DOCS}
    assert {row["doc_id"]: row["tokens"] or [] for row in found.collect()} == expected


def test_binary_vectors(spark, documents):
    bag = terms.bag_of_words(documents, ["doc_id"])
    weights = stored(terms.idf(terms.vocabulary(stored(terms.term_statistics(bag)), size=None), F.lit(6)))
    made = vectors.stored_vectors(bag, weights, ["doc_id"], vectors.COUNT, binary=True)
    assert all(set(row["features"].values) == {1.0} for row in made.collect())


def test_tfidf_broadcasts_the_vocabulary(spark, documents):
    bag = terms.bag_of_words(documents, ["doc_id"])
    weights = terms.idf(terms.term_statistics(bag), F.lit(6))
    weighted = terms.tfidf(bag, weights, ["doc_id"])
    assert "BroadcastHashJoin" in plan_of(weighted)
    found = {(row["doc_id"], row["term"]): row["tfidf"] for row in weighted.collect()}
    assert found[(4, "c")] == pytest.approx(2 * math.log(7 / 3))


def test_top_terms_break_ties_by_term(spark):
    rows = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 1.0), ("g", "c", 2.0), ("h", "z", 0.0)], "g string, term string, w double")
    best = terms.top_terms(rows, ["g"], "w", 2).orderBy("g", "rank").collect()
    assert [tuple(row) for row in best] == [("g", 1, "c", 2.0), ("g", 2, "a", 1.0), ("h", 1, "z", 0.0)]


def test_grouped_bag_is_the_bag_of_the_joined_texts(spark):
    rows = spark.createDataFrame([(1, "x", ["a", "b"]), (2, "x", ["b"]), (3, None, ["c"])], "doc_id int, g string, tokens array<string>")
    summed = terms.grouped_bag(terms.bag_of_words(rows, ["g"]), ["g"])
    assert {tuple(row) for row in summed.collect()} == {("x", "a", 1), ("x", "b", 2), (None, "c", 1)}


def test_an_empty_vocabulary_is_refused(spark, documents):
    bag = terms.bag_of_words(documents, ["doc_id"])
    statistics = stored(terms.term_statistics(bag))
    weights = stored(terms.idf(terms.vocabulary(statistics, min_df=99, size=None), F.lit(6)))
    with pytest.raises(ValueError, match="empty"):
        vectors.stored_vectors(bag, weights, ["doc_id"])


def test_statistics_of_many_settings_are_those_of_each(spark):
    rows = [(1, "The cat saw the Cat and the cats"), (2, "cat THE cat"), (3, ""), (4, "Running runs the cat"), (5, None)]
    texts = spark.createDataFrame(rows, "doc_id bigint, content string")
    base = TokenConfig(stop_words=("and",))
    configs = [
        replace(base, ngrams=sizes, distinct=distinct, lowercase=lowercase, stem=stem)
        for sizes, distinct, lowercase, stem in [
            ((1, 2), True, True, False), ((1, 2), True, False, False), ((2,), False, True, False),
            ((1, 2, 3), True, True, False), ((2,), False, False, True), ((1,), False, True, True),
        ]
    ]
    forms = form_table(texts, configs, ["doc_id"])
    shared = terms.ngram_statistics(forms, [(form_of(config), size) for config in configs for size in config.ngrams])
    assert plan_of(shared).count("Exchange hashpartitioning") == 1
    for config in configs:
        alone = token_table(texts, config, ["doc_id"])
        assert sorted(tokens_of_form(forms, config, ["doc_id"]).collect()) == sorted(alone.collect())
        wanted = terms.term_statistics(terms.bag_of_words(alone, ["doc_id"]))
        found = terms.setting_statistics(shared, form_of(config), config.ngrams, config.distinct)
        assert sorted(found.collect()) == sorted(wanted.collect()) and wanted.count()


def test_batches_are_counted_in_pieces(spark, monkeypatch):
    """Rows stay whole; a piece has no more tokens than the limit, besides those of one row."""
    monkeypatch.setattr(vectors, "PIECE_TOKENS", 10)
    sizes = [3, 0, None, 4, 9, 25, 0, 1, 2, 8, 0]
    lists = [None if size is None else ["a"] * size for size in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(lists, pa.list_(pa.string()))], ["key", "tokens"])
    pieces = list(vectors._pieces(batch, 1))
    assert pa.Table.from_batches(pieces).to_pylist() == batch.to_pylist() and len(pieces) > 3
    for piece in pieces:
        counts = [len(one or ()) for one in piece.column(1).to_pylist()]
        assert sum(counts) - max(counts) <= 10
    assert not list(vectors._pieces(batch.slice(0, 0), 1))
    found = []
    for limit in (1 << 20, 3):
        monkeypatch.setattr(vectors, "PIECE_TOKENS", limit)
        rows = [(i, ["a", "b", "c", "a"][: i % 5]) for i in range(20)]
        weights = spark.createDataFrame([(0, "a", 0.5), (1, "c", 2.0)], "term_id int, term string, idf double")
        made = vectors.document_vectors(spark.createDataFrame(rows, "doc_id int, tokens array<string>").coalesce(1), weights, ["doc_id"])
        found.append(sorted(made.collect()))
    assert found[0] == found[1] and len(found[0]) == 20


def test_tfidf_cuts_the_texts_once(spark, tmp_path, monkeypatch):
    """Vocabulary and weights read the same bag, also with missing texts and ids that repeat."""
    rows = [(1, "a b b", "en", "s"), (1, "a b b", "en", "s"), (2, "a c", "en", "s"), (None, "c", "en", "s"), (3, None, "en", "s"), (4, "", "de", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    cuts, real = [], counts.inputs.bag
    monkeypatch.setattr(counts.inputs, "bag", lambda *where: cuts.append(1) or real(*where))
    found = sorted((row["doc_id"] or 0, row["term"], row["tfidf"]) for row in counts.tfidf(spark, str(tmp_path)).collect())
    assert len(cuts) == 1
    a, b, c = (round(math.log(7 / (df + 1)), 6) for df in (3, 2, 2))
    twice = round(2 * math.log(7 / 3), 6)
    assert found == [(0, "c", c), (1, "a", a), (1, "a", a), (1, "b", twice), (1, "b", twice), (2, "a", a), (2, "c", c)]


def test_vectors_over_a_large_vocabulary_are_row_by_row(spark):
    """Missing, repeated and unknown things; a row is a vector also if its key comes again."""
    rows = [(1, ["a", "b", "a"]), (1, ["c", "x"]), (None, ["b", None, "b"]), (2, []), (3, None), (4, ["x", "y"]), (5, ["c", "a", "c", "x"])]
    weights = spark.createDataFrame([(0, "a", 0.5), (1, "b", 2.0), (2, "c", 0.25)], "term_id int, term string, idf double")
    table = spark.createDataFrame(rows, "doc_id int, tokens array<string>").coalesce(1)
    for weighting, binary in ((vectors.TFIDF, False), (vectors.COUNT, True)):
        small, large = (vectors.document_vectors(table, weights, ["doc_id"], weighting, binary, limit).collect() for limit in (1 << 26, 0))
        assert sorted(map(str, large)) == sorted(map(str, small)) and len(large) == 7
    assert {str(row["features"]) for row in large if row["doc_id"] == 1} == {"(3,[0,1],[1.0,1.0])", "(3,[2],[1.0])"}
