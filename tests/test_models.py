import math

import numpy as np
import pytest
from plan_text import plan_of
from pyspark.sql import DataFrame, functions as F

from topicdrift import runtime, sinks
from topicdrift.catalog import models
from topicdrift.functions import special
from topicdrift.operators import evolution, terms, topics, vectors
from topicdrift.plans import modelling, sweep
from topicdrift.plans.modelling import fit_topics, fit_topics_per_period
from topicdrift.plans.text import TokenConfig, token_table
from topicdrift.runtime import stored

PLAIN = TokenConfig(stop_words=None)


@pytest.fixture(scope="module")
def corpus(spark):
    first, second = "sun moon star sky night ".split(), "bread milk egg salt oven ".split()
    rows = [
        (i, f"t{i % 4}", 2000 + i % 13, " ".join((first if i % 2 else second)[(i + j) % 5] for j in range(20 + i % 9)))
        for i in range(80)
    ] + [(80, "t0", 2003, "")]
    return spark.createDataFrame(rows, "doc_id int, title string, year int, content string")


@pytest.fixture(scope="module")
def fitted(corpus):
    return fit_topics(corpus, ["doc_id", "title", "year"], seed=3, vocabulary_size=None, tokens=PLAIN, k=2, max_iter=15, subsampling_rate=0.5)


def test_model_separates_the_vocabularies(fitted):
    best = fitted.topic_terms(5)
    assert "BroadcastHashJoin" in plan_of(best)
    by_topic = {}
    for row in best.collect():
        by_topic.setdefault(row["topic"], set()).add(row["term"])
    assert sorted(map(sorted, by_topic.values())) == sorted(map(sorted, [
        {"sun", "moon", "star", "sky", "night"}, {"bread", "milk", "egg", "salt", "oven"}]))


def test_distributions_add_up(fitted):
    rows = fitted.topic_distribution().collect()
    assert len(rows) == 80
    assert all(abs(sum(row[topics.DISTRIBUTION]) - 1) < 1e-6 for row in rows)
    assert topics.log_perplexity(fitted.model, fitted.vectors) > 0


def test_title_filter_reaches_the_scan(fitted):
    rows = evolution.title_trajectory(fitted.topic_distribution(), ["t0", "t1"], topics.DISTRIBUTION, 2)
    assert "PushedFilters: [In(title, [t0,t1])]" in plan_of(rows)
    assert {row["title"] for row in rows.collect()} == {"t0", "t1"}


def _shown(model):
    rows = model.topic_terms().orderBy("topic", "rank").collect()
    return [(row["topic"], row["rank"], row["term"]) for row in rows], [row["weight"] for row in rows]


@pytest.mark.parametrize(("partitions", "split"), [(7, None), (1, None), (23, 2000), (3, 500)])
def test_same_seed_same_model(spark, corpus, fitted, partitions, split):
    """Neither the corpus's partitions nor how files are packed into tasks change a model."""
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.shuffle.partitions", 3 + partitions)
    try:
        again = fit_topics(
            corpus.repartition(partitions), ["doc_id", "title", "year"], seed=3, vocabulary_size=None, tokens=PLAIN, k=2, max_iter=15,
            subsampling_rate=0.5,
        )
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    shown, weights = _shown(again)
    assert shown == _shown(fitted)[0]
    assert weights == pytest.approx(_shown(fitted)[1], abs=1e-9)


def test_models_per_period(corpus):
    fitted = fit_topics_per_period(corpus, seed=1, vocabulary_size=None, tokens=PLAIN, k=2, max_iter=4, subsampling_rate=0.9, parallelism=2)
    assert list(fitted.models) == ["2001-2005", "2006-2011", "2012-2018"]
    rows = fitted.topic_distribution().collect()
    assert {row["period"] for row in rows} == set(fitted.models)
    assert len(rows) == len({(row["title"], row["period"]) for row in rows}) == 12
    assert all(len(row[topics.DISTRIBUTION]) == 2 for row in rows)
    assert fitted.topic_terms(3).count() == 3 * 2 * 3
    lines = sinks.report_lines(sinks.topic_lists(fitted.topic_terms(3), "period"), "Topics for period ").collect()
    assert len(lines) == 3 * 3
    first = fitted.topic_terms(3).where("period = '2001-2005' AND topic = 0").orderBy("rank").collect()
    assert "Topic 1: " + ", ".join(row["term"] for row in first) in {row["text"] for row in lines}


def test_other_years_can_shape_the_vocabulary(corpus):
    fitted = fit_topics_per_period(corpus, seed=1, vocabulary_size=None, tokens=PLAIN, k=2, max_iter=2, keep_other_years=True)
    assert fitted.vectors.where(F.col("period").isNull()).count() > 0


def test_sweep_and_its_reports(spark, corpus, tmp_path):
    trials = [
        sweep.Trial("a", "none", PLAIN, 1, 2, 3), sweep.Trial("b", "none", PLAIN, 2, 3, 3), sweep.Trial("c", "wiki", PLAIN, 1, 2, 3),
    ]
    scores = sweep.sweep(corpus, trials, "doc_id", seed=2, vocabulary_size=None, terms_per_topic=4, window=10, subsampling_rate=0.5, parallelism=2)
    rows = scores.collect()
    assert [(row["config"], row["k"], row["min_df"], row["documents"], row["vocabulary"]) for row in rows] == [
        ("a", 2, 1, 80, 10), ("b", 3, 2, 80, 10), ("c", 2, 1, 80, 10)]
    assert all(len(row["topics"]) == row["k"] and all(len(topic) == 4 for topic in row["topics"]) for row in rows)
    assert all(-1 <= row["coherence"] <= 1 for row in rows)
    sinks.write_scores(scores, f"{tmp_path}/scores")
    part = next((tmp_path / "scores").glob("part-*.csv")).read_text().splitlines()
    assert part[0] == "Topics,Coherence,Perplexity"
    sinks.write_report(scores, f"{tmp_path}/report")
    lines = [row["value"] for row in spark.read.text(f"{tmp_path}/report").collect()]
    assert len(lines) == 3 * 3 + 7 and "Preprocessing Variant: a" in lines
    assert sum(line.startswith("Topic 1: ") for line in lines) == 3


def test_equal_trials_share_a_fit(corpus, monkeypatch):
    fits = []
    real = topics.fit_prepared
    monkeypatch.setattr(topics, "fit_prepared", lambda *more: fits.append(more[1:3]) or real(*more))
    kept = TokenConfig(stop_words=None, cleanup="disabled")
    trials = [sweep.Trial("a", "none", PLAIN, 1, 2, 3), sweep.Trial("b", "none", kept, 1, 2, 3), sweep.Trial("c", "none", PLAIN, 1, 3, 3)]
    rows = sweep.sweep(corpus, trials, "doc_id", seed=2, vocabulary_size=None, terms_per_topic=4, window=10).collect()
    assert sorted(fits) == [(2, 3), (3, 3)]
    assert [row["config"] for row in rows] == ["a", "b", "c"] and rows[0]["coherence"] == rows[1]["coherence"]


def test_a_stopped_sweep_goes_on(spark, corpus, tmp_path, monkeypatch):
    """The third fit fails; the next run fits the third and the fourth only, and rows are those of a run that was not stopped."""
    trials = [sweep.Trial("a", "none", PLAIN, 1, 2, 2), sweep.Trial("b", "none", PLAIN, 1, 3, 2), sweep.Trial("c", "none", PLAIN, 2, 2, 2), sweep.Trial("d", "wiki", PLAIN, 1, 2, 2)]
    fits, real = [], topics.fit_prepared

    def stopped(*more):
        fits.append(more[1:3])
        if len(fits) == 3:
            raise RuntimeError("lost")
        return real(*more)

    run = lambda **more: sweep.sweep(corpus, trials, "doc_id", seed=2, vocabulary_size=None, terms_per_topic=4, window=10, **more)
    monkeypatch.setattr(topics, "fit_prepared", stopped)
    with pytest.raises(RuntimeError, match="lost"):
        run(results=f"{tmp_path}/done")
    assert sorted(row["config"] for row in sweep.stored_results(spark, f"{tmp_path}/done").collect()) == ["a", "b"]
    rows = run(results=f"{tmp_path}/done").collect()
    assert len(fits) == 3 + 2
    plain = run().collect()
    assert [row[:5] for row in rows] == [row[:5] for row in plain]
    assert [row["coherence"] for row in rows] == pytest.approx([row["coherence"] for row in plain])
    assert run(results=f"{tmp_path}/done").collect() == rows and len(fits) == 3 + 2 + 4


def test_held_out_rows_are_likelier_with_their_topics(corpus):
    both = fit_topics(corpus.where("doc_id < 60"), ["doc_id"], seed=3, vocabulary_size=None, tokens=PLAIN, k=2, max_iter=30, weighting="count", subsampling_rate=0.5)
    one = fit_topics(corpus.where("doc_id < 60"), ["doc_id"], seed=3, vocabulary_size=None, tokens=PLAIN, k=1, max_iter=30, weighting="count", subsampling_rate=0.5)
    unseen = topics_vectors(corpus.where("doc_id >= 60"), both.vocabulary)
    assert topics.held_out_log_perplexity(both.model, unseen) < topics.held_out_log_perplexity(one.model, unseen) - 0.3


def topics_vectors(rows, vocabulary):
    return vectors.document_vectors(token_table(rows, PLAIN, ["doc_id"]), vocabulary, ["doc_id"], vectors.COUNT)


def test_narrow_and_shuffled_inference_agree(fitted):
    """With the topics broadcast, and with blocks of rows that ask for their terms."""
    for complete in (False, True):
        narrow, shuffled = (
            sorted(topics._scored(fitted.model, fitted.vectors, complete, limit).collect(), key=lambda row: row["doc_id"]) for limit in (1 << 26, 0))
        assert [row["doc_id"] for row in narrow] == [row["doc_id"] for row in shuffled] and len(narrow) == 80
        for a, b in zip(narrow, shuffled):
            assert a["_gamma"] == pytest.approx(b["_gamma"]) and a["_score"] == pytest.approx(b["_score"]) and a["_mass"] == b["_mass"]


def test_against_a_model_in_one_process(corpus):
    """The same iterations on dense matrices: every term's weights, touched or not, and the prior."""
    rare = corpus.withColumn("content", F.concat("content", F.lit(" only"), F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij")))
    table = token_table(rare, PLAIN, ["doc_id"])
    weights = stored(terms.idf(terms.vocabulary(stored(terms.term_statistics(terms.bag_of_words(table, ["doc_id"]))), 1, size=None), F.lit(81)))
    made = vectors.document_vectors(table, weights, ["doc_id"], vectors.COUNT)
    k, rounds, seed, slices = 3, 7, 5, 4
    model = topics.fit(made, ["doc_id"], k, rounds, seed, 1 / slices)
    rows = vectors.entries(made, ["doc_id"]).withColumn("slice", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(slices))).collect()
    size, eta, alpha = rows[0]["size"], 1 / k, np.full(k, 1 / k)
    lam = topics._start(np.arange(size), k, seed)
    batches = [[r for r in rows if r["slice"] == s] for s in range(slices)]
    for t in range(1, rounds + 1):
        batch, rate = batches[(t - 1) % slices], (1024 + t) ** -0.51
        beta = np.exp(special.digamma(lam) - special.digamma(lam.sum(axis=0)))
        added, logs = np.zeros_like(lam), np.zeros(k)
        for r in batch:
            n = np.array(r["values"])
            gamma, share, norm = topics._infer(n, beta[r["indices"]], alpha)
            added[r["indices"]] += np.outer(n / norm, share)
            logs += special.digamma(gamma) - special.digamma(gamma.sum(keepdims=True))
        lam = (1 - rate) * lam + rate * (eta + len(rows) / len(batch) * added * beta)
        alpha = topics._alpha_step(alpha, logs, len(batch), rate)
    found = np.array([r["weights"] for r in model.topics.orderBy("term_id").collect()])
    assert np.allclose(found, lam, rtol=1e-9) and np.allclose(model.totals, lam.sum(axis=0)) and np.allclose(model.alpha, alpha)


def test_held_and_shuffled_fits_agree(spark, monkeypatch):
    """Topics that are broadcast in each iteration, in one part and in several, and topics as tables."""
    rows = [(i, " ".join(f"w{chr(97 + (i * j) % 23)}{chr(97 + (i + j * j) % 19)}" for j in range(i % 37))) for i in range(150)]
    table = token_table(spark.createDataFrame(rows, "doc_id int, content string"), PLAIN, ["doc_id"])
    weights = stored(terms.idf(terms.vocabulary(stored(terms.term_statistics(terms.bag_of_words(table, ["doc_id"]))), 1, size=None), F.lit(150)))
    made = vectors.document_vectors(table, weights, ["doc_id"])
    found = []
    for limit, part in ((1 << 26, 1 << 20), (1 << 26, 512), (0, 512)):
        monkeypatch.setattr(topics, "FIT_LIMIT_BYTES", limit)
        monkeypatch.setattr(topics, "PART_BYTES", part)
        found.append(topics.fit(made, ["doc_id"], 3, 5, 7, 0.4))
    first, *others = [np.array([row["weights"] for row in model.topics.orderBy("term_id").collect()]) for model in found]
    assert len(first) == found[0].terms > 100
    for model, other in zip(found[1:], others):
        assert np.allclose(first, other, rtol=1e-9) and np.allclose(found[0].totals, model.totals) and np.allclose(found[0].alpha, model.alpha)


def test_an_iteration_over_few_terms_writes_no_table(corpus, monkeypatch):
    made = topics_vectors(corpus, fit_topics(corpus, ["doc_id"], seed=3, vocabulary_size=None, tokens=PLAIN, k=2, max_iter=1).vocabulary)
    paths, real = [], topics.new_table_path
    monkeypatch.setattr(topics, "new_table_path", lambda spark: paths.append(1) or real(spark))
    topics.fit(made, ["doc_id"], 2, 9, 3, 0.5)
    assert len(paths) == 1


def test_iterations_over_many_terms_write_packed_rows(spark, monkeypatch):
    """Topics as tables: as many rows as parts and slices, not terms; the model does not depend on the parts."""
    rows = [(i, " ".join(f"w{chr(97 + (i * j) % 23)}{chr(97 + (i + j * j) % 19)}" for j in range(i % 37))) for i in range(150)]
    table = token_table(spark.createDataFrame(rows, "doc_id int, content string"), PLAIN, ["doc_id"])
    weights = stored(terms.idf(terms.vocabulary(stored(terms.term_statistics(terms.bag_of_words(table, ["doc_id"]))), 1, size=None), F.lit(150)))
    made = vectors.document_vectors(table, weights, ["doc_id"])
    held = topics.fit(made, ["doc_id"], 3, 5, 7, 0.4)
    monkeypatch.setattr(topics, "FIT_LIMIT_BYTES", 0)
    wanted = np.array([row["weights"] for row in held.topics.orderBy("term_id").collect()])
    for part_terms, least in ((1 << 18, 2), (5, 2), (1 << 18, 700)):
        monkeypatch.setattr(topics, "PART_TERMS", part_terms, raising=False)
        monkeypatch.setattr(topics, "LEAST_PARTS", least, raising=False)
        paths, real = [], topics.new_table_path
        with monkeypatch.context() as patch:
            patch.setattr(topics, "new_table_path", lambda spark: paths.append(real(spark)) or paths[-1])
            model = topics._fit(topics.prepare(made, ["doc_id"], 7, 0.4, 3), 3, 5, 7, 1024.0, 0.51, real(spark))
        assert np.allclose(wanted, [row["weights"] for row in model.topics.orderBy("term_id").collect()], rtol=1e-9)
        parts = max(least, -(-model.terms // part_terms))
        assert len(paths) == 5 and all(spark.read.parquet(path).count() <= 2 * parts + 1 for path in paths)


def test_grouped_rows_have_the_weights_of_single_ones():
    drawn = np.random.default_rng(5)
    sizes = np.r_[drawn.integers(0, 60, 300), 0, 2500, 3000, 9]
    starts = np.r_[0, np.cumsum(sizes)]
    places, counts = drawn.integers(0, 400, starts[-1]), drawn.uniform(0, 5, starts[-1])
    weights, alpha = drawn.uniform(1e-3, 1, (400, 7)), drawn.uniform(0.05, 0.3, 7)
    groups = [len(rows) for rows in topics._groups(sizes, 7)]
    assert max(groups) > 50 and sum(groups) == (sizes > 0).sum()
    seen = set()
    for row, *found in topics._infer_rows(places, starts, counts, weights, alpha):
        own = slice(starts[row], starts[row + 1])
        for one, other in zip(found, topics._infer(counts[own], weights[places[own]], alpha)):
            assert np.allclose(one, other, rtol=1e-9)
        seen.add(row)
    assert seen == set(np.flatnonzero(sizes).tolist())


def test_slow_rows_of_all_groups_share_their_rounds(monkeypatch):
    """Rounds are paid for by full matrices: a group's last rows go on beside the next group."""
    drawn = np.random.default_rng(3)
    monkeypatch.setattr(topics, "GROUP_NUMBERS", 1 << 13)
    sizes = drawn.integers(20, 60, 1500)
    starts = np.r_[0, np.cumsum(sizes)]
    places, counts = drawn.integers(0, 400, starts[-1]), drawn.uniform(0, 5, starts[-1])
    # Terms of few topics settle at once, those of topics that hardly differ late: one row of 30 is slow.
    weights, alpha = np.where(np.arange(400)[:, None] % 7 == np.arange(7), 1.0, 1e-6), np.full(7, 0.1)
    weights[350:] = drawn.uniform(0.5, 0.6, (50, 7))
    slow = np.repeat(drawn.integers(0, 30, 1500) == 0, sizes)
    places = np.where(slow, 350 + places % 50, places % 350)
    alone = 0
    rounds, real = [], topics.exp_digamma
    monkeypatch.setattr(topics, "exp_digamma", lambda x: rounds.append(len(x)) or real(x))
    for rows in topics._groups(sizes, 7):
        rounds.clear()
        own = np.concatenate([np.arange(starts[row], starts[row + 1]) for row in rows])
        topics._infer_all(places[own], np.r_[0, np.cumsum(sizes[rows])], counts[own], weights, alpha)
        alone += len(rounds)
    rounds.clear()
    added, logs = topics._learned(places, starts, counts, weights, alpha)
    assert 0 < 2 * len(rounds) < alone
    wanted, wanted_logs = np.zeros_like(weights), np.zeros(7)
    for row, gamma, share, norm in topics._infer_rows(places, starts, counts, weights, alpha):
        own = slice(starts[row], starts[row + 1])
        np.add.at(wanted, places[own], np.outer(counts[own] / norm, share))
        wanted_logs += special.digamma(gamma) - special.digamma(gamma.sum(keepdims=True))
    assert np.allclose(added, wanted * weights, rtol=1e-9) and np.allclose(logs, wanted_logs, rtol=1e-9)


def test_special_functions():
    x = np.array([0.01, 0.3, 1.0, 2.5, 10.0, 1000.0])
    assert np.allclose(special.log_gamma(x), [math.lgamma(one) for one in x], atol=1e-10)
    step = 1e-5 * x
    assert np.allclose(special.digamma(x), (special.log_gamma(x + step) - special.log_gamma(x - step)) / (2 * step), rtol=1e-5)
    assert np.allclose(special.exp_digamma(x), np.exp(special.digamma(x)), rtol=1e-12)
    assert np.allclose(special.trigamma(x), (special.digamma(x + step) - special.digamma(x - step)) / (2 * step), rtol=1e-5)
    drawn = special.gamma_drawn(np.arange(200_000), 100.0)
    assert abs(drawn.mean() - 1) < 0.002 and abs(drawn.std() - 0.1) < 0.002 and np.array_equal(drawn[:9], special.gamma_drawn(np.arange(9), 100.0))


def test_grids():
    assert [len(grid) for grid in (sweep.CLEANING_TRIALS, sweep.TOKEN_TRIALS, sweep.NGRAM_TRIALS, sweep.MIN_DF_TRIALS, sweep.TOPIC_TRIALS)] == [10, 3, 6, 5, 8]


def _tables(spark):
    """Intermediate tables there are just now."""
    path = spark._jvm.org.apache.hadoop.fs.Path(runtime.shared_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {one.getPath().getName() for one in files.listStatus(path) if one.getPath().getName().startswith("topicdrift-")}


def test_texts_stay_out_of_the_executors_memory(spark, corpus, monkeypatch):
    """Tokens are a written table, which is deleted when vocabulary and vectors are made."""
    def refuse(*_):
        raise AssertionError("kept in memory")

    monkeypatch.setattr(DataFrame, "persist", refuse)
    monkeypatch.setattr(type(corpus), "persist", refuse)
    before = _tables(spark)
    fitted = fit_topics(corpus, ["doc_id"], seed=3, vocabulary_size=None, tokens=PLAIN, k=2, max_iter=1)
    assert fitted.vectors.count() == 80
    made = [spark.read.parquet(f"{runtime.shared_folder(spark)}/{name}").columns for name in _tables(spark) - before]
    assert made and not any("tokens" in columns for columns in made)


def _wide(spark):
    rows = [(i, " ".join(f"w{chr(97 + (i * j) % 23)}{chr(97 + (i + j * j) % 19)}" for j in range(i % 37))) for i in range(150)]
    table = token_table(spark.createDataFrame(rows, "doc_id int, content string"), PLAIN, ["doc_id"])
    weights = stored(terms.idf(terms.vocabulary(stored(terms.term_statistics(terms.bag_of_words(table, ["doc_id"]))), 1, size=None), F.lit(150)))
    return vectors.document_vectors(table, weights, ["doc_id"])


def test_weights_are_written_in_small_rows_and_deleted_when_read(spark, monkeypatch):
    made = _wide(spark)
    wanted = np.array([row["weights"] for row in topics.fit(made, ["doc_id"], 3, 6, 7, 0.5).topics.orderBy("term_id").collect()])
    monkeypatch.setattr(topics, "FIT_LIMIT_BYTES", 0)
    monkeypatch.setattr(topics, "LEAST_PARTS", 2)
    monkeypatch.setattr(topics, "ROW_BYTES", 8 * 3 * 10, raising=False)
    prepared, paths, longest, there, real = topics.prepare(made, ["doc_id"], 7, 0.5, 3), [], [], [], topics.new_table_path

    def path(spark):
        if paths:
            rows = spark.read.parquet(paths[-1]).where("next >= 0")
            longest.append(rows.agg(F.max(F.octet_length("m"))).first()[0])
        there.append(len(_tables(spark) & {one.rpartition("/")[2] for one in paths}))
        paths.append(real(spark))
        return paths[-1]

    with runtime.intermediate_tables(spark):
        final = real(spark)
        monkeypatch.setattr(topics, "new_table_path", path)
        model = topics._fit(prepared, 3, 6, 7, 1024.0, 0.51, final)
        assert np.allclose(wanted, [row["weights"] for row in model.topics.orderBy("term_id").collect()], rtol=1e-9)
    assert len(paths) == 6 and max(longest) <= 8 * 3 * 10
    assert max(there) <= 2 + 1


def test_only_terms_of_the_slice_are_broadcast(spark, monkeypatch):
    made, sizes, real = _wide(spark), [], topics._held_step
    prepared = topics.prepare(made, ["doc_id"], 7, 0.1, 3)
    monkeypatch.setattr(topics, "_held_step", lambda held, *more: sizes.append(len(held.value[0])) or real(held, *more))
    topics.fit_prepared(prepared, 3, len(prepared.rows), 7)
    own = prepared.docs.select("slice", F.explode("indices").alias("term")).groupBy("slice").agg(F.count_distinct("term").alias("n"))
    assert sizes == [row["n"] for row in own.orderBy("slice").collect()] and max(sizes) < prepared.terms


def test_a_cleaning_leaves_no_table_to_the_next(spark, corpus, monkeypatch):
    trials = [sweep.Trial(name, name, PLAIN, 1, 2, 1) for name in ("none", "urls", "files")]
    there, real = [], sweep._counted
    monkeypatch.setattr(sweep, "_counted", lambda *more: there.append(len(_tables(spark))) or real(*more))
    rows = sweep.sweep(corpus, trials, "doc_id", seed=2, vocabulary_size=None, terms_per_topic=4, window=10).collect()
    assert [row["config"] for row in rows] == ["none", "urls", "files"]
    assert len(there) == 3 and len(set(there)) == 1


def test_both_models_of_log_perplexity_share_the_dealt_rows(spark, tmp_path, monkeypatch):
    first, second = "sun moon star sky night ".split(), "bread milk egg salt oven ".split()
    rows = [(i, " ".join((first if i % 2 else second)[(i + j) % 5] for j in range(20 + i % 9)), "en", "s") for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    dealt, fits, prepare, fit = [], [], topics.prepare, topics._fit
    monkeypatch.setattr(models, "FINAL_ITERATIONS", 3)
    monkeypatch.setattr(modelling, "FINAL_ITERATIONS", 3)
    monkeypatch.setattr(topics, "prepare", lambda *more, **named: dealt.append(1) or prepare(*more, **named))
    monkeypatch.setattr(topics, "_fit", lambda prepared, k, *more: fits.append(k) or fit(prepared, k, *more))
    found = models.log_perplexity(spark, str(tmp_path)).first()
    assert len(dealt) == 1 and sorted(fits) == [2, 16]
    assert found["documents"] == 60 and found["vocabulary"] > 10
