import random
import zlib

import numpy as np
from conftest_llm import EDGES, prose

from topicdrift.llm import toxicity
from topicdrift.llm.toxicity import fit, kept, label_model, scored


def corpus(n=900):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = prose(i, 80, 3000).split()
        for _ in range(6 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["slur", "insult", "vile!", "badform" + rng.choice("abcd")]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_fold(make, spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make(rows)
    model = fit(docs, table)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    score = {r.id: r.score for r in scored(docs, model).collect()}
    truth = {i: t for i, _, t in labels}
    assert sum((score[i] >= 0.5) == truth[i] for i in held) > 0.95 * len(held)
    # labels of the held-out fold are never read
    wrong = spark.createDataFrame([(i, q, 1 - t if i in held else t) for i, q, t in labels], table.schema)
    again = fit(docs, wrong)
    assert np.array_equal(model.weights, again.weights) and model.shift == again.shift
    left = {r.doc_id for r in kept(docs, model).collect()}
    assert left == {i for i in score if score[i] < 0.5} and kept(docs, model).dtypes == docs.dtypes


def test_edges_and_missing_labels(make, spark):
    docs = make(EDGES)
    schema = "doc_id long, quality int, toxic int"
    for rows in ([], [(4, 1, 1)], [(None, 1, 1), (4, None, None), (5, 1, 0), (5, 1, 1), (6, 0, 0)]):
        model = fit(docs, spark.createDataFrame(rows, schema))
        found = scored(docs, model).collect()
        assert len(found) == len(EDGES) and all(0 <= r.score <= 1 for r in found)
    assert scored(docs.limit(0), model).count() == 0 and kept(docs.limit(0), model).count() == 0
    assert kept(docs, model, limit=2.0).count() == len(EDGES)


def test_sample_is_bounded(make, spark, monkeypatch):
    rows, labels = corpus(400)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda sample, share: seen.append((len(sample), share)) or toxicity.Model(np.zeros(1), 0.0))
    fit(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows=50)
    assert seen[0][0] == 50 and 0.1 < seen[0][1] < 0.25


def test_label_model_mends_labels_and_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    voters = np.stack([np.where(truth, rng.random(4000) < 0.7, rng.random(4000) < 0.05) for _ in range(8)], axis=1)
    given = np.where(rng.random(4000) < 0.15, ~truth, truth).astype(float)
    found = label_model(voters, given, np.ones(4000)) > 0.5
    assert (found == truth).mean() > 0.95 > (given == truth).mean()
    noise = rng.random(4000) < 0.2
    copies = np.column_stack([voters, *[noise] * 20])
    assert ((label_model(copies, given, np.ones(4000)) > 0.5) == truth).mean() > 0.95
