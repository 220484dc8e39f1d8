import re

import pytest
from conftest_llm import EDGES, prose, words

import corpus_pipeline
from topicdrift.llm import queries


@pytest.fixture(scope="module")
def folder(tmp_path_factory, make, spark):
    base = tmp_path_factory.mktemp("tables")
    toxic = [(2000 + i, prose(900 + i, 60, 3000) + " slur vile insult slur vile " + prose(950 + i, 10)) for i in range(60)]
    plain = [(1000 + i, prose(200 + i, 90, 3000)) for i in range(200)]
    near = [(3000 + i, re.sub(r"w\d+$", f"end{i}", plain[0][1])) for i in range(8)]
    passage = [(3100 + i, prose(600 + i, 30, 3000) + " " + prose(7, 60, 3000) + " " + prose(640 + i, 30, 3000)) for i in range(6)]
    leak = [(3200, prose(700, 30, 3000) + " " + prose(8, 40, 3000))]
    rows = toxic + plain + near + passage + leak + [(i, t) for i, t in EDGES if i != 9]
    make(rows).write.parquet(f"{base}/documents.parquet")
    labels = [(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in plain]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, prose(8, 40, 3000))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_each_stage_takes_effect_and_keeps_the_rest(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
        result = corpus_pipeline.stored(stage(spark, docs, folder))
        if name != "packing":
            assert result.dtypes == columns
            after = {r.doc_id: r.text for r in result.where("doc_id is not null").collect()}
            seen.append((name, set(before) - set(after), {i for i in after if after[i] != before[i]}))
        docs = result
    gone = dict((name, left) for name, left, _ in seen)
    assert gone["toxicity"] <= {2000 + i for i in range(60)} and len(gone["toxicity"]) >= 40
    assert {3000 + i for i in range(8)} <= gone["near_duplicates"] and not gone["near_duplicates"] & set(range(1000, 1200))
    assert not gone["repeated_passages"] & set(range(1000, 1200))
    changed = dict((name, left) for name, _, left in seen)
    assert changed["repeated_passages"] >= {3101 + i for i in range(5)} and not changed["repeated_passages"] & {3100, *range(1000, 1200)}
    assert gone["decontamination"] == {3200} and not changed["decontamination"] | changed["toxicity"] | changed["near_duplicates"]
    pieces = docs.collect()
    assert {p.doc_id for p in pieces if p.doc_id} >= set(range(1000, 1200)) and len({p.sequence_id for p in pieces}) > 1


def test_run_and_queries(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 200
    assert [name for name in queries.QUERIES if re.match(r"op\d+_", name)] == [
        "op1_substring_dedup", "op2_packing", "op3_toxicity", "op4_decontamination", "op5_near_dedup", "op6_url_reputation",
        "op7_quality_rules", "op8_lm_scores", "op9_html_text", "op10_token_files", "op11_whitening",
        "op12_target_resampling", "op13_sharding"]
    found = queries.op1_substring_dedup(spark, folder)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and words("a b")
