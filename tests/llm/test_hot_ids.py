"""One id, and NULL, in a third of the rows; columns whose names clash with those used inside."""

import zlib

import numpy as np
import pytest
from conftest_llm import prose
from pyspark.sql import functions as F
from test_substring_dedup import brute

from topicdrift.llm import decontamination, exchange, lm, substring_dedup, token_files, toxicity
from topicdrift.llm.queries import WORD_BPE
from topicdrift.runtime import new_table_path

ROWS = [(i, prose(i, 30)) for i in range(40)] + [(7, prose(i // 3, 40)) for i in range(40)] + [(None, prose(i // 2, 35)) for i in range(40)]
NAMES = ["doc_id", "text", "row_key", "no_text", "a.b", "carried", "block", "id", "columns", "tick`s"]


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, t, f"k{i}", i % 2 == 0, "dot", 5, 6, 7, "c", i) for i, t in [(1, prose(1, 40)), (2, prose(1, 40) + " " + prose(2, 40)), (3, None), (4, "")]]
    kinds = ["long", "string", "string", "boolean", "string", "int", "int", "int", "string", "int"]
    return spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(NAMES, kinds)))


def test_blocks_are_even(make):
    docs = make([(7, f"text {i}") for i in range(900)] + [(None, None)] * 900 + [(i, "x") for i in range(900)], 9)
    blocked, blocks = exchange.in_blocks(docs.select("doc_id", "text"), "doc_id", "text", rows_per_block=100)
    assert blocks == 27
    sizes = [r["count"] for r in blocked.groupBy("block").count().collect()]
    assert max(sizes) < 450 and sum(sizes) == 2700
    assert exchange.in_blocks(docs.select("doc_id", "text"), "doc_id", "text", bytes_per_block=100)[1] == 80


def test_passages(make):
    found = substring_dedup.factored(make(ROWS), rows_per_block=10)
    assert sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in found.collect()), key=repr) == brute(ROWS)


def test_scores_are_those_of_one_block(make):
    shown = lambda found: sorted(((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found.collect()), key=repr)
    assert shown(lm.scored(make(ROWS), rows_per_block=10)) == shown(lm.scored(make(ROWS)))


def test_token_files(make, spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    folder = new_table_path(spark)
    token_files.write(make(ROWS, 6), folder, WORD_BPE)
    found = token_files.read(spark, folder, with_ids=False).orderBy("start").collect()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in found] == sorted((i is not None, i or 0) for i, _ in ROWS)
    ends = np.cumsum([r.n_tokens for r in found])
    assert [r.start for r in found] == [0, *ends[:-1].tolist()]
    crc = lambda text: zlib.crc32(np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert sorted(((r.doc_id, r.ids_crc32) for r in found), key=repr) == sorted(((i, crc(t)) for i, t in ROWS), key=repr)


def test_one_row_of_a_labelled_id(make, spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda sample, share: seen.append(sorted(x.id for x in sample)) or toxicity.Model(np.zeros(1), 0.0))
    toxicity.fit(make(ROWS), spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int"))
    assert seen[0] == sorted(set(seen[0])) and 7 in seen[0]


def test_names_come_back(named, spark):
    model = toxicity.Model(np.zeros(1 << 22), -5.0)
    items = spark.createDataFrame([(1, prose(9, 20))], "item_id long, text string")
    for left in (toxicity.kept(named, model, limit=2.0), decontamination.clean(named, items)):
        assert left.columns == NAMES and sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, named.collect()), key=repr)
    left = substring_dedup.deduplicated(named)
    assert left.columns == NAMES
    rest = lambda rows: sorted((tuple(r)[:1] + tuple(r)[2:] for r in rows), key=repr)
    assert rest(left.collect()) == rest(named.collect())
    assert left.where("doc_id = 2").first().text.split() == prose(2, 40).split()


@pytest.mark.parametrize("n", range(15))
def test_short_texts_alone_in_a_batch(n, spark):
    import pyarrow as pa

    items = [(1, prose(3, 40)), (2, "five small words only here"), (3, prose(4, 9))]
    index = decontamination.shard(items)
    for text in (prose(5, n), prose(4, 9) + " " + prose(5, n), "five small words only here"):
        found = list(decontamination._found(pa.array([text]), index))
        assert [item for _, item, *_ in found] == [k for k, (_, t) in enumerate(items) if f" {t} " in f" {text} "]
