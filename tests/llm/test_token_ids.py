import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import EDGES, prose
from tokenizers import Tokenizer

from topicdrift.llm import tokens
from topicdrift.llm.packing import packed
from topicdrift.llm.rans import CHECKPOINT_STEPS, LANES, Table, decode, encode
from topicdrift.llm.token_files import ids_between, read, write

FILES = {"byte": public_tokenizers.path("byte_bpe_50k.json"), "word": public_tokenizers.path("word_bpe_49k.json")}
ROWS = EDGES + [(20 + i, prose(i, 300 * i)) for i in range(12)]


TOKENIZERS = {kind: Tokenizer.from_file(path) for kind, path in FILES.items()}


def direct(kind, text, end):
    tokenizer = TOKENIZERS[kind]
    tokenizer.encode_special_tokens = True
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_ids_are_those_of_the_tokenizer(kind, monkeypatch):
    rng = random.Random(3)
    letters = "aAbT01 .,\n\t  é'ßΣ\x1c!-’İ́中🙂\r\x0b 　\x85\xa0 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(3000)]
    texts += ["<|endoftext|> it's don't", "a.", ".", "A, b.\nC", "Ab. " * 50, None, ""]
    monkeypatch.setattr(tokens, "TABLE_PLACES", 1 << 6)  # the table starts anew many times
    tokens._encoders.clear()
    parts = [pa.array(texts[k : k + 40], pa.string()) for k in range(0, len(texts), 40)]
    found = [x.astype("<u4").tolist() for part in parts for x in tokens.encoded(part, FILES[kind], kind, 2)]
    tokens._encoders.clear()
    plain = tokens.Encoder(FILES[kind], kind, 2)
    assert found == [[*x.tolist(), 2] for x in plain.whole([text or "" for text in texts])]


def check_pieces(rows, found, length):
    expected = sorted((repr(i), direct("byte", text, 1).tobytes()) for i, text in rows)
    by_doc = {}
    for r in found:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    pools = {}
    for i, text in rows:
        pools.setdefault((i, len(direct("byte", text, 1))), []).append(direct("byte", text, 1))
    assert set(by_doc) == set(pools) and expected
    for key, pieces in by_doc.items():
        copies = len(pools[key])
        assert sum(p.length for p in pieces) == copies * key[1]
        if copies == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.length > 0
                assert p.ids_crc32 == zlib.crc32(pools[key][0][at : at + p.length].tobytes())
                at += p.length
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    total = sum(r.length for r in found)
    return len(sequences), -(-total // length)


@pytest.mark.parametrize(("partitions", "windows"), [(1, 64), (40, 2), (7, 1)])
def test_packing(make, partitions, windows):
    found = packed(make(ROWS, partitions), FILES["byte"], windows=windows, length=256, least_cut=16).collect()
    sequences, least = check_pieces(ROWS, found, 256)
    assert sequences <= least * 1.05 + 2


def test_packing_of_nothing(make):
    assert packed(make(ROWS).limit(0), FILES["byte"]).count() == 0


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, LANES, LANES * (CHECKPOINT_STEPS + 3) + 7):
        ids = np.minimum(rng.zipf(1.3, n), 49_000).astype("<u2")
        table = Table(np.bincount(ids, minlength=1 << 16))
        frame = encode(ids, table)
        assert (decode(frame, table) == ids).all()
        if n > LANES * CHECKPOINT_STEPS:  # each part can be read alone
            cut = LANES * CHECKPOINT_STEPS
            assert (decode(frame, table, 1) == ids[cut:]).all() and (decode(frame, table, 0, 1) == ids[:cut]).all()
            p = np.bincount(ids) / n
            assert len(frame) * 8 < 1.05 * n * -(p[p > 0] * np.log2(p[p > 0])).sum() + 64 * LANES * 4
        if n:
            for place in (3, len(frame) // 2, len(frame) - 1):
                with pytest.raises(ValueError):
                    decode(frame[:place] + bytes([frame[place] ^ 1]) + frame[place + 1 :], table)
            with pytest.raises(ValueError):
                decode(frame, Table(np.bincount(ids, minlength=1 << 16) + 1))


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_token_files(make, spark, tmp_path, monkeypatch, block):
    import topicdrift.llm.token_files as module

    monkeypatch.setattr(module, "BLOCK_IDS", block)
    folder = str(tmp_path / "ids")
    write(make(ROWS, 5), folder, FILES["word"])
    found = read(spark, folder).orderBy("start").collect()
    order = [(-1 if r.doc_id is None else r.doc_id) for r in found]
    assert order == sorted(order) == sorted(-1 if i is None else i for i, _ in ROWS)
    at, got, wanted = 0, [], sorted((repr(i), direct("word", t, 2).tolist()) for i, t in ROWS)
    for r in found:
        ids = np.frombuffer(r.ids, "<u2")
        assert r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        at += len(ids)
        got.append((repr(r.doc_id), ids.tolist()))
    assert sorted(got) == wanted
    every = np.concatenate([np.frombuffer(r.ids, "<u2") for r in found])
    for begin, end in ((0, at), (3, 7), (at // 3, at // 2), (at - 1, at + 10), (-5, 1), (at, at + 3), (7, 7), (9, 2)):
        cut = ids_between(spark, folder, begin, end).orderBy("start").collect()
        first = max(begin, 0)
        assert np.array_equal(np.concatenate([np.zeros(0, "<u2"), *[np.frombuffer(r.ids, "<u2") for r in cut]]), every[first : max(end, first)])
        assert [r.start for r in cut] == [first + sum(x.n_tokens for x in cut[:i]) for i in range(len(cut))]


def test_a_range_starts_at_its_checkpoint(spark, make, tmp_path, monkeypatch):
    folder, span = str(tmp_path / "ids"), LANES * CHECKPOINT_STEPS
    write(make([(1, "ab cd " * (span // 2 + 900)), (2, "ef gh")], 1), folder, FILES["word"])
    every = np.concatenate([np.frombuffer(r.ids, "<u2") for r in read(spark, folder).orderBy("start").collect()])
    assert len(every) > span + 900
    for begin, end in ((span - 3, span + 3), (span, span + 1), (span + 500, len(every)), (5, 6)):
        (row,) = ids_between(spark, folder, begin, end).collect()
        assert row.start == begin and np.array_equal(np.frombuffer(row.ids, "<u2"), every[begin:end])


def test_token_files_of_nothing(make, spark, tmp_path):
    folder = str(tmp_path / "ids")
    write(make(ROWS).limit(0), folder, FILES["word"])
    assert read(spark, folder).count() == 0 and ids_between(spark, folder, 0, 10).count() == 0
