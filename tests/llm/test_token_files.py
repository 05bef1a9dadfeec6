from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from netkpi.llm.common import scratch
from netkpi.llm.queries import op3_token_files
from netkpi.llm.token_files import PerfectHash, WordIds, fingerprints, global_starts, key_hashes, look_up, read_ids, write_token_files
from tests.llm.fixtures import document_rows, documents

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_perfect_hash(n):
    ids = np.random.default_rng(n).choice(10**12, n, replace=False)
    nth, missing = np.zeros(n, np.int64), np.zeros(n, bool)
    table = PerfectHash.build(ids, missing, nth)
    hashes = key_hashes(ids, missing, nth, table.salt)
    assert sorted(table.slots(hashes)) == list(range(n))
    stored = np.zeros(n, np.uint32)
    stored[table.slots(hashes)] = fingerprints(hashes)
    others = key_hashes(ids + 10**13, missing, nth, table.salt)
    assert (stored[table.slots(others)] == fingerprints(others)).sum() == 0


def test_round_trip(spark):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    files = write_token_files(documents(spark, clashing=True), scratch(spark), PATH)
    keys = files.documents.select("doc_id", "nth")
    places = look_up(files, keys)
    found = read_ids(files, places).join(global_starts(files), "shard").collect()
    found.sort(key=lambda r: r.before + r.start)
    rows = sorted(document_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in found] == [r[0] for r in rows]
    at = 0
    for r, (_, text, _) in zip(found, rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert r.before + r.start == at and r.n == len(ids)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    crc = {(r.doc_id, r.nth): r.ids_crc32 for r in read_ids(files, places, digest=True).collect()}
    assert crc == {(r.doc_id, r.nth): zlib.crc32(bytes(r.ids)) for r in found}


def test_unknown_keys_are_not_found(spark):
    files = write_token_files(documents(spark), scratch(spark), PATH)
    keys = spark.createDataFrame([(4, 0), (6, 1), (6, 2), (999, 0), (None, 0), (None, 1)], "doc_id long, nth long")
    assert {(r.doc_id, r.nth) for r in look_up(files, keys).collect()} == {(4, 0), (6, 1), (None, 0)}


def test_empty_table(spark):
    files = write_token_files(documents(spark, []), scratch(spark), PATH)
    assert read_ids(files, look_up(files, files.documents.select("doc_id", "nth"))).collect() == []


def test_query_reads_added_tokens_as_the_library_does(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    texts = ["a page <|endoftext|> more", "x<|endoftext|>'s\n<|startoftext|><|endoftext|>\té<|endoftext|>1", "<|ENDOFTEXT|> <|endoftext|"]
    rows = document_rows() + [(900 + i, text, "a") for i, text in enumerate(texts)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in op3_token_files(spark, str(tmp_path)).collect())
    want = [(i or -1, [*library.encode(text or "", add_special_tokens=False).ids, 1]) for i, text, _ in rows]
    assert found == sorted((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want)
    assert (900, [320, 2504, 49407, 750, 1]) in want


def test_plain_texts_are_cut_into_pieces_at_once():
    library = Tokenizer.from_file(PATH)
    encoder = WordIds(PATH, added_tokens=True)
    texts = ["Qoran, the\nQoran's qoran.", "don't 'll--'s x9\x0b\x0cÉTÉ été", "a\n\n b\r\n", "", "\n", "Σ a\ne\u0301 \u0301\nb <|endoftext|>\nc"]
    for text in texts:
        assert np.frombuffer(encoder.of(text), encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    fresh = WordIds(PATH, added_tokens=True)
    fresh.of(texts[0])
    # a word is encoded once, whatever its case and the signs and line feeds beside it
    assert not fresh.known and set(fresh.pieces) == {"qoran", ",", "the", "'s", "."}
