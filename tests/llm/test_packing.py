from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from netkpi.llm import packing
from netkpi.llm.packing import ByteIds, balanced_windows, difference, pack
from netkpi.llm.queries import op13_packing
from tests.conftest import SF_DIR
from tests.llm.fixtures import document_rows, documents

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, texts, library, capacity):
    """Pieces against the library: every id once, windows without gaps; returns the sums of windows."""
    want = defaultdict(list)  # documents by id: rows may repeat ids
    for doc_id, text in texts:
        want[doc_id].append(library.encode(text or "", add_special_tokens=False).ids + [0])
    found = defaultdict(lambda: defaultdict(list))
    for r in rows:
        found[r.doc_id][r.start].append(r)
    assert set(found) == set(want)
    for doc_id, documents_of in want.items():
        pieces = [r for at in found[doc_id].values() for r in at]
        assert sum(r.length for r in pieces) == sum(map(len, documents_of))
        for r in pieces:
            assert any(
                len(ids) == r.doc_tokens and ids[r.start : r.start + r.length] == list(r.ids) for ids in documents_of
            )
        if len(documents_of) == 1:
            joined = [i for at in sorted(found[doc_id]) for r in found[doc_id][at] for i in r.ids]
            assert joined == documents_of[0]
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for members in windows.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return [sum(n for _, n in m) for m in windows.values()]


def test_difference_keeps_every_item():
    r = np.random.default_rng(1)
    for n, m in itertools.product((1, 2, 7, 60, 300), (1, 2, 5, 40)):
        sizes = r.integers(1, 200, n)
        sums, held = difference(sizes, m)
        assert sorted(i for w in held for i in w) == list(range(n))
        assert [int(sizes[w].sum()) for w in held] == sums.tolist() == sorted(sums, reverse=True)
        assert len(held) == min(n, m)


def test_difference_by_hand():
    # the example of the method: 8, 7, 6, 5, 4 in two windows differ by 2 (16 and 14)
    assert difference(np.array([8, 7, 6, 5, 4]), 2)[0].tolist() == [16, 14]
    assert difference(np.array([5, 5, 5, 5]), 4)[0].tolist() == [5, 5, 5, 5]
    assert difference(np.array([], dtype=int), 3)[1] == []


def test_windows_rise_until_they_fit():
    # three items of 6 do not fit into the two windows of 10 that their sum asks for
    assert sorted(map(sorted, balanced_windows([6, 6, 6], 10))) == [[0], [1], [2]]
    assert balanced_windows([], 10) == []
    r = np.random.default_rng(2)
    for _ in range(50):
        sizes = r.integers(1, 257, r.integers(1, 400))
        held = balanced_windows(sizes, 1024)
        sums = [sizes[w].sum() for w in held]
        assert max(sums) <= 1024 and sorted(i for w in held for i in w) == list(range(len(sizes)))
        least = -(-sizes.sum() // 1024)
        assert len(held) <= least * 1.05 + 1  # near the least number of windows
        assert max(sums) - min(sums) <= 256


@pytest.mark.parametrize("seed", range(4))
def test_ids_equal_the_library(library, seed):
    r = random.Random(seed)
    signs = ["a", "Z", "é", "ÿ", "÷", " ", "  ", "\n", "\t", "\r", "\x0b", "'s", "'ll", "'", "7", "42", "²", ".", "!?", "_",
             "<|endoftext|>", " ", "　", "\x85", "\x1c", "中", "Ж", "́", "\U0001f600", "ß", "\x00", "´"]
    encoder = ByteIds(PATH)
    for _ in range(1500):
        text = "".join(r.choices(signs if r.random() < 0.5 else signs[:20], k=r.randint(0, 30)))
        assert encoder.of(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_segments_do_not_show(library, monkeypatch):
    monkeypatch.setattr(packing, "_SEGMENT", 7)
    text = " ".join(t or "" for _, t, _ in document_rows())[:20_000]
    assert ByteIds(PATH).of(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("batch_docs, capacity, grain", [(1024, 1024, 256), (5, 64, 64), (3, 50, 7), (1, 1, 1)])
def test_pieces(spark, library, batch_docs, capacity, grain):
    rows = document_rows() if capacity > 1 else document_rows()[:6]
    found = pack(documents(spark, rows, clashing=True), PATH, capacity, grain=grain, batch_docs=batch_docs).collect()
    sums = check(found, [(i, t) for i, t, _ in rows], library, capacity)
    if capacity == 1024:
        assert sum(1024 - s for s in sums) <= 0.25 * sum(sums)  # three tasks with few rows each


def test_empty_and_long(spark, library):
    assert pack(documents(spark, []), PATH).count() == 0
    long = "word " * 400_000 + "é" * 3000
    found = pack(documents(spark, [(1, long, "a"), (2, None, "a"), (3, "", None)]).coalesce(1), PATH).collect()
    check(found, [(1, long), (2, None), (3, "")], library, 1024)


def test_query(spark, library):
    rows = op13_packing(spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    ids = {d.doc_id: np.array(library.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4") for d in docs}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    covered = defaultdict(int)
    for r in rows:
        covered[r.doc_id] += r.length
    assert covered == {i: len(v) for i, v in ids.items()}
    sums = defaultdict(int)
    for r in rows:
        sums[r.sequence_id] += r.length
    assert max(sums.values()) <= 1024
    assert sum(1024 - s for s in sums.values()) <= 0.02 * sum(sums.values())


def test_pieces_of_each_byte(library):
    encoder = ByteIds(PATH)
    for code in range(256):
        for text in (chr(code), f" {chr(code)}", f"a{chr(code)}b", f"{chr(code)} {chr(code)}"):
            assert encoder.of(text).tolist() == library.encode(text, add_special_tokens=False).ids
