from __future__ import annotations

import base64
import hashlib
import random
import weakref

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from netkpi.llm.byte_bpe import EncodedPiece, PrefixEncoder, decode, digests, encode, encoder_of, read_ranks
from netkpi.llm.common import hashes_of, word_hash
from tests.llm.fixtures import document_rows, documents

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return PrefixEncoder(read_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = st.text(st.sampled_from("ab eiostn'\n\t .,12 é́ßÉ \U0001f600\x1c\x85") | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encodes_as_the_library(encoder, library, text):
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, " " * 50 + "x", "x" + " " * 50, "\n" * 40, "don't we'll", "  a  b  \n c "])
def test_long_and_blank(encoder, library, text):
    assert encoder.encode(text) == library.encode_ordinary(text)


def test_appends_and_edits_agree_with_encoding_anew(encoder):
    r = random.Random(5)
    alphabet = b"etaoin shrdlu''..  the"
    for _ in range(60):
        piece = EncodedPiece(encoder)
        for _ in range(4):
            piece.append(bytes(r.choices(alphabet, k=r.randint(0, 30))))
        for _ in range(6):
            start = r.randint(0, len(piece.piece))
            end = min(len(piece.piece), start + r.randint(0, 5))
            piece.replace(start, end, bytes(r.choices(alphabet, k=r.randint(0, 5))))
            assert piece.last == EncodedPiece(encoder, piece.piece).last
            assert b"".join(encoder.token_bytes[i] for i in piece.ids()) == piece.piece


def test_an_edit_stays_local(encoder):
    piece = EncodedPiece(encoder, b"the quick brown fox " * 400)
    assert piece.replace(50, 52, b"zz") < 1000
    assert piece.last == EncodedPiece(encoder, piece.piece).last


def test_documents(spark, library):
    want = sorted(
        (
            (
                d,
                len(ids := library.encode_ordinary(t or "")),
                hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((t or "").encode()).hexdigest(),
            )
            for d, t, _ in document_rows()
        ),
        key=repr,
    )
    found = digests(documents(spark, clashing=True), PATH).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert digests(documents(spark, []), PATH).collect() == []


def test_round_trip(spark):
    encoded = encode(documents(spark), PATH)
    for r in decode(encoded, PATH).collect():
        assert bytes(r.data) == (r.row.text or "").encode()


def test_a_worker_keeps_one_operators_memory():
    first = encoder_of(PATH, P.PATTERN)
    first.encode("some words")
    assert encoder_of(PATH, P.PATTERN) is first  # tasks of one operator share it
    gone = weakref.ref(first)
    del first
    hashes = hashes_of([b"a", b"b"]).tolist()
    assert gone() is None and len(word_hash) == 2
    assert encoder_of(PATH, P.PATTERN).encode("a") and not word_hash
    assert hashes_of([b"a", b"b"]).tolist() == hashes


def test_line_feeds_and_signs_use_the_words_table(encoder, library):
    text = "Qorandeth anqorth.\nAnqorth zanqorth, qorandeth\nqorandeth: x\x1c\ny \nz\n\n w\n"
    for part in (text, text[:50], text[:-2], "\n", "\na", "a\n", "a\n\nb", "a\x85\nb", "q\n."):
        assert encoder.encode(part) == library.encode_ordinary(part)
    fresh = PrefixEncoder(read_ranks(PATH))
    fresh.encode("mun qorandeth, qorandeth.\nlun qorandeth")
    # one entry per word: a word across a line feed is none, and a sign does not encode the word again
    assert set(fresh._of_word) == {"qorandeth", "qorandeth,", "qorandeth."}
    assert set(fresh._of_chunk) == {"mun", "lun"}


def test_prefixes_are_shared_and_agree_with_the_table(encoder):
    r = random.Random(8)
    words = ["".join(r.choices(["th", "ing", "tion", "e", "r", "an", "ó", "ñ"], k=r.randint(1, 9))) for _ in range(400)]
    for word in words:
        piece = word.encode()
        assert list(encoder._encode_prefix(piece)) == EncodedPiece(encoder, piece).ids()
    assert any(w.encode()[:n] in encoder._of_prefix for w in words for n in range(1, len(w)))


def test_digests_keep_named_columns(spark):
    found = digests(documents(spark), PATH, keep=["doc_id"])
    assert found.schema["row"].dataType.names == ["doc_id"]
