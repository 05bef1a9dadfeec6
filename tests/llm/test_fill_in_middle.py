from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from netkpi.llm import fill_in_middle as fim
from netkpi.llm import sql
from netkpi.llm.fill_in_middle import fill_in_middle, restore, reverse, rotate, token_ends
from netkpi.llm.queries import op11_fill_in_middle
from tests.conftest import SF_DIR
from tests.llm.fixtures import CLASHING, document_rows, documents

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """n, form, prefix_chars, middle_chars, output by slices of the list of tokens."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rotation(monkeypatch):
    monkeypatch.setattr(fim, "_SWAPPED", 3)
    r = random.Random(1)
    for _ in range(300):
        data = r.randbytes(r.randint(0, 40))
        i, j, k = sorted(r.choices(range(len(data) + 1), k=3))
        block = bytearray(data)
        reverse(block, i, k)
        assert block == data[:i] + data[i:k][::-1] + data[k:]
        block = bytearray(data)
        rotate(block, i, j, k)
        assert block == data[:i] + data[j:k] + data[i:j] + data[k:]
        rotate(block, i, i + k - j, k)
        assert block == data


def test_token_ends():
    for text in ("", " ", "a", " a", "a ", "a b", "  a\n\tb  ", "é\x0bß ", " x", "\r\n"):
        at, ends = 0, []
        for t in TOKEN.findall(text):
            at += len(t.encode())
            ends.append(at)
        assert token_ends(text.encode()).tolist() == ends, repr(text)


@pytest.mark.parametrize("clashing", [False, True])
def test_equals_plain_version(spark, clashing):
    rows = document_rows() + [(100 + i, t, "a") for i, t in enumerate(("a <P> b", "<S>", "x<M>", "<P <S", "<", "P>", "<P"))]
    rows += [(200 + i, f"w{i} \n<P" + "é ÿ" * (i % 5) + "<S <" * (i % 3), "b") for i in range(60)]
    found = fill_in_middle(documents(spark, rows, clashing))
    got = sorted(
        ((r.row.doc_id or 0, r.row.text or "", r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()), key=str
    )
    assert got == sorted(((i or 0, t or "", *plain(i, t)) for i, t, _ in rows), key=str)
    assert {r[3] for r in got} == {"plain", "spm", "psm"}
    assert sum(r[3] == "psm" for r in got) >= 3
    back = restore(found).collect()
    assert len(back) == len(rows) and all(r.text == (r.row.text or "") for r in back)
    if clashing:
        assert all(r.row[c] == f"{c}!" for r in back for c in CLASHING)


def test_small_batches_and_long_texts(spark, monkeypatch):
    long = "".join(random.Random(3).choices("ab é\n", k=3_000_000))
    rows = [(i, long[i:], "a") for i in range(4)]
    found = {r.row.doc_id: r for r in fill_in_middle(documents(spark, rows)).collect()}
    for i, text, _ in rows:
        r = found[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(i, text)
        assert fim.restored(r.output.encode(), r.form) == text.encode()
    assert fill_in_middle(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        fim.restored(b"x", "other")


def test_query_equals_sql(spark):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    found = sorted(tuple(r[c] for c in names) for r in op11_fill_in_middle(spark, SF_DIR).collect())
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS FROM '{SF_DIR}/documents.parquet'")
        want = con.sql(sql.FILL_IN_MIDDLE).fetchall()
    assert found == sorted(want)
