"""The stages against plain versions, each on the input it gets, over a small folder of tables."""

from __future__ import annotations

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry_points
import corpus_pipeline
from netkpi.llm.mixing import mix
from netkpi.llm.quality import quality_rules
from tests.llm import test_jaccard_join, test_line_dedup, test_quality
from tests.llm.fixtures import document_rows, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in prose(500 + i, 60).split()), "b") for i in range(30)]
    good = [(300 + i, prose(900 + i, 60), "ab"[i % 2]) for i in range(80)]
    rows = [(i, t, "xx", s, None if t is None else len(t)) for i, t, s in document_rows() + bad + good]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(300, 360)] + [(200 + i, 0, 0) for i in range(15)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = f"{folder}/{len(tables)}"
        stage(spark, tables[-1], folder).write.parquet(out)
        tables.append(spark.read.parquet(out))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [[(r.doc_id, r.text, r.source) for r in t.collect()] for t in tables[:-1]]
    # quality: what passes the base rules and the operator keeps; no clean document of the labelled kind goes
    judged = quality_rules(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert [r.base_failed for r in judged] == [test_quality.base(r.row.text)[-1] for r in judged]
    passed = [(r.row.doc_id, r.row.text, r.row.source) for r in judged if r.kept]
    assert test_line_dedup.ordered(rows[1]) == test_line_dedup.ordered(passed)
    kept = {r[0] for r in rows[1]}
    # clean documents stay; how much junk goes is measured in test_quality, on more documents than here
    assert len(kept & set(range(300, 380))) >= 77 and len(kept & set(range(200, 230))) < 30
    # line dedup
    want = [(i, kept) for i, _, _, kept in test_line_dedup.plain(rows[1])]
    assert test_line_dedup.ordered((i, t or "") for i, t, _ in rows[2]) == test_line_dedup.ordered(want)
    # near copies: one row per component, its least id
    found, _ = test_jaccard_join.plain(rows[2], 5, 80)
    least = {(row, c) for row, (_, _, c) in zip(rows[2], found)}  # rows that repeat id and text count once
    assert sorted(str(r[0]) for r in rows[3]) == sorted(str(row[0]) for row, c in least if row[0] == c)
    # mixing: as many rows as copies
    copies = {(r.row.doc_id, r.row.text): r.copies for r in mix(tables[3]).collect()}
    assert sorted(map(repr, rows[4])) == sorted(repr(r) for r in rows[3] for _ in range(copies[r[0], r[1]]))
    # token ids
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text, _ in rows[4]:
        ids = library.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    last = tables[5].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(repr, map(tuple, last))) == sorted(map(repr, want))
    # all at once
    whole = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(repr, map(tuple, whole))) == sorted(map(repr, want))


def test_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    names = entry_points.queries()
    assert "pipeline" in names and {n for n in range(1, 14)} == {int(q[2:].split("_")[0]) for q in names if q.startswith("op") and q[2].isdigit()}
