from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netkpi.llm import sql, vector_blocks
from netkpi.llm.queries import op1_topk
from netkpi.llm.topk import ImpactIndex, index_of, top_k
from netkpi.llm.vector_blocks import LEAST, MOST, Best, Queries, as_kind, kind_for
from tests.conftest import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, score string, shard string, id string"


def plain(rows, k=5, every=50):
    vectors = set()
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.add((i, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for q in {i for i, _ in vectors if i % every == 0}:
        scored = [(-sum(a * b for a, b in zip(w, v)), i) for p, w in vectors if p == q for i, v in vectors if i != q]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(i, v, "s", "t", "u") for i, v in rows], SCHEMA)
    return sorted(map(tuple, top_k(df, F.col("id") % 50 == 0).collect()))


def vectors(n, dims, seed):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 0.2) for _ in range(dims)]) for i in range(n)]


def test_equals_plain_version(spark):
    rows = vectors(230, 16, 1)
    rows += [(300 + i, rows[50][1]) for i in range(40)]  # ties
    rows += [rows[3], (3, rows[4][1])]  # a repeated row, a repeated id
    rows += [(400, None), (401, [math.nan] * 16), (402, [math.inf] + [0.0] * 15), (403, [None] + [0.5] * 15), (None, [1.0] * 16)]
    rows += [(450, [0.0] * 16), (451, [1.0, 2.0]), (452, [])]
    want = plain([(i, v) for i, v in rows])
    assert found(spark, rows) == want
    assert len(want) > 25


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (7, [0.5])]) == [(0, 1, 7, 256 * 128)]


def searched(matrix, asked, k=5, ids=None):
    """Best rows of the index for some vectors, and the share of all products that it took."""
    ids = np.arange(len(matrix)) if ids is None else ids
    kind = kind_for(matrix.astype(float), asked.astype(float))
    n = len(asked)
    queries = Queries(np.arange(n) + 10**9, np.zeros(n), asked, np.full((n, 1), LEAST), np.full((n, 1), MOST))
    index, best = index_of(ids, as_kind(matrix.astype(float), kind)), Best(queries, k)
    for i, q in enumerate(as_kind(asked.astype(float), kind)):
        index.search(i, queries.ids[i], q, best)
    return best, (index.processed + index.rescored) / (n * matrix.size)


def check(matrix, asked, best, k=5):
    for i, q in enumerate(asked):
        scores = [sum(int(a) * int(b) for a, b in zip(v, q)) for v in matrix]
        order = sorted(range(len(matrix)), key=lambda r: (-scores[r], r))[:k]
        assert best.ids[i, 0][: best.n[i, 0]].tolist() == order
        assert best.scores[i, 0][: best.n[i, 0]].tolist() == [scores[r] for r in order]


@pytest.mark.parametrize("seed", range(4))
def test_random_dense_vectors_take_less_than_half(seed):
    """Unit vectors without any structure, as many as an index of a task has at the test scale."""
    r = np.random.default_rng(seed)
    vectors = r.normal(0, 1, (4000, 64))
    matrix = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.int64)
    best, share = searched(matrix, matrix[:12] + seed)
    check(matrix, matrix[:12] + seed, best)
    assert share < 0.5


def test_sparse_vectors_have_few_postings():
    r = np.random.default_rng(7)
    matrix = r.integers(-200, 200, (3000, 40)) * (r.random((3000, 40)) < 0.05)
    index = ImpactIndex(np.arange(3000), matrix.astype(float))
    assert sum(len(x) for _, x in index.segments) == np.count_nonzero(matrix - index.middle.astype(int))
    for (rows, x), largest in zip(index.segments, index.largest):
        assert x.all() and np.abs(x).max() < largest <= 2 * np.abs(x).max() and len(set(rows.tolist())) == len(x)
    asked = matrix[(matrix != 0).sum(axis=1) >= 3][:20]
    best, share = searched(matrix, asked)
    check(matrix, asked, best)
    assert share < 0.15


@pytest.mark.parametrize("case", range(7))
def test_index_is_exact(case):
    r = np.random.default_rng(case)
    matrix = [
        r.integers(-300, 300, (500, 8)),
        r.integers(0, 4, (800, 6)),  # many ties
        np.repeat(r.integers(-9, 9, (1, 5)), 400, axis=0),  # all rows the same
        r.integers(-5, 5, (300, 4)) + 10**6,  # far from zero
        r.integers(-(2**28), 2**28, (300, 8)),
        r.integers(-9, 9, (300, 4)) * 10 ** r.integers(0, 9, (300, 4)),  # of very different lengths
        np.zeros((90, 3), int),
    ][case]
    asked = np.concatenate([matrix[:9], -matrix[3:6], np.zeros((1, matrix.shape[1]), int)])
    best, _ = searched(matrix, asked)
    check(matrix, asked, best)


def test_floor_of_other_shards_is_used():
    r = np.random.default_rng(5)
    matrix = r.integers(-100, 100, (2000, 16))
    first, alone = searched(matrix, matrix[:5])
    queries = Queries(np.arange(5) + 10**9, np.zeros(5), matrix[:5], np.full((5, 1), LEAST), np.full((5, 1), MOST))
    queries.reached = first.floor + 1
    index, best = ImpactIndex(np.arange(2000), matrix.astype(float)), Best(queries, 5)
    for i in range(5):
        index.search(i, -1, matrix[i].astype(float), best)
    assert (index.processed + index.rescored) / (5 * matrix.size) <= alone
    assert all(best.n[i, 0] == (first.scores[i, 0] > first.floor[i, 0]).sum() for i in range(5))


def test_large_components(spark):
    """Bounds beyond 64 bits while scores fit; and scores that do not."""
    rows = [(0, [1.0]), (1, [1e14]), (2, [-1e14]), (3, [1.0]), (4, [2.0]), (5, [5e13])]
    want = plain(rows)
    assert len(want) == 5 and found(spark, rows) == want
    rows = [(0, [1e7, 1.0]), (1, [1e7, 1.0]), (2, [1.0, 7.0]), (3, [-3.0, 2e8])]
    assert found(spark, rows) == plain(rows)
    with pytest.raises(Exception, match="does not fit in 64 bits"):
        found(spark, [(0, [1e17, 1.0]), (1, [1e17, 1.0])])


def test_many_indexes_shards_blocks_and_rounds(spark, monkeypatch):
    for name, value in {"INDEX_ROWS": 9, "SHARD_ROWS": 15, "ROUND_STEPS": (4, 2, 1), "BLOCK_NUMBERS": 20}.items():
        monkeypatch.setattr(vector_blocks, name, value)
    rows = vectors(300, 8, 2) + [(300 + i, [0.25] * 8) for i in range(20)]
    assert found(spark, rows) == plain(rows)


def test_query_equals_sql(spark):
    rows = sorted(map(tuple, op1_topk(spark, SF_DIR).collect()))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS FROM '{SF_DIR}/embeddings.parquet'")
        assert rows == sorted(con.sql(sql.TOP_K).fetchall())
