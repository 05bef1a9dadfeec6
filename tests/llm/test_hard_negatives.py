from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netkpi.llm import hard_negatives as mining
from netkpi.llm import sql, vector_blocks
from netkpi.llm.hard_negatives import RTree, hard_negatives, str_leaves
from netkpi.llm.queries import op12_hard_negatives
from netkpi.llm.vector_blocks import LEAST, MOST, Best, Queries, as_kind, kind_for
from tests.conftest import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, label int, query string, window string, id string, score string, v string"


def plain(rows, k=5, every=100, percents=(80, 100)):
    known = {
        (i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        for i, v, y in rows
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for a, y, q in known:
        if a % every:
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, v)), i, label) for i, label, v in known if i != a)
        for minus, positive, _ in [s for s in scored if s[2] == y][:k]:
            hard = [s for s in scored if s[2] != y and percents[0] * -minus <= 100 * -s[0] <= percents[1] * -minus]
            out += [(a, positive, rank, i, -minus, -s) for rank, (s, i, _) in enumerate(hard[:k], 1)]
    return sorted(out)


def found(spark, rows, **args):
    df = spark.createDataFrame([(*r, "s", "t", "u", "w", "x") for r in rows], SCHEMA)
    got = hard_negatives(df, F.col("id") % 100 == 0, F.col("label"), **args)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(n, dims, labels, seed, spread=0.2):
    r = random.Random(seed)
    return [(i, [r.gauss(0, spread) for _ in range(dims)], r.randrange(labels)) for i in range(n)]


def awkward():
    rows = vectors(420, 12, 3, 1)
    rows += [(500 + i, rows[100][1], i % 3) for i in range(30)]  # ties
    rows += [rows[200], (200, rows[5][1], 1), (200, rows[200][1], 2)]  # a repeated row, repeated ids
    rows += [(600, None, 1), (700, [math.nan] * 12, 1), (800, [math.inf] + [0.0] * 11, 1), (900, [None] + [0.5] * 11, 1)]
    rows += [(None, [1.0] * 12, 1), (1000, [0.5] * 12, None), (1100, [0.0] * 12, 0), (1200, [1.0, 2.0], 1), (1300, [], 2)]
    rows += [(1400, [0.5] * 12, 77)]  # alone with its label
    return rows


def test_equals_plain_version(spark):
    want = plain(awkward())
    assert found(spark, awkward()) == want
    assert len(want) > 100 and any(r[0] == 200 for r in want) and not any(r[0] == 1400 for r in want)


def test_many_trees_shards_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "INDEX_ROWS", 7)
    monkeypatch.setattr(vector_blocks, "SHARD_ROWS", 20)
    monkeypatch.setattr(vector_blocks, "ROUND_STEPS", (4, 2, 1))
    monkeypatch.setattr(vector_blocks, "BLOCK_NUMBERS", 24)
    assert len(vector_blocks._rounds(20)) == 3
    assert found(spark, awkward()) == plain(awkward())


def test_other_parameters(spark):
    rows = vectors(300, 6, 2, 4)
    assert found(spark, rows, positives=3, negatives=3, percents=(50, 90)) == plain(rows, 3, percents=(50, 90))


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [2.0], 2)]) == [(0, 1, 1, 2, 256 * 256, 256 * 230)]
    assert found(spark, [(0, [0.0], 1), (1, [1.0], 1), (2, [-0.9], 2)]) == [(0, 1, 1, 2, 0, 0)]  # a window of one score
    assert found(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)]) == []  # a negative score has no window


def test_large_components_are_exact(spark):
    rows = [(0, [2.0**21, 1.0], 1), (1, [2.0**21, 0.5], 1), (2, [2.0**21, -0.5], 2), (3, [2.0**21, -0.25], 2), (4, [-1.0, 3.0], 2)]
    assert found(spark, rows) == plain(rows) and len(plain(rows)) == 2
    rows = [(0, [1e11, 1.0], 1), (1, [5e2, 1.0], 1), (2, [5e2, 0.5], 2), (3, [-1e11, 0.0], 2), (4, [4.8e2, 0.25], 2)]
    assert found(spark, rows) == plain(rows) and len(plain(rows)) == 2
    with pytest.raises(Exception, match="does not fit in 64 bits"):
        found(spark, [(0, [1e14], 1), (1, [1e14], 1)])


def test_leaves_hold_every_row_once():
    r = np.random.default_rng(1)
    for n, dims, labels in ((1, 1, 1), (64, 3, 1), (65, 3, 9), (5000, 8, 3), (3000, 0, 2), (700, 2, 700)):
        y, matrix = r.integers(0, labels, n), r.integers(-50, 50, (n, dims)).astype(float)
        leaves = str_leaves(y, matrix)
        assert sorted(np.concatenate(leaves)) == list(range(n)) and max(map(len, leaves)) <= mining.LEAF_ROWS
        assert len(leaves) <= 2 * n / mining.LEAF_ROWS + labels + 1


@pytest.mark.parametrize("kind", [np.float64, np.int64, object])
def test_boxes_bound_their_rows(kind):
    r = np.random.default_rng(2)
    matrix = as_kind(r.integers(-300, 300, (2500, 5)).astype(float), kind)
    tree = RTree(np.arange(2500), r.integers(0, 4, 2500), matrix)
    q = as_kind(r.integers(-300, 300, (1, 5)).astype(float), kind)[0]
    scores = tree.matrix @ q
    members = [np.arange(a, b) for a, b in zip(tree.levels[0][0][:-1], tree.levels[0][0][1:])]
    for level, (starts, *_, first, last) in enumerate(tree.levels):
        if level:
            members = [np.concatenate(members[a:b]) for a, b in zip(starts[:-1], starts[1:])]
        least, most = tree.intervals(level, np.arange(len(first)), np.maximum(q, 0), np.minimum(q, 0))
        for node, rows in enumerate(members):
            assert least[node] <= scores[rows].min() and scores[rows].max() <= most[node]
            assert first[node] == tree.labels[rows].min() and last[node] == tree.labels[rows].max()
    assert sorted(np.concatenate(members)) == list(range(2500))


def test_search_prunes_what_cannot_count():
    """Vectors in clusters: most boxes lie outside of the windows or below the k-th best and are never scored."""
    r = np.random.default_rng(3)
    centres = r.normal(0, 200, (40, 16))
    matrix = np.floor(np.repeat(centres, 200, axis=0) + r.normal(0, 8, (8000, 16)))
    labels = np.repeat(np.arange(40) // 2, 200)
    ids = np.arange(8000)
    asked = ids[::400]
    for same, low in ((True, LEAST), (False, 0)):
        queries = Queries(asked, labels[asked], matrix[asked], np.full((20, 1), low), np.full((20, 1), MOST))
        tree, best = RTree(ids, labels, matrix), Best(queries, 5)
        tree.search(queries, matrix[asked], best, same)
        assert tree.scored <= 20 * 8000 * 0.1
        for n, q in enumerate(asked):
            scores = matrix @ matrix[q]
            fit = [i for i in np.lexsort((ids, -scores)) if i != q and (labels[i] == labels[q]) == same and scores[i] >= low]
            assert best.ids[n, 0][: best.n[n, 0]].tolist() == fit[:5]


def test_kinds():
    small, middle, large = np.array([[2.0**20]]), np.array([[2.0**28]]), np.array([[2.0**31]])
    assert kind_for(small, small) is np.float64 and kind_for(middle, small) is np.int64 and kind_for(large, small) is object
    assert as_kind(large, object)[0, 0] ** 2 * 4 == 2**64 and kind_for(small * 16, small) is np.float64
    assert kind_for(np.zeros((0, 3))) is np.float64


def test_query_equals_sql(spark):
    rows = sorted(map(tuple, op12_hard_negatives(spark, SF_DIR).collect()))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS FROM '{SF_DIR}/embeddings.parquet'")
        assert rows == sorted(con.sql(sql.HARD_NEGATIVES).fetchall())
