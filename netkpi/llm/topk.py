"""Exact top-k search by inner product with an impact-ordered, score-at-a-time index.

Vectors are turned into integers. In the index of some rows a component is its distance from the
middle of its dimension. The posting segment of a dimension holds the rows that have a distance there, with it;
where nearly all have, it is a plain column. The quantised impact of a segment for a query is the
query's component times the largest distance, rounded up to a power of two. Each query takes the segments by
descending impact, and each adds its products to the scores of its rows.

The proof on which a row leaves: by the inequality of Cauchy and Schwarz, what the products to come can still add
to its score is the length of what is left of the query times the length of what is left of the row. Both
are kept while segments are processed. A row whose score plus this bound is below k scores that are certain
(leaders of this index, rescored exactly; what the task saw before; an earlier round of shards) is out, for this query,
and its postings are passed over from then on. Once few rows are possible, so that rescoring them costs little,
processing stops and they are rescored exactly with the integer vectors. If the segments are used up first, nothing is left of a row,
and its bound is its score. When that is depends on the data, never on a limit; the result is exact in any case.

How blocks of queries, shards and rounds go together is told in ``vector_blocks``: rows are dealt once, an index is made once per
block, and the k-th best score is handed on.

Defined cases: a vector that is null, or holds a null or a value that is not finite, takes no part,
nor does a row without id. Missing components at the end count as 0. Rows that repeat id and vector
count once; an id with several vectors asks with each and is found with each, but never by itself.
Ties go to the smaller id. Components of any size are exact (where products need more than 64 bits, rows are scored
in full with Python's integers); a score that is found but does not fit in 64 bits is an error. Fewer than k rows
give fewer ranks. Only id and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netkpi.llm.common import scratch, written
from netkpi.llm.vector_blocks import LEAST, MOST, Best, Queries, as_kind, best_rows, integer_rows, kind_for, query_blocks, shards_of

#: Rows are rescored once one in so many is possible; bounds are looked at after so many postings per possible row.
RESCORED, LOOK = 32, 3
#: Far more than the rounding of the lengths that are left, as a share of the whole lengths (squared).
_ROUNDING = 1e-9


class ImpactIndex:
    """Posting segments of some integer vectors."""

    def __init__(self, ids, matrix):
        import numpy as np

        self.ids, self.matrix = ids, matrix
        self.middle = np.rint(np.median(matrix, axis=0)).astype(matrix.dtype)
        apart = np.ascontiguousarray((matrix - self.middle).T).astype(float)
        self.squares = (apart * apart).sum(axis=0)
        #: Per dimension the largest distance, quantised to a power of two, and its segment: rows
        #: (None: every row, or nearly) and their distances.
        self.largest = np.exp2(np.frexp(np.abs(apart).max(axis=1, initial=0))[1]) * (apart != 0).any(axis=1)
        self.segments = []
        for x in apart:
            rows = np.flatnonzero(x)
            self.segments.append((rows, x[rows]) if 2 * len(rows) < len(x) else (None, x))
        #: Postings processed, and components of rows that were rescored.
        self.processed = self.rescored = 0

    def scores(self, rows, vector):
        self.rescored += len(rows) * self.matrix.shape[1]
        return self.matrix[rows] @ vector

    def search(self, query: int, own: int, vector, best: Best) -> None:
        """Add the best rows, other than those of the id ``own``, for a vector in the matrix's type."""
        import numpy as np

        rows = np.flatnonzero(self.ids != own)
        rows = self._possible(rows, vector, best.floor[query, 0], best.k)
        if not len(rows):
            return
        scores = self.scores(rows, vector)
        member = ((scores >= best.floor[query, 0]) | (best.floor[query, 0] == LEAST)).astype(bool)
        if member.any():
            best.add(query, 0, scores[member], self.ids[rows[member]])

    def _possible(self, rows, vector, certain, k: int):
        """Rows that may be among the k best, by what the segments of largest impact say."""
        import numpy as np

        n, asked = len(self.ids), vector.astype(float)
        few = max(n // RESCORED, 2 * k)
        impacts = np.abs(asked) * self.largest
        by_impact = [d for d in np.argsort(-impacts, kind="stable") if impacts[d]]
        # squared lengths of what is left of the query and of the rows; score of the rows
        of_query, of_row, score = float((asked[by_impact] ** 2).sum()), self.squares.copy(), np.full(n, asked @ self.middle.astype(float))
        slack = _ROUNDING * of_query, _ROUNDING * self.squares
        blur = _ROUNDING * float(np.abs(asked) @ np.abs(self.middle).astype(float)) if self.matrix.dtype != np.float64 else 0.0
        known, exact, since = np.zeros(n, bool), np.zeros(n, self.matrix.dtype), 0
        for nth, dim in enumerate(by_impact, 1):
            if len(rows) <= few:
                break
            x, (members, distances) = asked[dim], self.segments[dim]
            if members is None and 2 * len(rows) < n:  # postings of rows that are out are passed over
                members, distances = rows, distances[rows]
            if members is None:
                members = slice(None)
            score[members] += x * distances
            of_row[members] -= distances * distances
            of_query -= x * x
            self.processed += len(distances)
            since += len(distances)
            if since < LOOK * len(rows) and nth < len(by_impact):
                continue
            since, reach = 0, score[rows]
            leaders = rows[np.argpartition(-reach, 2 * k)[: 2 * k]]
            new = leaders[~known[leaders]]
            exact[new], known[new] = self.scores(new, vector), True
            certain = max(certain, np.sort(exact[leaders])[-k])
            reach += np.sqrt(np.maximum(of_row[rows] + slack[1][rows], 0) * max(of_query + slack[0], 0.0)) + blur
            rows = rows[reach >= certain]
        return rows


class FullIndex(ImpactIndex):
    """Rows with components so large that only Python's integers hold their products: all are scored."""

    def __init__(self, ids, matrix):
        self.ids, self.matrix, self.processed, self.rescored = ids, matrix, 0, 0

    def _possible(self, rows, vector, certain, k: int):
        return rows


def index_of(ids, matrix) -> ImpactIndex:
    return FullIndex(ids, matrix) if matrix.dtype == object else ImpactIndex(ids, matrix)


def _search(ids, labels, matrix, queries: Queries, best: Best) -> None:
    import numpy as np

    kind = kind_for(matrix, queries.vectors)
    dims = max(matrix.shape[1], queries.vectors.shape[1])
    matrix, vectors = (np.pad(as_kind(m, kind), ((0, 0), (0, dims - m.shape[1]))) for m in (matrix, queries.vectors))
    index = index_of(ids, matrix)
    for query in range(len(queries.ids)):
        index.search(query, queries.ids[query], vectors[query], best)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    factor: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` for the rows where ``is_query`` (of ``id``) holds."""
    import numpy as np

    spark = vectors.sparkSession
    folder = scratch(spark)
    rows = written(integer_rows(vectors, id_col, vector_col, factor), f"{folder}/rows")
    dims = F.coalesce(F.max(F.size("v")), F.lit(0))
    n_rows, n_queries, dims = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), dims).first()
    # by hash: each shard is like the whole table, so that a round's scores hold for the others
    dealt = rows.withColumn("first", F.xxhash64("id", "v"))
    shards, n_shards = shards_of(dealt, f"{folder}/shards", n_rows, ["first", "id"])
    found = [spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")]
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    for number, (ids, labels, matrix) in enumerate(query_blocks(rows.where(is_query), n_queries, dims)):
        asked = Queries(ids, labels, matrix, np.full((len(ids), 1), LEAST, np.int64), np.full((len(ids), 1), MOST, np.int64))
        best = best_rows(shards, n_shards, asked, k, _search, f"{folder}/block{number}")
        found.append(best.select("query_id", F.lit(0).alias("rank"), F.col("id").alias("vec_id"), "score"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*found[0].columns)
