"""Hard-negative mining by inner product, over STR-packed R-trees.

For each anchor the most similar rows of its label are its positives; for each positive the hardest
negatives are the best rows of other labels whose score lies in a window below the positive's score.

Rows are dealt by range of label and first components, and each task makes R-trees of them, a bounded
number of rows at a time. Packing is sort-tile-recursive: the rows of a tree are cut into slabs by label, each
slab is sorted by its widest coordinate and cut into slabs, as many as the remaining coordinates ask for, until a
slab fills one leaf; parents take neighbours together. A node knows its minimum bounding box and its least and
largest label. Per coordinate the box gives the interval of products with the anchor; their sums are
the least and the largest score inside. A best-first queue opens the box of the largest possible
score first, some boxes at a time and more as they go on. A box is pruned if its interval misses all windows of the anchor, if it is
strictly below the k-th best scores found so far, or if its labels are the wrong ones; the search ends when the first
box of the queue is below all of these. Rows of open leaves are scored exactly.

The positives of a block of anchors come from a first search (the window is everything), the
negatives from a second one, in which an anchor has one window per positive.
How blocks, shards and rounds go together is told in ``vector_blocks``.

Defined cases: rows with a null id, a null label, a null vector or a component that is null or not
finite take no part. Missing components at the end count as 0. Rows that repeat id, label and vector count once; an id with
several labels or vectors is several anchors and rows, but never a positive or negative of its own id.
Ties go to the smaller id. A positive without rows in its window has no negatives. Large components
are exact; a score that is found but does not fit in 64 bits is an error. An empty table gives no rows.
Only id, label and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netkpi.llm.common import scratch, written
from netkpi.llm.vector_blocks import LEAST, MOST, Best, Queries, as_kind, best_rows, integer_rows, kind_for, query_blocks, shards_of

#: Rows per leaf and children per node.
LEAF_ROWS, FANOUT = 64, 16


def _label_slabs(labels, rows) -> list:
    """Rows in slabs of one label; labels of few rows share a slab."""
    import numpy as np

    rows = rows[np.argsort(labels[rows], kind="stable")]
    changes = np.flatnonzero(np.diff(labels[rows])) + 1
    cuts, last = [], 0
    for at in changes:
        if at - last >= LEAF_ROWS:
            cuts.append(at)
            last = at
    return np.split(rows, cuts)


def str_leaves(labels, matrix) -> list:
    """The rows of each leaf, packed sort-tile-recursively."""
    import numpy as np

    dims = matrix.shape[1]
    leaves, open_slabs = [], [(slab, dims) for slab in reversed(_label_slabs(labels, np.arange(len(labels))))]
    while open_slabs:
        rows, left = open_slabs.pop()
        if len(rows) <= LEAF_ROWS or not dims:
            leaves += [rows[at : at + LEAF_ROWS] for at in range(0, len(rows), LEAF_ROWS)]
            continue
        n_leaves = -(-len(rows) // LEAF_ROWS)
        n_slabs = max(2, int(np.ceil(n_leaves ** (1 / left))))
        inside = matrix[rows]
        widest = int(np.argmax(inside.max(axis=0) - inside.min(axis=0)))
        rows = rows[np.argsort(inside[:, widest], kind="stable")]
        per_slab = -(-n_leaves // n_slabs) * LEAF_ROWS
        slabs = [rows[at : at + per_slab] for at in range(0, len(rows), per_slab)]
        open_slabs += [(slab, max(left - 1, 1)) for slab in reversed(slabs)]
    return leaves


def _reaches(scores, floor):
    """Whether scores are not below a floor; the least one is no floor, also for scores that do not fit in 64 bits."""
    return (scores >= floor) | (floor == LEAST)


def _stays(scores, high):
    return (scores <= high) | (high == MOST)


class RTree:
    """Boxes over some rows, level by level from the leaves up."""

    def __init__(self, ids, labels, matrix):
        import numpy as np

        leaves = str_leaves(labels, matrix)
        order = np.concatenate(leaves)
        self.ids, self.labels, self.matrix = ids[order], labels[order], matrix[order]
        #: Of each level: first child (or row) of each node and one more, box, least and largest label.
        self.levels: list[tuple[Any, ...]] = []
        starts = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        below = (self.matrix, self.matrix, self.labels, self.labels)
        while True:
            low, high, first, last = (
                f.reduceat(x, starts[:-1], axis=0) for f, x in zip((np.minimum, np.maximum) * 2, below, strict=True)
            )
            self.levels.append((starts, low, high, first, last))
            if len(low) <= FANOUT:
                break
            below = low, high, first, last
            starts = np.append(np.arange(0, len(low), FANOUT), len(low))
        self.scored = 0

    def intervals(self, level: int, nodes, plus, minus):
        """Least and largest score in each node, for vectors given by their positive and negative parts."""
        _, low, high, _, _ = self.levels[level]
        low, high = low[nodes].T, high[nodes].T
        return plus @ low + minus @ high, plus @ high + minus @ low

    def right_labels(self, level: int, nodes, labels, same: bool):
        """Whether a node may hold rows of the label or, if not ``same``, of another one."""
        _, _, _, first, last = self.levels[level]
        first, last = first[nodes], last[nodes]
        return (first <= labels) & (labels <= last) if same else (first != labels) | (last != labels)

    def search(self, queries: Queries, vectors, best: Best, same: bool) -> None:
        """Add the rows of the tree to the best ones of all queries; ``vectors`` are theirs in the type of the matrix."""
        import numpy as np

        top = len(self.levels) - 1
        every = np.arange(len(self.levels[top][1]))
        plus, minus = np.maximum(vectors, 0), np.minimum(vectors, 0)
        # the roots of all queries at once: most queries of other places and labels end here
        least, most = self.intervals(top, every, plus, minus)
        open_roots = (
            _reaches(most, best.floor.min(axis=1)[:, None])
            & _stays(least, best.high.max(axis=1)[:, None])
            & self.right_labels(top, every[None, :], queries.labels[:, None], same)
        )
        for query in np.flatnonzero(open_roots.any(axis=1)):
            roots = every[open_roots[query].astype(bool)]
            queue = [(-m, top, int(n)) for m, n in zip(most[query, roots], roots, strict=True)]
            self._search_one(queries, query, vectors[query], plus[query], minus[query], queue, best, same)

    def _search_one(self, queries: Queries, query: int, vector, plus, minus, queue: list, best: Best, same: bool) -> None:
        import numpy as np

        heapq.heapify(queue)
        floor, high, label, own = best.floor[query], best.high[query], queries.labels[query], queries.ids[query]
        at_once = 1
        while queue:
            limit = floor[floor <= high].min(initial=MOST)  # windows without scores are over
            opened: dict[int, list[int]] = {}
            for _ in range(min(at_once, len(queue))):
                if not _reaches(-queue[0][0], limit):
                    queue.clear()  # best first: all others are below, too
                    break
                _, level, node = heapq.heappop(queue)
                opened.setdefault(level, []).append(node)
            at_once *= 2
            for level, nodes in opened.items():
                starts = self.levels[level][0]
                inside = np.concatenate([np.arange(starts[n], starts[n + 1]) for n in nodes])
                if level:
                    least, most = self.intervals(level - 1, inside, plus, minus)
                    useful = _reaches(most[:, None], floor) & _stays(least[:, None], high)
                    useful = useful.astype(bool).any(axis=1) & self.right_labels(level - 1, inside, label, same)
                    for m, n in zip(most[useful], inside[useful], strict=True):
                        heapq.heappush(queue, (-m, level - 1, int(n)))
                    continue
                inside = inside[((self.labels[inside] == label) == same) & (self.ids[inside] != own)]
                self.scored += len(inside)
                scores = self.matrix[inside] @ vector
                for window in range(len(floor)):
                    member = (_reaches(scores, floor[window]) & _stays(scores, high[window])).astype(bool)
                    if member.any():
                        best.add(query, window, scores[member], self.ids[inside[member]])


def _searched(same: bool):
    def search(ids, labels, matrix, queries: Queries, best: Best) -> None:
        kind = kind_for(matrix, queries.vectors)
        dims = max(matrix.shape[1], queries.vectors.shape[1])
        matrix, vectors = (_widened(as_kind(m, kind), dims) for m in (matrix, queries.vectors))
        RTree(ids, labels, matrix).search(queries, vectors, best, same)

    return search


def _widened(matrix, dims: int):
    import numpy as np

    return np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1])))


def _windows(positives, n_queries: int, k: int, percents: tuple[int, int]):
    """Least and largest score per query and positive; a window that is none has no scores."""
    import numpy as np

    low, high = np.full((n_queries, k), MOST, np.int64), np.full((n_queries, k), LEAST, np.int64)
    for query, window, score in zip(*(c.to_pylist() for c in positives), strict=True):
        a, b = -(-percents[0] * score // 100), percents[1] * score // 100
        if a <= b and a <= MOST and b >= LEAST:
            low[query, window], high[query, window] = max(a, LEAST), min(b, MOST)
    return low, high


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 5,
    percents: tuple[int, int] = (80, 100),
    factor: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` is a condition on ``id``; ``label`` is made of the table's columns. A negative's score is between
    ``percents`` of its positive's.
    """
    import numpy as np

    spark = vectors.sparkSession
    folder = scratch(spark)
    rows = written(integer_rows(vectors, id_col, vector_col, factor, label), f"{folder}/rows")
    dims = F.coalesce(F.max(F.size("v")), F.lit(0))
    n_rows, n_anchors, dims = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1)), dims).first()
    order = ["label", "first", "id"]
    tiled = rows.withColumn("first", F.get("v", F.lit(0)))
    shards, n_shards = shards_of(tiled, f"{folder}/shards", n_rows, order)
    found = [
        spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    ]
    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    by_rank = Window.partitionBy("query", "window").orderBy(F.col("score").desc(), "id")
    for number, (ids, labels, matrix) in enumerate(query_blocks(rows.where(is_anchor), n_anchors, dims)):
        everything = (np.full((len(ids), 1), LEAST, np.int64), np.full((len(ids), 1), MOST, np.int64))
        asked = Queries(ids, labels, matrix, *everything)
        path = f"{folder}/block{number}"
        near = best_rows(shards, n_shards, asked, positives, _searched(True), f"{path}/positives")
        # the number of a positive is the window of its negatives
        near = written(near.withColumn("window", F.row_number().over(by_score) - 1), f"{path}/numbered")
        known = near.select("query", "window", "score").toArrow()
        asked.low, asked.high = _windows(known.columns, len(ids), positives, percents)
        far = best_rows(shards, n_shards, asked, negatives, _searched(False), f"{path}/negatives")
        pairs = far.withColumn("rank", F.row_number().over(by_rank)).select(
            "query", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
        )
        named = near.select(
            "query", "window", F.col("query_id").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        )
        found.append(named.join(pairs, ["query", "window"]).select(*found[0].columns))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
