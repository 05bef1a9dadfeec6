"""Searches for the best rows of integer vectors: blocks of queries against all rows, by shards.

Rows are dealt to shards by range and written once. Queries come in blocks of a bounded number of
components; a block is broadcast and each task takes its rows as a stream, a bounded number at a
time, makes an index of them and searches it for all queries of the block. Rows never move again and an
index is made once per block. What a task found before bounds what it still looks for.

The shards of a block are searched in rounds, each about eight times as large as the one before. The
k-th best score after a round is the least score that a row of later rounds must reach. So a query
gets some multiple of k rows per round from all tasks together, however many there are: what is shuffled
grows with the queries, not with queries times tasks.

Numbers are exact: floating point while sums stay below 2^53, else 64-bit integers while they stay
below 2^62, else Python's integers. A score that is found must fit in 64 bits; another one is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netkpi.llm.common import workers_import, written

#: Components per broadcast block of queries (8 bytes each), rows per index, rows per shard.
BLOCK_NUMBERS, INDEX_ROWS, SHARD_ROWS = 1 << 20, 16_384, 65_536
#: Shards of a round: those whose number is divisible by the first, then by the second, then all others.
ROUND_STEPS = (64, 8, 1)
LEAST, MOST = -(2**63), 2**63 - 1


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, factor: int, label: Column | None = None) -> DataFrame:
    """``id``, ``label`` and ``v`` (floor(factor * x), whole numbers as double), one row per different row.

    Rows without id or label, or with a vector that is null or holds a null or a value that is not finite, are left out.
    """
    big = float(2**53)  # from here on every double is a whole number
    scaled = F.transform(F.col(vector_col), lambda c: factor * c.cast("double"))
    finite = F.forall(F.col("v"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform("v", lambda c: F.when(F.abs(c) < big, F.floor(c).cast("double")).otherwise(c))
    return (
        vectors.select(
            F.col(id_col).cast("long").alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"), scaled.alias("v")
        )
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
        .select("id", "label", whole.alias("v"))
        .dropDuplicates(["id", "label", "v"])
    )


def kind_for(*matrices) -> Any:
    """A type in which sums of products of components of two of the matrices are exact, differences of components included."""
    import numpy as np

    largest = max((float(np.abs(m).max()) for m in matrices if m.size), default=0.0)
    dims = max((m.shape[1] for m in matrices), default=0)
    most = 4 * largest * largest * max(dims, 1)
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def as_kind(matrix, kind):
    """Whole numbers held as double, as another type, exactly."""
    import numpy as np

    if kind is not object:
        return matrix.astype(kind)
    out = np.empty(matrix.shape, object)
    out.ravel()[:] = [int(x) for x in matrix.ravel()]
    return out


def matrix_of(column, dims: int | None = None):
    """Vectors (an Arrow list column) as rows of a matrix, filled up with 0."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    dims = max(dims or 0, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass
class Queries:
    """A block of queries; each has the same number of windows of scores, in which it wants its k best rows."""

    ids: Any
    labels: Any
    vectors: Any
    #: Least and largest score per query and window, and the score that a row must reach to be among the k best.
    low: Any
    high: Any
    reached: Any = field(default=None)


class Best:
    """The k best rows so far per query and window: higher scores first, ties by smaller id."""

    def __init__(self, queries: Queries, k: int):
        import numpy as np

        self.k, self.n = k, np.zeros(queries.low.shape, np.int64)
        self.scores = np.full((*queries.low.shape, k), LEAST, np.int64)
        self.ids = np.zeros((*queries.low.shape, k), np.int64)
        #: The least score that still counts; a row with exactly this score may.
        self.floor = queries.low.copy() if queries.reached is None else np.maximum(queries.low, queries.reached)
        self.high = queries.high

    def add(self, query: int, window: int, scores, ids) -> None:
        """Rows that reach the floor of the window."""
        import numpy as np

        if any(not LEAST <= int(s) <= MOST for s in (scores.min(), scores.max())):
            raise ValueError("a score does not fit in 64 bits")
        n = self.n[query, window]
        scores = np.concatenate([self.scores[query, window, :n], scores.astype(np.int64)])
        ids = np.concatenate([self.ids[query, window, :n], ids])
        # descending without negation, which the least number does not have
        top = np.lexsort((ids, ~scores))[: self.k]
        n = self.n[query, window] = len(top)
        self.scores[query, window, :n], self.ids[query, window, :n] = scores[top], ids[top]
        if n == self.k:
            self.floor[query, window] = max(self.floor[query, window], scores[top[-1]])


Search = Callable[[Any, Any, Any, Queries, Best], None]
_FOUND = "query int, query_id long, window int, score long, id long"


def shards_of(rows: DataFrame, path: str, n_rows: int, order: list[str]) -> tuple[DataFrame, int]:
    """The rows with ``shard``, written by range of ``order``; and the number of shards."""
    spark = rows.sparkSession
    n = max(-(-n_rows // SHARD_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n_rows // 1024)), 1)
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    return written(dealt, path), n


def _rounds(n_shards: int) -> list[Column]:
    steps = [s for s in ROUND_STEPS if s == 1 or n_shards >= 2 * s]
    found, before = [], F.lit(True)
    for step in steps:
        mine = F.col("shard") % step == 0
        found.append(before & mine)
        before = before & ~mine
    return found


def query_blocks(queries: DataFrame, n_queries: int, dims: int) -> Iterator[tuple[Any, Any, Any]]:
    """Ids, labels and vectors of the queries (``id``, ``label``, ``v``), a block of a bounded size at a time."""
    import numpy as np

    n_blocks = -(-n_queries * max(dims, 1) * 2 // BLOCK_NUMBERS)  # half full on average
    block = F.pmod(F.xxhash64("id", "label", "v"), F.lit(n_blocks))
    for number in range(n_blocks):
        table = queries.where(block == number).select("id", "label", "v").orderBy("id", "label", "v").toArrow().combine_chunks()
        if table.num_rows:
            ids, labels = (table.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            yield ids, labels, matrix_of(table.column(2).combine_chunks(), dims)


def best_rows(rows: DataFrame, n_shards: int, queries: Queries, k: int, search: Search, path: str) -> DataFrame:
    """``query`` (number in the block), ``query_id``, ``window``, ``score``, ``id``: the k best rows of a block, in all shards."""
    import numpy as np

    spark = rows.sparkSession
    workers_import(spark)
    order = Window.partitionBy("query", "window").orderBy(F.col("score").desc(), "id", "nth")
    best = None
    rounds = _rounds(n_shards)
    for number, mine in enumerate(rounds):
        sent = spark.sparkContext.broadcast(queries)

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            asked = sent.value
            found = Best(asked, k)

            def searched(tables: list) -> None:
                table = pa.Table.from_batches(tables).combine_chunks()
                ids, labels = (table.column(i).to_numpy().astype(np.int64) for i in (0, 1))
                search(ids, labels, matrix_of(table.column(2).combine_chunks(), asked.vectors.shape[1]), asked, found)

            held, n = [], 0
            for batch in batches:
                while batch.num_rows:
                    held.append(batch.slice(0, INDEX_ROWS - n))
                    batch, n = batch.slice(INDEX_ROWS - n), n + held[-1].num_rows
                    if n == INDEX_ROWS:
                        searched(held)
                        held, n = [], 0
            if held:
                searched(held)
            query, window, nth = np.nonzero(np.arange(k) < found.n[:, :, None])
            for at in range(0, len(query), 65_536):
                q, w, i = (x[at : at + 65_536] for x in (query, window, nth))
                columns = [q.astype(np.int32), asked.ids[q], w.astype(np.int32), found.scores[q, w, i], found.ids[q, w, i]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "query_id", "window", "score", "id"])

        found = rows.where(mine).select("id", "label", "v").mapInArrow(run, _FOUND)
        if best is not None:
            found = found.unionByName(best)
        # rows that repeat an id with other vectors may agree in all columns: each is a row of its own
        ranked = found.withColumn("nth", F.monotonically_increasing_id()).withColumn("rank", F.row_number().over(order))
        best = written(ranked.where(F.col("rank") <= k).drop("rank", "nth"), f"{path}/round{number}")
        sent.unpersist()
        if number + 1 < len(rounds):
            full = best.groupBy("query", "window").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
            table = full.select("query", "window", "least").toArrow()
            queries.reached = np.full(queries.low.shape, LEAST, np.int64)
            queries.reached[table.column(0).to_numpy(), table.column(1).to_numpy()] = table.column(2).to_numpy()
    queries.reached = None
    return best
