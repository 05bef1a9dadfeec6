"""Inner join of reports on hour and cell, and checks of its keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netkpi.operators.measures import Measures

_MISSING = "_missing"

#: Words of 64 bits in a key filter. Whatever the number of keys, it has no more rows of two numbers than that: 16 MB to broadcast,
#: some 50 MB in memory. Up to some 7 million distinct keys fewer than one row in 20 that has no partner passes; the more keys there are
#: beyond, the more rows pass.
FILTER_WORDS = 2**20


def _place(keys: Sequence[str], words: int) -> tuple[Column, Column]:
    """The word of a key in a filter, and the three bits it sets there. Missing values count as equal."""
    # xxhash64 passes over missing values, so these are marked
    h = F.xxhash64(*keys, *[F.isnull(k) for k in keys])
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftright(h, n).bitwiseAND(63).cast("int")) for n in (40, 46, 52)]
    return F.pmod(h, F.lit(words)), reduce(lambda a, b: a.bitwiseOR(b), bits)


def shared_keys(sides: Sequence[DataFrame], keys: Sequence[str], words: int = FILTER_WORDS) -> DataFrame:
    """A Bloom filter of the keys that all sides have: ``_word``, ``_bits``, at most ``words`` rows.

    Each side is read for its keys alone and folded to words within its tasks before anything is shuffled. A key that
    all sides have is never missing from the filter; others may seem to be there.
    """
    parts = []
    for df in sides:
        word, bits = _place(keys, words)
        parts.append(df.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits")))
    words_of_all = reduce(DataFrame.unionAll, parts).groupBy("_word")
    in_all = words_of_all.agg(F.bit_and("_bits").alias("_bits"), F.count("*").alias("_sides"))
    return in_all.where((F.col("_sides") == len(sides)) & (F.col("_bits") != 0)).select("_word", "_bits")


def with_shared_key(rows: DataFrame, found: DataFrame, keys: Sequence[str], words: int = FILTER_WORDS) -> DataFrame:
    """Rows whose key may be in the filter ``found`` of :func:`shared_keys`; no other row has a partner on every side."""
    word, bits = _place(keys, words)
    marked = rows.withColumns({"_key_word": word, "_key_bits": bits})
    has_bits = F.col("_bits").bitwiseAND(F.col("_key_bits")) == F.col("_key_bits")
    kept = marked.join(F.broadcast(found), (F.col("_key_word") == F.col("_word")) & has_bits, "left_semi")
    return kept.drop("_key_word", "_key_bits")


def _collapsed(rows: DataFrame, measures: Measures, keys: Sequence[str], rows_column: str) -> DataFrame:
    """One partial per key. Missing keys become '' plus a bit in ``_missing``, so that plain
    equality on the result is null-safe equality on the input."""
    bits = " + ".join(f"CAST({k} IS NULL AS INT) * {2**i}" for i, k in enumerate(keys))
    marked = rows.withColumn(_MISSING, F.expr(bits)).withColumns({k: F.coalesce(k, F.lit("")) for k in keys})
    return marked.groupBy("hour_ts", *keys, _MISSING).agg(*measures.of_rows(), F.count("*").alias(rows_column))


def join_reports(
    sides: Sequence[tuple[DataFrame, Measures]], keys: Sequence[str], drop_unmatched: bool = False, words: int = FILTER_WORDS
) -> DataFrame:
    """Inner join on hour and keys, where a missing key matches a missing key.

    The result has one partial per hour and key, and ``joined_rows``: how many rows a
    row-by-row join has there. Each side is summed up per key *before* the join and its
    partial scaled by the row counts of the other sides. So a key that is repeated on
    several sides (say, all cells with an unreadable name) never multiplies out, hot keys
    are combined on the map side, and the join reuses the partitioning of the sums: one
    shuffle per report, none for the join.

    With ``drop_unmatched``, most rows whose hour and keys are not in all reports are left out before the sums, so they
    are not shuffled. The result is the same. The keys of all reports are read once more for it, so it pays for
    column files of reports that differ much, not for reports that have the same cells and hours.
    """
    if drop_unmatched:
        names = ["hour_ts", *keys]
        found = shared_keys([df for df, _ in sides], names, words)
        sides = [(with_shared_key(df, found, names, words), m) for df, m in sides]
    counts = [f"_rows_{i}" for i in range(len(sides))]
    # Products of row counts are made as DOUBLE: millions of rows without a name on each side are
    # beyond a BIGINT.
    collapsed = [_collapsed(df, m, keys, n) for (df, m), n in zip(sides, counts, strict=True)]
    joined = reduce(lambda a, b: a.join(b, ["hour_ts", *keys, _MISSING]), collapsed)

    restored = [f"CASE WHEN {_MISSING} & {2**i} = 0 THEN {k} END AS {k}" for i, k in enumerate(keys)]
    values = []
    for i, (_, measures) in enumerate(sides):
        others = " * ".join(f"CAST({n} AS DOUBLE)" for j, n in enumerate(counts) if j != i) or "1"
        values += measures.scaled(f"({others})")
    rows = " * ".join(f"CAST({n} AS DOUBLE)" for n in counts)
    return joined.selectExpr("hour_ts", *restored, *values, f"{rows} AS joined_rows")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once in an hour of a report, with their number of rows.

    Such rows count several times in the joined report: repeated exports, or rows that are
    closer together than an hour.
    """
    return rows.groupBy("hour_ts", *keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
