"""Mixing sources to target weights by Pareto order sampling.

The words of all sources are shared out by weight; a target stops at ``max_copies`` times its
source's words and the excess goes to the other sources. The ratio target / words is the expected
number of copies of a source's words: its whole part is taken of each document for certain, and of one more
copy a share r. The inclusion probability p of a document grows with its size n:
p = r + min(r, 1 - r) * (f(n) - m), where f(n) = n / (n + half_size), in thousandths, and m is the mean of f over the
source's words. So p lies between 0 and 1, and the expected words are still the target. For the copy documents are
ranked by Q = (u / (1 - u)) / (p / (1 - p)), with u from a hash of the row, and taken in this order. The size
of the sample is fixed in words: it ends with the last document that still fits into what is left
of the target, and the document outside of the sample whose size is nearest to the gap closes it,
if that brings the source nearer. These two ends move inclusions by about one document per source, so
in a source of a few documents they are only near p.

Only built-in functions. No source is ordered in one task: words are summed per source and slice
of Q (map-side), the slice in which the sample ends is found in those sums, and only the documents
of that slice are ordered.

Defined cases: a null text has size 0. A null source is a source of its own, the last one. Rows
that repeat id and text are one unit: taken or left together. Without words all targets are 0 and
nothing is taken. The input's columns travel in a struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netkpi.llm.common import WORD, scratch, written

#: Slices of Q per source; the cut is looked for in one of them.
SLICES = 4096

#: Words of a document whose probability leans half way; longer ones are favoured over shorter ones.
HALF_SIZE = 256

#: Keeps probabilities off 0 and 1, where odds are no numbers.
_EDGE = 2.0**-40


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(id_col: str, text_col: str, seed: str) -> Column:
    """52 bits of a hash of the row."""
    parts = F.concat_ws(
        "|",
        F.lit(seed),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.md5(F.coalesce(F.col(text_col), F.lit(""))),
    )
    return F.conv(F.substring(F.md5(parts), 1, 13), 16, 10).cast("long")


def _length(half_size: int) -> Column:
    """0 to 999, growing with ``size``. A whole number, so that its sums are the same in any order."""
    return F.expr(f"size * 1000L div (size + {half_size})")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_copies: int) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows with ``source`` and ``size``.

    The only windows without partitions run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("nth") % len(weights) + 1)
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("nth", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    )
    # Sources reach their cap in the order of cap / weight. The level (target per weight) after the
    # first ones are capped holds if the next one stays below its own cap.
    before = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.first(
        F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")), ignorenulls=True
    ).over(Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        sources.withColumn("level", left / weight_left)
        .withColumn("level", F.coalesce(level, F.lit(0.0)))
        .select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_copies: int = 3,
    seed: str = "mix",
    half_size: int = HALF_SIZE,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``row`` (struct of the input's columns), ``size``, ``source_size``, ``target``, ``copies``, ``chance`` (of one more
    than the certain copies; 0 if there is none to draw)."""
    spark = docs.sparkSession
    sized = docs.select(
        F.struct("*").alias("row"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        _uniform(id_col, text_col, seed).alias("h"),
    )
    folder = scratch(spark)
    slim = written(sized.select("source", "size", "h"), f"{folder}/sizes")
    length = _length(half_size)
    sums = slim.groupBy("source").agg(F.sum("size").alias("size"), F.sum(F.col("size") * length).alias("lengths"))
    sums = written(sums, f"{folder}/sources")
    means = sums.select(F.col("source").alias("mean_of"), F.try_divide("lengths", "size").alias("middle"))
    targets = source_targets(sums, weights, max_copies)
    targets = targets.join(means, F.col("source").eqNullSafe(F.col("mean_of"))).drop("mean_of")
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    plan = (
        targets.withColumn("whole", F.least(F.floor(ratio), F.lit(max_copies)).cast("long"))
        .withColumn("part", ratio - F.col("whole"))
        .withColumn("lean", F.least(F.col("part"), 1 - F.col("part")))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    plan = written(plan, f"{folder}/plan").withColumnRenamed("source", "of")
    u = (F.col("h") + F.lit(0.5)) / F.lit(float(2**52))
    chance = F.col("part") + F.col("lean") * ((length - F.col("middle")) / F.lit(1000.0))
    chance = F.when(F.col("part") > 0, F.greatest(F.least(chance, F.lit(1 - _EDGE)), F.lit(_EDGE)))
    q = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    same = F.col("source").eqNullSafe(F.col("of"))
    ranked = (
        slim.join(plan.where("part > 0").select("of", "part", "lean", "middle", "rest"), same)
        .withColumn("chance", chance)
        .withColumn("q", q)
        .withColumn("slice", F.floor(F.col("q") / (1 + F.col("q")) * SLICES))
    )
    by_slice = ranked.groupBy("of", "slice", "rest").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("of").orderBy("slice")
    last_slice = (
        by_slice.withColumn("upto", F.sum("words").over(upto))
        .where(F.col("upto") > F.col("rest"))
        .groupBy("of")
        .agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
        .select(F.col("of").alias("cut_of"), F.col("cut.slice").alias("cut_slice"), "cut.before")
    )
    last_slice = written(last_slice, f"{folder}/last_slice")
    inside = (
        ranked.join(last_slice, F.col("of").eqNullSafe(F.col("cut_of")) & (F.col("slice") == F.col("cut_slice")))
        .groupBy("of", "rest", "before", "q", "h")
        .agg(F.sum("size").alias("words"))
    )
    order = Window.partitionBy("of").orderBy("q", "h")
    cut = (
        inside.withColumn("upto", F.col("before") + F.sum("words").over(order))
        .where(F.col("upto") <= F.col("rest"))
        .groupBy("of")
        .agg(F.max(F.struct("q", "h", "upto")).alias("end"))
        .select(F.col("of").alias("end_of"), "end")
    )
    ends = (
        last_slice.join(cut, F.col("cut_of").eqNullSafe(F.col("end_of")), "left")
        .select("cut_of", "cut_slice", F.col("end.q").alias("cut_q"), F.col("end.h").alias("cut_h"),
                F.coalesce("end.upto", "before").alias("filled"))
    )
    ends = written(ends, f"{folder}/ends")
    taken = F.coalesce(
        (F.col("slice") < F.col("cut_slice"))
        | (F.col("slice") == F.col("cut_slice"))
        & (F.struct("q", "h") <= F.struct(F.col("cut_q").alias("q"), F.col("cut_h").alias("h")))
        & F.col("cut_h").isNotNull(),
        F.lit(True),  # no slice ends the sample: all of the source
    )
    gap = F.col("rest") - F.col("filled")
    closing = (
        ranked.join(ends, F.col("of").eqNullSafe(F.col("cut_of")))
        .where(~taken)
        .groupBy("of", "q", "h", gap.alias("gap"))
        .agg(F.sum("size").alias("words"))
        .where(F.abs(F.col("words") - F.col("gap")) < F.col("gap"))
        .groupBy("of")
        .agg(F.min(F.struct(F.abs(F.col("words") - F.col("gap")).alias("off"), "q", "h")).alias("one"))
        .select(F.col("of").alias("one_of"), F.col("one.h").alias("one_h"))
    )
    full = (
        plan.join(ends, F.col("of").eqNullSafe(F.col("cut_of")), "left")
        .join(closing, F.col("of").eqNullSafe(F.col("one_of")), "left")
        .drop("cut_of", "one_of")
    )
    full = written(full, f"{folder}/cuts")
    more = F.when(F.col("part") > 0, (taken | F.coalesce(F.col("h") == F.col("one_h"), F.lit(False))).cast("long"))
    return (
        sized.join(full, same, "left")
        .withColumn("chance", chance)
        .withColumn("q", q)
        .withColumn("slice", F.floor(F.col("q") / (1 + F.col("q")) * SLICES))
        .select("row", "size", "source_size", "target",
                (F.col("whole") + F.coalesce(more, F.lit(0))).alias("copies"),
                F.coalesce("chance", F.lit(0.0)).alias("chance"))
    )
