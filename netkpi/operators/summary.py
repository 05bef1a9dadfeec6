"""Before/after table: first day against last day, and the share of operator B."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netkpi.operators.kpis import Kpi

SliceTables = dict[str, DataFrame]  # day tables of the slices ALL, A and B


def before_after(
    tech: str,
    days: SliceTables,
    rows: Sequence[tuple[str, str, str | None]],
    kpis: Sequence[Kpi],
    shared_rows: Sequence[str],
    network_only_rows: Sequence[str],
    cells: DataFrame | None = None,
) -> DataFrame:
    """One line per summary row, numbered by ``position``.

    Each slice shows *its own* last day. The day tables are put under each other and
    folded into a single row, so nothing is joined; a slice without rows gives NULL.
    ``cells`` is the one-row result of ``cell_integrity``.
    """
    columns = {k.label: k.column for k in kpis}
    parts = [df.withColumn("slice", F.lit(s)) for s, df in days.items()]
    if cells is not None:
        parts.append(cells)
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    values = F.struct(*columns.values())

    def date_in(slice_name: str) -> Column:
        return F.when(F.col("slice") == slice_name, F.col("date"))

    folded = [
        F.min_by(values, date_in("ALL")).alias("before_all"),
        F.max_by(values, date_in("ALL")).alias("after_all"),
        F.max_by(values, date_in("A")).alias("after_a"),
        F.max_by(values, date_in("B")).alias("after_b"),
        F.max(date_in("ALL")).alias("after_date"),
    ]
    if cells is not None:
        folded += [F.max("cells_before").alias("cells_before"), F.max("cells_after").alias("cells_after")]
    line = stacked.agg(*folded)
    blank = F.lit(None).cast("double")

    def shown(position: int, section: str, label: str, kpi: str | None) -> Column:
        if kpi is None:
            before, after = F.col("cells_before").cast("double"), F.col("cells_after").cast("double")
            a = b = after
        else:
            before, after, a, b = (F.col(f"{w}.{columns[kpi]}") for w in ("before_all", "after_all", "after_a", "after_b"))
        if label in network_only_rows:
            a = b = blank
        share = F.try_divide(b, b + a) if label in shared_rows else blank
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(tech).alias("tech"),
            F.lit(section).alias("section"),
            F.lit(label).alias("kpi"),
            before.alias("before_all"),
            after.alias("after_all"),
            a.alias("after_a"),
            b.alias("after_b"),
            share.alias("share_b"),
            F.col("after_date").alias("after_date"),
        )

    lines = F.array(*[shown(i, *row) for i, row in enumerate(rows, start=1)])
    return line.select(F.inline(lines))
