"""First and last hour of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hour_range(rows: DataFrame) -> DataFrame:
    """One row: the first and the last hour."""
    return rows.agg(F.min("hour_ts").alias("first_hour"), F.max("hour_ts").alias("last_hour"))


def _ends(hours: DataFrame) -> tuple[Column, Column]:
    """First and last hour of ``hours`` as values. Both are parts of one scalar subquery, which Spark runs once however
    often it is used."""
    both = hour_range(hours).select(F.struct("first_hour", "last_hour")).scalar()
    return both["first_hour"], both["last_hour"]


def first_last_rows(rows: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Rows of the first and of the last hour, marked in column ``moment``.

    The two hours are found first, from one column of ``rows`` or, if given, of the smaller table ``hours``, which has
    the same hours; as values in a filter they reach the scan of ``rows``, and only rows of these hours go on.
    """
    first, last = _ends(rows if hours is None else hours)
    moment = F.when(F.col("hour_ts") == first, "first").otherwise("last")
    return rows.filter((F.col("hour_ts") == first) | (F.col("hour_ts") == last)).withColumn("moment", moment)


def cell_integrity(cells: DataFrame, cell_column: str = "cell_name", hours: DataFrame | None = None) -> DataFrame:
    """One row: distinct cell names in the first and in the last hour (missing names do not count).

    Only the names of two hours are shuffled. ``hours`` as in :func:`first_last_rows`.
    """
    names = first_last_rows(cells.select("hour_ts", cell_column), hours).filter(F.col(cell_column).isNotNull())
    counts = names.select("moment", cell_column).distinct()
    # a single hour is the first and the last one
    first, last = _ends(cells if hours is None else hours)
    return counts.agg(
        F.count_if(F.col("moment") == "first").alias("cells_before"),
        F.count_if((F.col("moment") == "last") | (first == last)).alias("cells_after"),
    )


def cell_integrity_of_tables(hours: DataFrame, cell_hours: DataFrame) -> DataFrame:
    """The same counts from written tables of the grains hour and cell_hour, which have one row per hour and per named
    cell. Of ``cell_hours`` only the folders (``day``) of two days are read."""
    moment = F.struct("date", "hour")
    ends = hours.agg(F.min(moment).alias("first"), F.max(moment).alias("last"))
    found = []
    for end, name in (("first", "cells_before"), ("last", "cells_after")):
        date, hour = (ends.select(f"{end}.{part}").scalar() for part in ("date", "hour"))
        rows = cell_hours.where((F.col("day") == date.cast("date")) & (F.col("hour") == hour))
        found.append(rows.select(F.lit(name).alias("name"), F.col("cell_name").alias("cell")))
    both = found[0].unionByName(found[1])
    return both.agg(*[F.count_if(F.col("name") == n).alias(n) for n in ("cells_before", "cells_after")])
