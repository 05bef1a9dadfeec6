"""The four grains of a report: day, cell, hour and cell-hour."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netkpi.functions.times import hour_text

# Group keys per technology. The cell-hour grain leaves out the site, so cells
# of the same name fall together there.
GRAINS: dict[str, dict[str, tuple[str, ...]]] = {
    "lte": {
        "day": ("date",),
        "cell": ("date", "ne_name", "cell_name"),
        "hour": ("date", "hour"),
        "cell_hour": ("date", "hour", "cell_name"),
    },
    "umts": {
        "day": ("date",),
        "cell": ("date", "site", "cell", "cell_id"),
        "hour": ("date", "hour"),
        "cell_hour": ("date", "hour", "cell", "cell_id"),
    },
}

ALL_KEYS = {"lte": ("date", "hour", "ne_name", "cell_name"), "umts": ("date", "hour", "site", "cell", "cell_id")}


def _all_present(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _with_time(rows: DataFrame) -> DataFrame:
    """Date and hour as small binary keys; :func:`text_times` makes text of them."""
    return rows.withColumns({"date": F.to_date("hour_ts"), "hour": F.hour("hour_ts")})


def text_times(groups: DataFrame) -> DataFrame:
    """Date and hour as text. Done last: groups that are joined must still have the keys
    they were partitioned by, or they are shuffled once more."""
    texts = {"date": F.col("date").cast("string")}
    if "hour" in groups.columns:
        texts["hour"] = hour_text(F.col("hour"))
    return groups.withColumns(texts)


def by_grain(
    rows: DataFrame, aggregates: Sequence[Column], tech: str, grain: str, more: Sequence[str] = ()
) -> DataFrame:
    """Group by the keys of one grain (and ``more`` keys); rows that lack a key of the grain are left out."""
    keys = GRAINS[tech][grain]
    return _with_time(rows).filter(_all_present(keys)).groupBy(*more, *keys).agg(*aggregates)


def days_of(hours: DataFrame, aggregates: Sequence[Column], more: Sequence[str] = ()) -> DataFrame:
    """The day grain from the groups of the hour grain: there are 24 of these per day, not all cells."""
    return hours.groupBy(*more, "date").agg(*aggregates)


def hours_of(hours: DataFrame) -> DataFrame:
    """``hour_ts`` of the groups of the hour grain, one row each."""
    hour_ts = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour"))
    return hours.select(hour_ts.alias("hour_ts"))


def by_grains(
    rows: DataFrame, aggregates: Sequence[Column], tech: str, grains: Sequence[str] | None = None
) -> DataFrame:
    """Several grains (all four by default) of partials, told apart by ``grain``.

    Each grain is an aggregate of its own, days are made of hours; no row is copied for them. Keys
    that a grain does not have are NULL.
    """
    chosen = list(grains or GRAINS[tech])
    keys = [k for k in ALL_KEYS[tech] if any(k in GRAINS[tech][g] for g in chosen)]
    parts = []
    for g in chosen:
        if g == "day":
            groups = days_of(by_grain(rows, aggregates, tech, "hour"), aggregates)
        else:
            groups = by_grain(rows, aggregates, tech, g)
        parts.append(groups.withColumn("grain", F.lit(g)))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.select("grain", *keys, *[c for c in parts[0].columns if c not in ("grain", *ALL_KEYS[tech])])
