"""KPI formulas as data, and their evaluation on grouped counters.

A formula is a Spark SQL expression. In it, a counter column is the sum over the
group, ``n_<counter>`` the number of its values, ``max_<counter>`` its maximum and
``mean_<counter>`` its mean. Divisions go through :func:`ratio`, so a zero
denominator gives NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from netkpi.functions.numbers import round_even
from netkpi.operators.measures import Measures
from netkpi.sources.catalog import snake


def ratio(numerator: str, denominator: str) -> str:
    return f"try_divide({numerator}, {denominator})"


def total(*terms: str) -> str:
    return "(" + " + ".join(terms) + ")"


@dataclass(frozen=True)
class Kpi:
    label: str
    sql: str
    digits: int | None = 2
    of_kpis: bool = False  # the formula reads other KPIs
    note: str = ""  # where the formula is kept although it looks odd

    @property
    def column(self) -> str:
        return snake(self.label.replace("%", " pct "))


def with_kpis(groups: DataFrame, measures: Measures, kpis: Sequence[Kpi], keys: Sequence[str]) -> DataFrame:
    """Keys and KPIs of grouped counters; everything else is dropped."""

    def value(kpi: Kpi) -> str:
        rounded = kpi.sql if kpi.digits is None else round_even(kpi.sql, kpi.digits)
        return f"{rounded} AS {kpi.column}"

    ready = groups.selectExpr(*keys, *measures.finished())
    first = ready.selectExpr("*", *[value(k) for k in kpis if not k.of_kpis])
    return first.selectExpr(*keys, *[value(k) if k.of_kpis else k.column for k in kpis])
