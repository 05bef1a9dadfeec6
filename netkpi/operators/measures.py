"""Sums, counts and maxima that can be built up in steps.

A *partial* table holds, for a counter ``c``, the column ``c`` (its sum), ``n_c``
(how many values were not missing) and ``max_c``. Partials of smaller groups
merge into partials of larger ones, so every grain can be made from the finest
one. A mean is always sum / count of the merged partial.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measures:
    sums: tuple[str, ...]
    counts: tuple[str, ...] = ()
    maxima: tuple[str, ...] = ()

    def __add__(self, other: Measures) -> Measures:
        return Measures(self.sums + other.sums, self.counts + other.counts, self.maxima + other.maxima)

    def reading(self, formulas: str) -> Measures:
        """Only what some formula reads."""
        words = set(re.findall(r"\w+", formulas))
        counts = tuple(c for c in self.counts if words & {f"n_{c}", f"mean_{c}"})
        return Measures(
            tuple(c for c in self.sums if words & {c, f"mean_{c}"}),
            counts,
            tuple(c for c in self.maxima if f"max_{c}" in words),
        )

    def columns(self) -> list[str]:
        """Columns of a partial."""
        return [*self.sums, *[f"n_{c}" for c in self.counts], *[f"max_{c}" for c in self.maxima]]

    def of_rows(self) -> list[Column]:
        """Aggregates that turn rows into a partial."""
        return _columns(
            [f"sum({c}) AS {c}" for c in self.sums]
            + [f"count({c}) AS n_{c}" for c in self.counts]
            + [f"max({c}) AS max_{c}" for c in self.maxima]
        )

    def of_partials(self) -> list[Column]:
        """Aggregates that merge partials."""
        return _columns(
            [f"sum({c}) AS {c}" for c in self.sums]
            + [f"sum(n_{c}) AS n_{c}" for c in self.counts]
            + [f"max(max_{c}) AS max_{c}" for c in self.maxima]
        )

    def scaled(self, factor: str) -> list[str]:
        """SQL for a partial as if each of its rows were there ``factor`` times."""
        added = [*self.sums, *[f"n_{c}" for c in self.counts]]
        return [f"{c} * {factor} AS {c}" for c in added] + [f"max_{c}" for c in self.maxima]

    def finished(self) -> list[str]:
        """SQL for a merged partial. The sum of a group without any value is 0; its mean and
        maximum stay missing."""
        return (
            [f"coalesce({c}, 0D) AS {c}" for c in self.sums]
            + [f"try_divide({c}, n_{c}) AS mean_{c}" for c in self.counts]
            + [f"n_{c}" for c in self.counts]
            + [f"max_{c}" for c in self.maxima]
        )


def _columns(expressions: list[str]) -> list[Column]:
    return [F.expr(e) for e in expressions]
