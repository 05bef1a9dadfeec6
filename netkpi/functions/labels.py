"""Names inside the object labels of the exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _word(text: Column, position: int) -> Column:
    """The n-th word (from 0) of a text; NULL if there are not as many."""
    words = F.split(F.regexp_replace(text, r"^\s+", ""), r"\s+")
    return F.nullif(F.get(words, F.lit(position)), F.lit(""))


def _part(text: Column, separator: str, position: int) -> Column:
    return F.get(F.split(text, separator), F.lit(position))


def lte_cell_name(label: Column) -> Column:
    """Value of the 8th word (``Name=CELL_A,``) of an LTE cell label."""
    return _part(_part(_word(label, 7), "=", 1), ",", 0)


def umts_cell(label: Column) -> dict[str, Column]:
    """Site, cell and cell id of a UMTS label such as ``Label=S1_2, CellID=4711, ...``."""
    text = F.substring(label, 7, 2**31 - 1)
    cell = _part(_part(_word(text, 0), "=", 0), ",", 0)
    cell_id = _part(_part(_word(text, 1), "=", 1), ",", 0)
    return {"site": _part(cell, "_", 0), "cell": cell, "cell_id": cell_id}
