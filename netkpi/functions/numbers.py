"""Counter texts to numbers, and the rounding of KPIs.

Reports have dozens of counters, so the expressions are written as SQL text: one
parsed expression per column instead of a chain of column calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NIL = "NIL"

# Texts that stand for a missing value in a CSV cell.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_MISSING_SQL = "(" + ", ".join(f"'{m}'" for m in MISSING) + ")"


# A cast alone would also take other spellings for numbers, such as 1d, 2f or 0x1p3.
_NUMBER = "^(?:[-+.0-9eE]+|[-+]?(?i:inf(?:inity)?))$"


def _number(text: str) -> str:
    return f"CASE WHEN {text} RLIKE '{_NUMBER}' THEN try_cast({text} AS DOUBLE) END"


def quoted(name: str) -> str:
    """A column name for use in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def text_or_null(text: Column) -> Column:
    """A text cell; the texts that mean *missing* become NULL."""
    return F.when(~text.isin(*MISSING), text)


def counter_value(name: str, strict: bool = True) -> str:
    """SQL for a text column: ``NIL`` is 0, a missing cell is NULL, other texts are numbers.

    A text that is no number fails the job, or becomes NULL with ``strict=False``
    (see :func:`is_junk` for finding such cells).
    """
    text = f"trim({quoted(name)})"
    number = _number(text)
    if strict:
        number = f"coalesce({number}, CAST(raise_error(concat('not a number: ', {text})) AS DOUBLE))"
    return f"CASE WHEN {text} = '{NIL}' THEN 0D WHEN {text} NOT IN {_MISSING_SQL} THEN {number} END"


def is_junk(name: str) -> str:
    """SQL: true for a cell that is neither a number nor ``NIL`` nor missing."""
    text = f"trim({quoted(name)})"
    return f"coalesce({text} <> '{NIL}' AND {text} NOT IN {_MISSING_SQL} AND ({_number(text)}) IS NULL, false)"


def round_even(value: str, digits: int) -> str:
    """SQL: round half to even (``round`` of Spark rounds half up)."""
    if digits == 0:
        return f"rint({value})"
    return f"rint(({value}) * {10**digits}) / {10**digits}"
