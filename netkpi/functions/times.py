"""Start time of a measurement and the keys made from it.

Times are wall-clock times without a zone (``TIMESTAMP_NTZ``). The text keys
are built from date and hour parts, not with ``date_format``, because that one
goes through the session time zone and would move hours in a DST gap. For the
same reason other spellings are rewritten as ISO text before they are cast.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{1,2}-\d{1,2}"

#: Spellings that are tried after ISO, in this order. Seconds may be missing, ``/`` may be ``-``.
FORMATS = (
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy hh:mm:ss a",
    "dd-MMM-yyyy HH:mm:ss",
    "dd-MMM-yyyy hh:mm:ss a",
    "yyyyMMdd HH:mm:ss",
)
# What a letter group of a format stands for.
_PARTS = {
    "yyyy": r"(\d{4})",
    "MMM": r"([A-Za-z]{3})[a-z]*",
    "MM": r"(\d{1,2})",
    "dd": r"(\d{1,2})",
    "HH": r"(\d{1,2})",
    "hh": r"(\d{1,2})",
    "mm": r"(\d{2})",
    ":ss": r"(?::(\d{2})(?:\.\d+)?)?",
    "a": r"([AaPp])\.?[Mm]\.?",
}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _in_format(text: Column, pattern: str) -> Column:
    """ISO text of a time in one format, NULL if it is in another one."""
    compact = "yyyyMMdd" in pattern
    regex, parts = "", []
    for token in re.findall("yyyy|MMM|MM|dd|HH|hh|mm|:ss|a|.", pattern):
        if token in _PARTS:
            parts.append(token)
            regex += r"(\d{2})" if compact and token in ("MM", "dd") else _PARTS[token]
        else:
            regex += {"/": "[/-]", "-": "[/-]", " ": r"\s+"}.get(token, re.escape(token))
    regex = f"^{regex}$"

    def part(name: str) -> Column:
        return F.regexp_extract(text, regex, parts.index(name) + 1)

    month = F.lpad(part("MM"), 2, "0") if "MM" in parts else F.lpad(
        F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(part("MMM"))).cast("string"), 2, "0"
    )
    if "hh" in parts:
        number = part("hh").try_cast("int")
        late = F.lower(part("a")) == "p"
        in_clock = F.when(number.between(1, 12), number % 12 + F.when(late, 12).otherwise(0))
        hour = in_clock.cast("string")
    else:
        hour = part("HH")
    seconds = F.coalesce(F.nullif(part(":ss"), F.lit("")), F.lit("00"))
    iso = F.concat(part("yyyy"), F.lit("-"), month, F.lit("-"), F.lpad(part("dd"), 2, "0"), F.lit(" "),
                   F.lpad(hour, 2, "0"), F.lit(":"), part("mm"), F.lit(":"), seconds)
    return F.when(text.rlike(regex), iso)


def _swapped(pattern: str) -> str:
    return pattern.replace("MM/dd", "dd/MM")


def parse_start_time(text: Column, day_first: bool | Column = False, formats: Sequence[str] = FORMATS) -> Column:
    """Read ISO times, then the formats in order; NULL if unreadable.

    ``day_first`` reads ``MM/dd/yyyy`` formats as ``dd/MM/yyyy``; as a column it says so row by row.
    """
    text = F.trim(text)

    def spelling(pattern: str) -> Column:
        if not isinstance(day_first, Column):
            return _in_format(text, _swapped(pattern) if day_first else pattern)
        if _swapped(pattern) == pattern:
            return _in_format(text, pattern)
        return F.when(day_first, _in_format(text, _swapped(pattern))).otherwise(_in_format(text, pattern))

    spellings = [F.when(text.rlike(_ISO), text), *map(spelling, formats)]
    return F.coalesce(*[s.try_cast("timestamp_ntz") for s in spellings])


def leading_numbers(text: Column) -> tuple[Column, Column]:
    """The two numbers before the year of a time like 01/02/2021, if one of them can be the day and the other the
    month; else NULLs."""
    regex = r"^(\d{1,2})[/-](\d{1,2})[/-]\d{4}(?:\D|$)"
    first, second = (F.regexp_extract(F.trim(text), regex, i).try_cast("int") for i in (1, 2))
    fits = (F.least(first, second) >= 1) & (F.least(first, second) <= 12) & (F.greatest(first, second) <= 31)
    return F.when(fits, first), F.when(fits, second)


def hour_floor(ts: Column) -> Column:
    """Cut a time to the full hour."""
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def hour_text(hour: Column) -> Column:
    """``7`` -> ``07:00``."""
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def time_keys(ts: Column) -> dict[str, Column]:
    """The three text keys of a row: start time (to the hour), date and hour."""
    date = F.to_date(ts).cast("string")
    hour = hour_text(F.hour(ts))
    return {"start_time": F.concat_ws(" ", date, hour), "date": date, "hour": hour}
