"""Counter exports in CSV: 7 lines of preamble, a header line, then the rows.

What is preamble is told by place: the first 7 lines of a file, whatever they hold; line 8 is the
header. Every later line is a row or blank. A row of another width than the header, a second header
or a header that differs from the one of the first file fails the job with the name of the file; so does a
file that ends before its header. Files stay splittable: only the lines of a file's first split are
numbered, by the place of the file's first line in its task (:func:`read_text`).

A line break inside a quoted cell is not supported: such a row is two rows of the wrong width.

Whether 01/02/2021 is in January or February is one setting for all files, or told per file from all its rows
(``day_first=None``): a number above 12 decides. A file in which both orders occur, or that both fit, fails with its name.
"""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from netkpi.functions.labels import lte_cell_name, umts_cell
from netkpi.functions.numbers import counter_value, is_junk, quoted, text_or_null
from netkpi.functions.times import FORMATS, hour_floor, leading_numbers, parse_start_time
from netkpi.sources.catalog import UNUSED, Report

PREAMBLE_LINES = 7

# Names of the leading columns.
START_TIME = "Start Time"
NE_NAME = "NE Name"
OPERATOR = "CnOperator"
LTE_LABEL = "Cell"
UMTS_LABELS = ("BSC6910UCell", "BSC6900UCell")

# Columns beside the cells of a line: its text, its file, the text again if its width is wrong, and
# its place in the file, from 0 (only known up to the header; beyond it, NULL or any larger number), and its kind.
_LINE, _FILE, _BAD, _PLACE, _KIND = "_line_text", "_line_file", "_line_bad", "_line_place", "_line_kind"
# Whether the file of a line writes the day before the month; only there if it is told per file.
_DAY_FIRST = "_line_day_first"

#: Files of one pattern whose first lines are broadcast, about 200 bytes each. More are joined by shuffle.
MOST_BROADCAST_FILES = 50_000


def _plain(path: str) -> str:
    """A path for which no character is a wildcard."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def _header(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Column names on line 8 of the first file of a path pattern, and the number of files.

    Only the least file name comes to the driver, not the list of all files.
    """
    first, n_files = spark.read.format("binaryFile").load(path).agg(F.min("path"), F.count("*")).first()
    if first is None:
        raise FileNotFoundError(path)
    lines = spark.read.text(_plain(first)).take(PREAMBLE_LINES + 1)
    if len(lines) <= PREAMBLE_LINES:
        raise ValueError(f"{first}: no header on line {PREAMBLE_LINES + 1}")
    return next(csv.reader([lines[-1][0]])), n_files


def _placed(lines: DataFrame, n_files: int) -> DataFrame:
    """Lines with their place in the file.

    Ids rise by one from line to line of a task, and a file's first split is read by one task. So the place of a line there is
    its id less the least id of the split. That is found by an aggregate of one number per file, over
    the same scan, which parses nothing. Should the two scans be dealt to tasks in different ways, line 8
    would not be the header, and the job fails.
    """
    numbered = lines.withColumn("_id", F.monotonically_increasing_id())
    of_file = F.col(_FILE).alias("_first_file")
    firsts = numbered.where("_block = 0").groupBy(of_file).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    ends = F.raise_error(F.concat("_first_file", F.lit(f": no header on line {PREAMBLE_LINES + 1}")))
    firsts = firsts.withColumn("_first", F.when(F.col("_n") > PREAMBLE_LINES, F.col("_first")).otherwise(ends.cast("long")))
    if n_files <= MOST_BROADCAST_FILES:
        firsts = F.broadcast(firsts)
    place = F.when(F.col("_block") == 0, F.col("_id") - F.col("_first"))
    return numbered.join(firsts, F.col(_FILE) == F.col("_first_file")).select(_LINE, _FILE, place.alias(_PLACE))


def _with_day_order(lines: DataFrame, n_files: int) -> DataFrame:
    """Lines with ``_DAY_FIRST``, from an aggregate of two numbers per file over the start times of all its rows.

    A file without times of this kind has no order, and needs none; one where day and month are always equal reads alike either way.
    """
    first, second = leading_numbers(_start_text())
    numbers = lines.where(F.col(_KIND) == "row").select(F.col(_FILE).alias("_ordered"), first.alias("_a"), second.alias("_b"))
    found = (
        numbers.where("_a IS NOT NULL")
        .groupBy("_ordered")
        .agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.bool_and(F.col("_a") == F.col("_b")).alias("_equal"))
    )

    def failure(text: str) -> Column:
        return F.raise_error(F.concat("_ordered", F.lit(f": {text}"))).cast("boolean")

    order = (
        F.when((F.col("_a") > 12) & (F.col("_b") > 12), failure("start times with the day first and with the month first"))
        .when(F.col("_a") > 12, F.lit(True))
        .when((F.col("_b") > 12) | F.col("_equal"), F.lit(False))
        .otherwise(failure("start times can be read with the day first or with the month first; say which"))
    )
    found = found.select("_ordered", order.alias(_DAY_FIRST))
    if n_files <= MOST_BROADCAST_FILES:
        found = F.broadcast(found)
    return lines.join(found, F.col(_FILE) == F.col("_ordered"), "left").drop("_ordered")


def read_text(spark: SparkSession, path: str, day_order: bool = False) -> DataFrame:
    """All lines of the files of one pattern, as text cells under the names of the header.

    Preamble and header lines are still in; :func:`data_rows` takes them out. With ``day_order`` each file tells
    whether its times have the day or the month first, at the cost of one more scan.
    """
    names, n_files = _header(spark, path)
    if len(set(names)) < len(names):
        raise ValueError(f"{path}: a column name occurs twice in the header")
    schema = ", ".join(f"{quoted(n)} STRING" for n in [*names, _BAD])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    lines = spark.read.text(path).select(
        F.col("value").alias(_LINE), F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias("_block")
    )
    placed = _placed(lines, n_files)
    parsed = placed.withColumn("_cells", F.from_csv(_LINE, schema, options)).select(_LINE, _FILE, _PLACE, "_cells.*")
    lines = parsed.withColumn(_KIND, _kind(names))
    return _with_day_order(lines, n_files) if day_order else lines


def _names(lines: DataFrame) -> list[str]:
    return [n for n in lines.columns if n not in (_LINE, _FILE, _BAD, _PLACE, _KIND, _DAY_FIRST)]


def _start_time(lines: DataFrame, day_first: bool, formats: Sequence[str]) -> Column:
    """The time of a row; what its file tells goes before ``day_first``."""
    order = F.coalesce(_DAY_FIRST, F.lit(False)) if _DAY_FIRST in lines.columns else day_first
    return parse_start_time(_start_text(), order, formats)


def _cell(name: str) -> Column:
    return F.col(quoted(name))


def _label_names(names: Sequence[str], report: Report) -> list[str]:
    known = (LTE_LABEL,) if report.tech == "lte" else UMTS_LABELS
    return [n for n in names if n in known]


def _check_columns(names: Sequence[str], report: Report) -> None:
    needed = [START_TIME, NE_NAME] + ([OPERATOR] if report.per_operator_rows else [])
    needed += [c.label for c in report.counters if c.name not in UNUSED]
    missing = [n for n in needed if n not in names]
    if not _label_names(names, report):
        missing.append(LTE_LABEL if report.tech == "lte" else " or ".join(UMTS_LABELS))
    if missing:
        raise ValueError(f"{report.name}: columns are missing: {', '.join(missing)}")


def _is_header(names: Sequence[str]) -> Column:
    """All cells are those of the header."""
    cells = F.expr(f"concat_ws('\\n', {', '.join(map(quoted, names))})")
    return F.coalesce((_cell(START_TIME) == START_TIME) & (cells == "\n".join(names)), F.lit(False))


def _preamble() -> Column:
    return F.coalesce(F.col(_PLACE) < PREAMBLE_LINES, F.lit(False))


def _at_header() -> Column:
    return F.coalesce(F.col(_PLACE) == PREAMBLE_LINES, F.lit(False))


def _blank() -> Column:
    return F.trim(_LINE) == ""


def _damaged() -> Column:
    """A row of another width than the header."""
    return F.col(_BAD).isNotNull()


def _start_text() -> Column:
    return F.coalesce(text_or_null(F.trim(_cell(START_TIME))), F.lit(""))


def _kind(names: Sequence[str]) -> Column:
    """What a line is: ``preamble``, ``header``, ``blank``, ``damaged``, ``repeated`` (a header that does not stand
    on line 8, or another line there), ``without_time``, ``row``. Cells are compared with the header only where the
    first one is that of the header."""
    return (
        F.when(_preamble(), "preamble")
        .when(_at_header(), F.when(_is_header(names), "header").otherwise("repeated"))
        .when(_blank(), "blank")
        .when(_damaged(), "damaged")
        .when(_start_text() == "", "without_time")
        .when(_start_text() == START_TIME, "repeated")
        .otherwise("row")
    )


def _failure(report: Report, text: str, *more: Column) -> Column:
    said = [F.lit(f"{report.name}: "), F.col(_FILE), F.lit(f": {text}"), *more]
    return F.raise_error(F.concat(*said)).cast("boolean")


def data_rows(
    lines: DataFrame, report: Report, day_first: bool = False, formats: Sequence[str] = FORMATS, strict: bool = True
) -> DataFrame:
    """Rows with a start time, which is added as ``ts``.

    Preamble, header, blank lines and rows without a start time are left out (:func:`line_counts` tells
    how many). A row of another width, or with a start time that cannot be read, fails the job or, with
    ``strict=False``, is left out (:func:`rejects` has it). A header that differs from the one of the first file always
    fails it: its columns would land in the wrong places.
    """
    names = _names(lines)
    text = _start_text()
    ts = _start_time(lines, day_first, formats)
    left_out = F.lit(False)
    kind = F.col(_KIND)
    keep = (
        F.when(kind.isin("preamble", "header", "blank", "without_time"), left_out)
        .when(kind == "repeated", _failure(report, "files with different headers, or a header in the wrong place; read them one by one"))
        .when(
            kind == "damaged",
            _failure(report, "a row with missing or additional cells: ", F.left(_LINE, F.lit(200))) if strict else left_out,
        )
        .when(ts.isNotNull(), F.lit(True))
        .otherwise(_failure(report, "cannot read start time: ", text) if strict else left_out)
    )
    return lines.filter(keep).select(*map(_cell, names), ts.alias("ts"))


#: Column of a lenient reading: why and from where a line is rejected, NULL for all others.
REJECT = "_reject"
_REJECT_FIELDS = ("file", "line", "reason", "columns")


def marked_rows(lines: DataFrame, report: Report, day_first: bool = False, formats: Sequence[str] = FORMATS) -> DataFrame:
    """What :func:`data_rows` has with ``strict=False``, and the rejected lines too, with ``REJECT``.

    Rejected are rows of another width and rows whose start time cannot be read, both with ``ts`` NULL, and rows with a cell that
    is no number, which stay rows, with that cell missing.
    """
    names = _names(lines)
    kind = F.col(_KIND)
    repeated = _failure(report, "files with different headers, or a header in the wrong place; read them one by one")
    keep = F.when(kind == "repeated", repeated).otherwise(kind.isin("row", "damaged"))
    labels = [c.label for c in report.counters if c.label in names]
    junk = F.expr(f"concat_ws(', ', {', '.join(f'CASE WHEN {is_junk(n)} THEN {_sql_text(n)} END' for n in labels)})")
    rows = lines.filter(keep).withColumn("ts", F.when(kind == "row", _start_time(lines, day_first, formats)))
    reason = (
        F.when(kind == "damaged", "missing or additional cells")
        .when(F.col("ts").isNull(), "start time")
        .when(F.col("_junk") != "", "not a number")
    )
    reject = F.struct(
        F.col(_FILE).alias("file"),
        F.col(_LINE).alias("line"),
        F.col("_reason").alias("reason"),
        F.when(F.col("_reason") == "not a number", F.col("_junk")).alias("columns"),
    )
    rows = rows.withColumn("_junk", junk).withColumn("_reason", reason)
    return rows.select(*map(_cell, names), "ts", F.when(F.col("_reason").isNotNull(), reject).alias(REJECT))


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rejects(marked: DataFrame, report: str) -> DataFrame:
    """``report``, ``file``, ``line``, ``reason``, ``columns`` (names, where cells are no numbers) of a lenient reading."""
    return marked.where(F.col(REJECT).isNotNull()).select(F.lit(report).alias("report"), *[f"{REJECT}.{f}" for f in _REJECT_FIELDS])


def clean(rows: DataFrame, report: Report, strict: bool = True) -> DataFrame:
    """Hour, keys and counters of data rows."""
    names = rows.columns
    label = F.coalesce(*[text_or_null(_cell(n)) for n in _label_names(names, report)])
    if report.tech == "lte":
        keys = {"ne_name": text_or_null(_cell(NE_NAME)), "cell_name": lte_cell_name(label)}
    else:
        keys = umts_cell(label)
    if report.per_operator_rows:
        keys["cn_operator"] = text_or_null(_cell(OPERATOR))
    time_and_keys = {"hour_ts": hour_floor(F.col("ts")), **keys}
    counters = [
        f"{counter_value(c.label, strict) if c.label in names else 'CAST(NULL AS DOUBLE)'} AS {c.column}"
        for c in report.counters
    ]
    more = [REJECT] if REJECT in names else []
    return rows.select(*[expr.alias(name) for name, expr in time_and_keys.items()], *map(F.expr, counters), *more)


# --- counts and rejects ---------------------------------------------------------


def _junk_cells(names: Sequence[str], report: Report) -> Column:
    flags = [f"CAST({is_junk(c.label)} AS INT)" for c in report.counters if c.label in names]
    return F.expr(" + ".join(flags) or "0")


#: Kinds of lines that are counted.
COUNTED = {"headers": "header", "preamble": "preamble", "blank": "blank", "without_time": "without_time", "damaged": "damaged"}


def _counts(names: Sequence[str], report: Report, junk: bool) -> list[Column]:
    kind = F.col(_KIND)
    return [
        F.count("*").alias("n_lines"),
        *[F.count_if(kind == k).alias(name) for name, k in COUNTED.items()],
        F.sum(F.when(kind == "row", _junk_cells(names, report) if junk else F.lit(0))).alias("junk_cells"),
    ]


def line_counts(lines: DataFrame, report: Report, junk: bool = True) -> DataFrame:
    """Per file: lines, headers, lines of the preamble, blank lines, rows without start time, damaged rows, junk cells."""
    counts = _counts(_names(lines), report, junk)
    return lines.groupBy(F.col(_FILE).alias("file")).agg(*counts)


@dataclass
class ReadCheck:
    """Counts of one path pattern, taken while its rows are used for the first time."""

    report: Report
    lines: DataFrame
    junk: bool
    observation: Observation

    @staticmethod
    def of(lines: DataFrame, report: Report, junk: bool) -> ReadCheck:
        return ReadCheck(report, lines, junk, Observation(f"lines-{uuid.uuid4().hex}"))

    def _columns(self) -> list[Column]:
        return _counts(_names(self.lines), self.report, self.junk)

    def observed(self) -> DataFrame:
        return self.lines.observe(self.observation, *self._columns())

    def counts(self, observed: bool = True) -> dict[str, int]:
        """Counts of all files. Call it after the rows were used, or say that they were not ``observed``: the files are
        then read for it, as they are if a task was repeated and its lines were counted twice."""
        found = self.observation.get if observed else {}
        if not found or found["preamble"] != PREAMBLE_LINES * found["headers"]:
            found = self.lines.agg(*self._columns()).first().asDict()
        return {k: v or 0 for k, v in found.items()}


def read_report(
    spark: SparkSession,
    report: Report,
    paths: str | Sequence[str],
    strict: bool = True,
    day_first: bool | None = False,
    formats: Sequence[str] = FORMATS,
    checks: list[ReadCheck] | None = None,
    with_rejects: bool = False,
) -> DataFrame:
    """A clean report from all files that match the path patterns.

    Files of one pattern share one header; patterns may differ (other column order, other
    controller type). ``strict=False`` reads junk in a counter as missing and leaves out rows that cannot be read. ``day_first=None`` lets each file tell the
    order of day and month.

    ``with_rejects`` reads leniently and keeps the rejected lines, with ``REJECT``: write the result once and take rows
    (those with an hour) and :func:`rejects` from there.

    Lines are parsed once: the counts that go into ``checks`` (:meth:`ReadCheck.counts`) are taken while the rows are
    used for the first time.
    """
    result = None
    for path in [paths] if isinstance(paths, str) else paths:
        lines = read_text(spark, path, day_order=day_first is None)
        _check_columns(_names(lines), report)
        check = ReadCheck.of(lines, report, not strict)
        if checks is not None:
            checks.append(check)
        lines = check.observed()
        order = bool(day_first)
        rows = marked_rows(lines, report, order, formats) if with_rejects else data_rows(lines, report, order, formats, strict)
        part = clean(rows, report, strict and not with_rejects)
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError(f"{report.name}: no path given")
    return result
