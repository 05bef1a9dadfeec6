"""Counter reports made from the test tables ``events`` and ``lineitem``.

Each table row is taken as a measurement ``(h, u, t, x, v)``: hour, cell number,
kind, row id and value. Rows are summed per cell and hour (and kind, for the
per-operator report) into the counters of a report. All sums are whole numbers,
so they do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netkpi.functions.times import hour_floor
from netkpi.sources.catalog import Report

KINDS = ("view", "click", "purchase", "signup", "error")

# Kind of row each report leaves out when reports are joined, so that joins have something to drop.
_LEFT_OUT = {
    "lte_daily": "error",
    "lte_daily1": "signup",
    "lte_emtc": "click",
    "umts_daily": "error",
    "umts_daily1": "signup",
}

# Ordinal of the first counter; follows on from the report it is joined to.
_FIRST_ORDINAL = {"lte_daily1": 51, "lte_emtc": 58, "umts_daily1": 112}

# Volume counters are made large enough to give more than 0.00 GB.
_VOLUME_UNITS = ("bit", "byte")
_VOLUME_SCALE = 1_000_003


def measurements(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "events":
        return rows.select(
            hour_floor(F.col("ts")).alias("h"),
            F.col("user_id").alias("u"),
            F.col("event_type").alias("t"),
            F.col("event_id").alias("x"),
            F.round(F.col("value") * 100).cast("bigint").alias("v"),
        )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return rows.select(
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 24).cast("int"))).alias("h"),
        F.col("l_suppkey").alias("u"),
        F.get(kinds, (F.col("l_orderkey") % 5).cast("int")).alias("t"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("x"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("v"),
    )


def _padded(width: int) -> Column:
    return F.lpad(F.col("u").cast("string"), width, "0")


def _unnamed() -> Column:
    return F.col("u") % 50 == 49


def _ne_name() -> Column:
    return F.concat(F.lit("NE"), F.lpad((F.col("u") % 20).cast("string"), 2, "0"))


def _summed(rows: DataFrame, report: Report, all_kinds: bool) -> DataFrame:
    """One row per group with the smallest row id and the counter sums.

    Rows are dealt by group before they are summed: a row has five columns, its sums up to 113, and few rows share a
    group. So the wide sums are not shuffled, and they are made by as many tasks as a shuffle has, however few can read the file.
    """
    groups = ["h", "u"] + (["t"] if report.per_operator_rows else [])
    if report.name in _LEFT_OUT and not all_kinds:
        rows = rows.filter(F.col("t") != _LEFT_OUT[report.name])
    first = _FIRST_ORDINAL.get(report.name, 0)
    sums = []
    for i, counter in enumerate(report.counters, start=first):
        scale = _VOLUME_SCALE if counter.unit in _VOLUME_UNITS else 1
        value = f"(v * {2 * i + 1} + x * {i + 3}) % 1009 * {scale}"
        sums.append(F.expr(f"sum({value}) AS {counter.column}"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *groups).groupBy(*groups).agg(F.min("x").alias("x0"), *sums)


def _operator_number() -> Column:
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS[:4]]), F.col("t")) - 1
    return F.when(number >= 0, number)


def clean_report(rows: DataFrame, report: Report, all_kinds: bool = False) -> DataFrame:
    """A report as it is after cleaning: hour, keys, counters as DOUBLE.

    ``all_kinds`` takes all rows of the table, also those left out for the sake of joins.
    """
    if report.tech == "lte":
        keys = {
            "ne_name": _ne_name(),
            "cell_name": F.when(~_unnamed(), F.concat(F.lit("C"), _padded(6))),
        }
    else:
        site = F.concat(F.lit("S"), (F.col("u") % 20).cast("string"))
        number = F.col("u").cast("string")
        keys = {
            "site": F.when(_unnamed(), F.lit("short")).otherwise(site),
            "cell": F.when(_unnamed(), F.lit("short")).otherwise(F.concat_ws("_", site, number)),
            "cell_id": F.when(~_unnamed(), number),
        }
    if report.per_operator_rows:
        keys["cn_operator"] = F.concat(F.lit("CN Operator ID="), _operator_number().cast("string"))
    first = _FIRST_ORDINAL.get(report.name, 0)
    counters = [
        F.expr(
            f"CASE WHEN (x0 + {i}) % 97 = 0 THEN 0D "
            f"WHEN (x0 + {i}) % 89 <> 0 THEN CAST({c.column} AS DOUBLE) END AS {c.column}"
        )
        for i, c in enumerate(report.counters, start=first)
    ]
    named = [expr.alias(name) for name, expr in keys.items()]
    return _summed(rows, report, all_kinds).select(F.col("h").alias("hour_ts"), *named, *counters)


def text_report(rows: DataFrame, report: Report, all_kinds: bool = False) -> DataFrame:
    """The same report as text cells under the names of the CSV header, with ``NIL`` and blanks."""
    n = F.col("u").cast("string")
    if report.tech == "lte":
        label = (
            "Cell",
            F.when(_unnamed(), F.lit("bad cell")).otherwise(
                F.concat(
                    F.lit("eNodeB Function Name=E"), (F.col("u") % 20).cast("string"),
                    F.lit(", Local Cell ID="), (F.col("u") % 6).cast("string"),
                    F.lit(", Cell Name=C"), _padded(6), F.lit(", eNodeB ID="), n,
                )
            ),
        )
    else:
        label = (
            "BSC6910UCell",
            F.when(_unnamed(), F.lit("Label=short")).otherwise(
                F.concat(
                    F.lit("Label=S"), (F.col("u") % 20).cast("string"), F.lit("_"), n,
                    F.lit(", CellID="), n, F.lit(", LogicRNCID=1"),
                )
            ),
        )
    lead = {
        "Start Time": F.concat_ws(
            " ", F.to_date("h").cast("string"), F.concat(F.lpad(F.hour("h").cast("string"), 2, "0"), F.lit(":00"))
        ),
        "Period": F.lit("60"),
        "NE Name": _ne_name(),
        label[0]: label[1],
    }
    if report.per_operator_rows:
        lead["CnOperator"] = F.concat(F.lit("CN Operator ID="), _operator_number().cast("string"))
    first = _FIRST_ORDINAL.get(report.name, 0)
    counters = [
        F.expr(
            f"CASE WHEN (x0 + {i}) % 97 = 0 THEN 'NIL' "
            f"WHEN (x0 + {i}) % 89 <> 0 THEN CAST({c.column} AS STRING) END AS `{c.label}`"
        )
        for i, c in enumerate(report.counters, start=first)
    ]
    return _summed(rows, report, all_kinds).select(*[expr.alias(name) for name, expr in lead.items()], *counters)
