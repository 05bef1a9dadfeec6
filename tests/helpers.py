from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from netkpi.sources.catalog import Report


def hour(text: str) -> dt.datetime:
    return dt.datetime.strptime(text, "%Y-%m-%d %H:%M")


def clean_frame(spark: SparkSession, report: Report, rows: list[dict], default: float | None = 0.0) -> DataFrame:
    """A clean report: rows give ``hour_ts``, keys and the counters that matter."""
    names = [*report.keys] + (["cn_operator"] if report.per_operator_rows else [])
    schema = T.StructType(
        [T.StructField("hour_ts", T.TimestampNTZType())]
        + [T.StructField(n, T.StringType()) for n in names]
        + [T.StructField(c, T.DoubleType()) for c in report.columns]
    )
    values = [
        (r["hour_ts"], *[r.get(n) for n in names], *[r.get(c, default) for c in report.columns]) for r in rows
    ]
    for r in rows:
        assert set(r) <= {"hour_ts", *names, *report.columns}, set(r)
    return spark.createDataFrame(values, schema)


def write_export(path, names: list[str], rows: list[list[str]], preamble: int = 7) -> None:
    """An export file as text: preamble, header, rows; every cell quoted unless empty."""
    lines = [f"Report line {i}" for i in range(preamble)] + [",".join(names)]
    lines += [",".join('"' + c + '"' if c else "" for c in row) for row in rows]
    path.write_text("\n".join(lines) + "\n")
