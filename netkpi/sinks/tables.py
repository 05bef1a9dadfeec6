"""Detail tables and summary as Parquet (or CSV) folders.

Layout: ``<out>/<tech>/detail/slice=<ALL|A|B>/grain=<day|cell|hour|cell_hour>/day=<date>`` and
``<out>/<tech>/summary``. Reading ``detail`` as one table gives ``slice``, ``grain`` and ``day``
as partition columns; ``day`` repeats the key ``date``, for pruning and for replacing single days.

Each table is in ascending order of its keys as a whole: rows are dealt by range of the keys and sorted, so the order of
the days and, in a day, of the file names is the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netkpi.operators.grains import GRAINS
from netkpi.operators.kpis import Kpi
from netkpi.sources.staging import is_complete

SLICE_NAMES = ("ALL", "A", "B")
#: Partition column of the detail tables.
DAY = "day"

# Names of the keys in a report.
KEY_LABELS = {
    "date": "Date", "hour": "Hour", "ne_name": "NE Name", "cell_name": "CellName",
    "site": "Site", "cell": "Cell", "cell_id": "CellID",
}


def labelled(table: DataFrame, kpis: Sequence[Kpi]) -> DataFrame:
    """Keys and KPIs under their report labels, e.g. ``Traffic DL Volume (GB)``."""
    return table.withColumnsRenamed({**KEY_LABELS, **{k.column: k.label for k in kpis}})


#: What to do about tables that are there already: fail, replace them, write only those that are
#: missing or were not written to their end, or replace the days that the input has and keep all others.
MODES = ("error", "overwrite", "resume", "update")


def _save(table: DataFrame, path: str, format: str, mode: str, partition_by: Sequence[str] = ()) -> None:
    if mode not in MODES:
        raise ValueError(f"mode {mode}: not one of {', '.join(MODES)}")
    if mode == "resume" and is_complete(table.sparkSession, path):
        return
    writer = table.write.mode("error" if mode == "error" else "overwrite").partitionBy(*partition_by)
    if mode == "update" and partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def _detail_path(out: str, tech: str, slice_name: str, grain: str) -> str:
    return f"{out}/{tech}/detail/slice={slice_name}/grain={grain}"


def write_table(
    table: DataFrame,
    out: str,
    tech: str,
    slice_name: str,
    grain: str,
    kpis: Sequence[Kpi],
    format: str = "parquet",
    labels: bool = False,
    mode: str = "error",
) -> None:
    """Write one detail table: keys first, then KPIs, in ascending order of the keys, a folder per day.

    With ``mode="update"`` the days of ``table`` replace those that are there, all others stay. Each day's folder is
    replaced when all are written.
    """
    keys = GRAINS[tech][grain]
    table = table.select(*keys, *[k.column for k in kpis], F.col("date").alias(DAY))
    # the day first: the writer needs its rows day by day, and keeps an order that has it
    ordered = table.orderBy(DAY, *keys)
    if labels:
        ordered = labelled(ordered, kpis)
    _save(ordered, _detail_path(out, tech, slice_name, grain), format, mode, [DAY])


def write_summary(table: DataFrame, out: str, tech: str, format: str = "parquet", mode: str = "error") -> None:
    """The summary has a fixed number of rows: one sorted file."""
    _save(table.coalesce(1).sortWithinPartitions("position"), f"{out}/{tech}/summary", format, mode)


def write_quality(table: DataFrame, out: str, tech: str, format: str = "parquet", mode: str = "error") -> None:
    """Counts of what was read and left out: a few rows per report."""
    _save(table.coalesce(1), f"{out}/{tech}/quality", format, mode)


def write_rejects(table: DataFrame, out: str, tech: str, format: str = "parquet", mode: str = "error") -> None:
    """Lines of the exports that could not be read, or not in full."""
    _save(table, f"{out}/{tech}/rejects", format, mode)


def read_table(spark: SparkSession, out: str, tech: str, slice_name: str, grain: str) -> DataFrame:
    """A detail table as it was written in Parquet, without the partition column."""
    return spark.read.parquet(_detail_path(out, tech, slice_name, grain)).drop(DAY)


def read_back(
    spark: SparkSession, out: str, tech: str, slice_name: str, grain: str, kpis: Sequence[Kpi], format: str, labels: bool
) -> DataFrame:
    """A detail table of any format under the plain names of keys and KPIs, with ``day`` (a date) for pruning."""
    keys = GRAINS[tech][grain]
    plain = [*(f"{k} STRING" for k in keys), *(f"{k.column} DOUBLE" for k in kpis)]
    empty = spark.createDataFrame([], ", ".join([*plain, f"{DAY} DATE"]))
    named = labelled(empty, kpis) if labels else empty
    reader = spark.read.schema(named.schema).format(format)
    if format == "csv":
        reader = reader.option("header", True)
    return reader.load(_detail_path(out, tech, slice_name, grain)).toDF(*empty.columns)


def run_together(jobs: Sequence[Callable[[], None]], at_once: int = 4) -> None:
    """Submit independent write jobs from a few threads, so that the last tasks of one table
    overlap with the first ones of the next. The others still run if one fails; the first failure is
    raised at the end."""
    with ThreadPoolExecutor(at_once) as pool:
        for future in [pool.submit(job) for job in jobs]:
            future.result()
