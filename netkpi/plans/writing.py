"""What the reports of both technologies do when they write their tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netkpi.sinks.tables import run_together
from netkpi.sources.reports import REJECT, ReadCheck, rejects
from netkpi.sources.staging import Stage, is_complete

#: Grains made from the joined cells; days are made of hours.
FROM_CELLS = ("hour", "cell", "cell_hour")

#: Settings that a caller has not given. Each stage has code of its own, and methods that handle 50 columns at once stay
#: with the interpreter for long, or for good beyond 8000 bytes; above this size Spark's plain operators are used, whose
#: small methods are compiled soon.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "1500"}


@contextmanager
def settled(spark: SparkSession) -> Iterator[None]:
    """``SETTINGS`` hold while a report is written, also in sessions that know nothing of them."""
    ours = {name: value for name, value in SETTINGS.items() if spark.conf.get(name, None) is None}
    for name, value in ours.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in ours:
            spark.conf.unset(name)


def stage_groups(
    stage: Stage, name: str, groups: Callable[[str], DataFrame], days: Callable[[DataFrame], DataFrame]
) -> dict[str, DataFrame]:
    """One aggregate per grain, written once; all tables of a grain are made from it."""
    found: dict[str, DataFrame] = {}

    def one(grain: str) -> None:
        found[grain] = stage.table(groups(grain), f"{name}_{grain}")

    run_together([partial(one, g) for g in FROM_CELLS])
    found["day"] = stage.table(days(found["hour"]), f"{name}_day")
    return found


def quality_rows(spark: SparkSession, counts: Sequence[tuple[str, dict[str, int]]], tech: str, cells: DataFrame) -> DataFrame:
    """``report``, ``measure``, ``n``: counts of each pattern of files, and keys that occur more than
    once in the joined report, which count several times there."""
    rows = [(report, measure, int(n)) for report, found in counts for measure, n in found.items()]
    read = spark.createDataFrame(rows, "report string, measure string, n long")
    read = read.groupBy("report", "measure").agg(F.sum("n").alias("n"))
    repeated = cells.agg(F.count_if(F.col("joined_rows") > 1).alias("n"))
    return read.union(repeated.select(F.lit(tech).alias("report"), F.lit("repeated_keys").alias("measure"), "n"))


def staged_inputs(
    stage: Stage, inputs: dict[str, DataFrame], checks: Sequence[ReadCheck], tech: str
) -> dict[str, DataFrame]:
    """Write the inputs of the report, and count what was left out of the files they come from.

    A stage that is taken up again has some of its inputs, or of the reads before them, already; files are then counted
    on their own.
    """
    found = {name: stage.table(df, name) for name, df in inputs.items()}
    fresh = not stage.taken
    quality = f"{stage.folder}/quality"
    counts = [] if is_complete(stage.spark, quality) else [(c.report.name, c.counts(fresh)) for c in checks]
    found["quality"] = stage.table(quality_rows(stage.spark, counts, tech, found["cells"]), "quality")
    return found


def split_reads(
    stage: Stage, reports: dict[str, DataFrame], used_twice: Sequence[str] = ()
) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Reports without their rejected lines, and the rejects of all, if they were read with these.

    What was read with rejects is written once per report; rows and rejects are parts of that table. Reports that come
    from text and are ``used_twice`` are written too, so that no line is parsed twice.
    """
    rows, found = {}, None
    for name, df in reports.items():
        if REJECT not in df.columns:
            rows[name] = stage.table(df, f"read_{name}") if name in used_twice else df
            continue
        read = stage.table(df, f"read_{name}")
        rows[name] = read.where("hour_ts IS NOT NULL").drop(REJECT)
        part = rejects(read, name)
        found = part if found is None else found.unionByName(part)
    return rows, found
