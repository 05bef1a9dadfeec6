"""Headline timings over the ``lineitem`` adapter; prints one JSON line.

``$BENCH_SF_DIR`` is the folder with the tables, ``$BENCH_CPUS`` the number of cores. The session has
the settings of the command line (``netkpi.__main__.SETTINGS``).
The reports are first made from ``lineitem`` and written (``setup_sec``, not part of the
total); every query starts from those files, as the engine does in use.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netkpi.__main__ import settled
from netkpi.operators.grains import GRAINS
from netkpi.plans import lte, registered, umts
from netkpi.sources import adapters, catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("netkpi bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.files.minPartitionNum", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return settled(spark)


def timed(action: Callable[[], object]) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    folder = tempfile.mkdtemp(prefix="netkpi-bench-")
    rows = adapters.measurements(spark, SF_DIR, "lineitem")

    def make_reports() -> None:
        for report in catalog.REPORTS.values():
            adapters.clean_report(rows, report).write.parquet(f"{folder}/{report.name}")

    setup = timed(make_reports)
    times: dict[str, float] = {}
    r = {name: spark.read.parquet(f"{folder}/{name}") for name in catalog.REPORTS}
    lte_reports = lte.LteReports(r["lte_daily"], r["lte_daily1"], r["lte_emtc"], r["lte_operator"])
    umts_reports = umts.UmtsReports(r["umts_daily"], r["umts_daily1"], r["umts_operator"])

    def lte_cells() -> DataFrame:
        return lte.cells(r["lte_daily"], r["lte_daily1"], r["lte_emtc"])

    def umts_cells() -> DataFrame:
        return umts.cells(r["umts_daily"], r["umts_daily1"])

    for grain in GRAINS["lte"]:
        times[f"lte_kpi_{grain}"] = timed(lambda: run(lte.network_table(lte_cells(), grain)))
        times[f"umts_kpi_{grain}"] = timed(lambda: run(umts.network_table(umts_cells(), grain)))
        times[f"lte_plmn_{grain}_a"] = timed(
            lambda: run(lte.operator_table(lte_cells(), r["lte_operator"], grain, "A"))
        )
        times[f"umts_plmn_{grain}_a"] = timed(lambda: run(umts.operator_table(r["umts_operator"], grain, "A")))
    times["lte_full_report"] = timed(lambda: lte.write_report(spark, lte_reports, f"{folder}/out"))
    times["umts_full_report"] = timed(lambda: umts.write_report(spark, umts_reports, f"{folder}/out"))

    csv = f"{folder}/csv"
    text = adapters.text_report(rows, catalog.LTE_DAILY)
    setup += timed(lambda: registered.write_exports(text, csv))
    times["csv_read_lte_daily"] = timed(
        lambda: run(registered.read_report(spark, catalog.LTE_DAILY, f"{csv}/part-*"))
    )
    line = {
        "metric": "total time of the KPI queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "setup_sec": setup,
        "inputs": {name: {"rows": df.count(), "files": len(df.inputFiles())} for name, df in r.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
