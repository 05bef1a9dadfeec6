"""``python -m netkpi lte|umts``: counter exports in, KPI tables out.

The Spark settings (master, memory, ``spark.checkpoint.dir``) come from ``spark-submit``.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from netkpi.functions.times import FORMATS
from netkpi.plans import lte, umts
from netkpi.plans.writing import SETTINGS
from netkpi.sinks.tables import MODES


def settled(spark: SparkSession) -> SparkSession:
    given = dict(spark.sparkContext.getConf().getAll())
    for name, value in SETTINGS.items():
        if name not in given:
            spark.conf.set(name, value)
    return spark


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="netkpi", description=__doc__)
    techs = parser.add_subparsers(dest="tech", required=True)
    inputs = {"lte": ("daily", "daily1", "emtc", "operator"), "umts": ("daily", "daily1", "operator")}
    for tech, names in inputs.items():
        command = techs.add_parser(tech)
        for name in names:
            command.add_argument(f"--{name}", required=True, nargs="+", help="paths or patterns of CSV exports")
        command.add_argument("--out", required=True, help="folder for the tables")
        command.add_argument("--format", choices=["parquet", "csv"], default="parquet")
        command.add_argument("--labels", action="store_true", help="name columns as in a printed report")
        command.add_argument("--lenient", action="store_true", help="junk in a counter is missing, unreadable rows go to a table of rejects")
        command.add_argument("--mode", choices=MODES, default="error", help="what to do about tables that are there")
        command.add_argument("--staging", help="folder of staged tables that a failed run has left")
        command.add_argument("--time-format", nargs="+", default=FORMATS, help="start times, beside ISO")
        command.add_argument("--drop-unmatched", action="store_true", help="leave out cells and hours that a report lacks before the sums")
        order = command.add_mutually_exclusive_group()
        order.add_argument("--day-first", action="store_true", help="01/02/2021 is the first of February")
        order.add_argument("--day-order-by-file", action="store_true", help="each file tells whether the day or the month is first")
    return parser


def main(argv: Sequence[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = settled(SparkSession.builder.appName(f"netkpi {args.tech}").getOrCreate())
    options = {"strict": not args.lenient, "with_rejects": args.lenient, "day_first": None if args.day_order_by_file else args.day_first, "formats": tuple(args.time_format)}
    written = {"format": args.format, "labels": args.labels, "mode": args.mode, "staging": args.staging, "drop_unmatched": args.drop_unmatched}
    if args.tech == "lte":
        reports = lte.read_reports(spark, args.daily, args.daily1, args.emtc, args.operator, **options)
        lte.write_report(spark, reports, args.out, **written)
    else:
        reports = umts.read_reports(spark, args.daily, args.daily1, args.operator, **options)
        umts.write_report(spark, reports, args.out, **written)


if __name__ == "__main__":
    main()
