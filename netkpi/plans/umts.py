"""The UMTS report: three exports in, twelve detail tables and a summary out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from netkpi.operators import summary as summary_rows
from netkpi.operators.grains import ALL_KEYS, GRAINS, by_grain, by_grains, days_of, text_times
from netkpi.operators.joins import join_reports
from netkpi.operators.kpis import Kpi, with_kpis
from netkpi.plans import umts_kpis as spec
from netkpi.plans.writing import settled, split_reads, stage_groups, staged_inputs
from netkpi.sinks.tables import SLICE_NAMES, read_back, run_together, write_quality, write_rejects, write_summary, write_table
from netkpi.sources import catalog
from netkpi.sources.reports import ReadCheck, read_report
from netkpi.sources.staging import Stage

TECH = "umts"


@dataclass(frozen=True)
class UmtsReports:
    """The three clean reports."""

    daily: DataFrame
    daily1: DataFrame
    operator: DataFrame
    checks: tuple[ReadCheck, ...] = ()  # of the files they come from


def read_reports(spark: SparkSession, daily: str, daily1: str, operator: str, **options) -> UmtsReports:
    """Reports from CSV exports; their files are checked when :func:`write_report` has read them."""
    checks: list[ReadCheck] = []
    parts = [
        read_report(spark, report, paths, checks=checks, **options)
        for report, paths in (
            (catalog.UMTS_DAILY, daily),
            (catalog.UMTS_DAILY1, daily1),
            (catalog.UMTS_OPERATOR, operator),
        )
    ]
    return UmtsReports(*parts, checks=tuple(checks))


def cells(daily: DataFrame, daily1: DataFrame, drop_unmatched: bool = False) -> DataFrame:
    """The two network reports joined: one partial per hour and cell."""
    sides = [
        (spec.with_terms(daily, spec.DAILY_TERMS), spec.DAILY),
        (spec.with_terms(daily1, spec.DAILY1_TERMS), spec.DAILY1),
    ]
    return join_reports(sides, catalog.KEYS[TECH], drop_unmatched)


def network_groups(cell_hours: DataFrame, grain: str) -> DataFrame:
    aggregates = spec.NETWORK.of_partials()
    if grain == "day":
        return days_of(network_groups(cell_hours, "hour"), aggregates)
    return by_grain(cell_hours, aggregates, TECH, grain)


def network_kpis(groups: DataFrame, grain: str) -> DataFrame:
    return text_times(with_kpis(groups, spec.NETWORK, spec.NETWORK_KPIS, GRAINS[TECH][grain]))


def network_table(cell_hours: DataFrame, grain: str) -> DataFrame:
    return network_kpis(network_groups(cell_hours, grain), grain)


def network_tables(cell_hours: DataFrame, grains: tuple[str, ...] | None = None) -> DataFrame:
    """Several grains under each other, told apart by ``grain``."""
    groups = by_grains(cell_hours, spec.NETWORK.of_partials(), TECH, grains)
    keys = [k for k in ALL_KEYS[TECH] if k in groups.columns]
    return text_times(with_kpis(groups, spec.NETWORK, spec.NETWORK_KPIS, ["grain", *keys]))


def operator_hours(operator: DataFrame) -> DataFrame:
    """One partial per hour and cell; each operator has counters of its own."""
    return operator.groupBy("hour_ts", *catalog.KEYS[TECH]).agg(*spec.OPERATOR.of_rows())


def operator_groups(hours: DataFrame, grain: str) -> DataFrame:
    """Groups of both operators at once."""
    aggregates = spec.OPERATOR.of_partials()
    if grain == "day":
        return days_of(operator_groups(hours, "hour"), aggregates)
    return by_grain(hours, aggregates, TECH, grain)


def operator_kpis(groups: DataFrame, grain: str, slice_name: str) -> DataFrame:
    return text_times(with_kpis(groups, spec.OPERATOR, spec.operator_kpis(slice_name), GRAINS[TECH][grain]))


def operator_table(operator: DataFrame, grain: str, slice_name: str) -> DataFrame:
    """KPIs of one operator, from the rows of the report."""
    return operator_kpis(by_grain(operator, spec.OPERATOR.of_rows(), TECH, grain), grain, slice_name)


def summary(days: summary_rows.SliceTables) -> DataFrame:
    return summary_rows.before_after(
        TECH, days, spec.SUMMARY_ROWS, spec.NETWORK_KPIS, spec.SHARED_ROWS, spec.NETWORK_ONLY_ROWS
    )


def day_tables(cell_hours: DataFrame, operator: DataFrame) -> summary_rows.SliceTables:
    return {
        "ALL": network_table(cell_hours, "day"),
        "A": operator_table(operator, "day", "A"),
        "B": operator_table(operator, "day", "B"),
    }


def kpis_of(slice_name: str) -> Sequence[Kpi]:
    return spec.NETWORK_KPIS if slice_name == "ALL" else spec.operator_kpis(slice_name)


def write_report(
    spark: SparkSession,
    reports: UmtsReports,
    out: str,
    format: str = "parquet",
    labels: bool = False,
    mode: str = "error",
    staging: str | None = None,
    drop_unmatched: bool = False,
) -> None:
    """Write all tables under ``out``; see the LTE report for staging, ``mode`` and ``drop_unmatched``."""
    with settled(spark), Stage(spark, staging) as stage:
        network_reports = {"umts_daily": reports.daily, "umts_daily1": reports.daily1}
        used_twice = list(network_reports) if drop_unmatched and reports.checks else []
        read, rejected = split_reads(stage, {**network_reports, "umts_operator": reports.operator}, used_twice)
        inputs = {
            "cells": cells(read["umts_daily"], read["umts_daily1"], drop_unmatched),
            "operator": operator_hours(read["umts_operator"]),
        }
        staged = staged_inputs(stage, inputs, reports.checks, TECH)
        network = stage_groups(
            stage,
            "network",
            partial(network_groups, staged["cells"]),
            lambda hours: days_of(hours, spec.NETWORK.of_partials()),
        )
        own = stage_groups(
            stage,
            "own",
            partial(operator_groups, staged["operator"]),
            lambda hours: days_of(hours, spec.OPERATOR.of_partials()),
        )

        def table(slice_name: str, grain: str) -> DataFrame:
            if slice_name == "ALL":
                return network_kpis(network[grain], grain)
            return operator_kpis(own[grain], grain, slice_name)

        def write(slice_name: str, grain: str) -> None:
            write_table(table(slice_name, grain), out, TECH, slice_name, grain, kpis_of(slice_name), format, labels, mode)

        details = [partial(write, s, g) for s in SLICE_NAMES for g in GRAINS[TECH]]
        quality = partial(write_quality, staged["quality"], out, TECH, format, mode)
        if rejected is not None:
            details.append(partial(write_rejects, rejected, out, TECH, format, mode))
        if mode == "update":  # the summary is about all days that are there now
            run_together([*details, quality])
            days = {s: read_back(spark, out, TECH, s, "day", kpis_of(s), format, labels).drop("day") for s in SLICE_NAMES}
            write_summary(summary(days), out, TECH, format, mode)
        else:
            days = {s: table(s, "day") for s in SLICE_NAMES}
            run_together([*details, quality, partial(write_summary, summary(days), out, TECH, format, mode)])
