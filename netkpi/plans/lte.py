"""The LTE report: four exports in, twelve detail tables and a summary out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from netkpi.operators import summary as summary_rows
from netkpi.operators.grains import ALL_KEYS, GRAINS, by_grain, by_grains, days_of, hours_of, text_times
from netkpi.operators.joins import join_reports
from netkpi.operators.kpis import Kpi, with_kpis
from netkpi.operators.slices import only_slice, with_slice
from netkpi.operators.snapshots import cell_integrity, cell_integrity_of_tables
from netkpi.plans import lte_kpis as spec
from netkpi.plans.writing import settled, split_reads, stage_groups, staged_inputs
from netkpi.sinks.tables import SLICE_NAMES, read_back, run_together, write_quality, write_rejects, write_summary, write_table
from netkpi.sources import catalog
from netkpi.sources.reports import ReadCheck, read_report
from netkpi.sources.staging import Stage

TECH = "lte"


@dataclass(frozen=True)
class LteReports:
    """The four clean reports."""

    daily: DataFrame
    daily1: DataFrame
    emtc: DataFrame
    operator: DataFrame
    checks: tuple[ReadCheck, ...] = ()  # of the files they come from


def read_reports(spark: SparkSession, daily: str, daily1: str, emtc: str, operator: str, **options) -> LteReports:
    """Reports from CSV exports; their files are checked when :func:`write_report` has read them."""
    checks: list[ReadCheck] = []
    parts = [
        read_report(spark, report, paths, checks=checks, **options)
        for report, paths in (
            (catalog.LTE_DAILY, daily),
            (catalog.LTE_DAILY1, daily1),
            (catalog.LTE_EMTC, emtc),
            (catalog.LTE_OPERATOR, operator),
        )
    ]
    return LteReports(*parts, checks=tuple(checks))


def cells(
    daily: DataFrame, daily1: DataFrame, emtc: DataFrame, everything: bool = False, drop_unmatched: bool = False
) -> DataFrame:
    """The three network reports joined: one partial per hour and cell, of what the KPIs read (or of all)."""
    measures = (spec.DAILY, spec.DAILY1, spec.EMTC) if everything else spec.READ
    return join_reports(list(zip((daily, daily1, emtc), measures, strict=True)), catalog.KEYS[TECH], drop_unmatched)


def network_groups(cell_hours: DataFrame, grain: str) -> DataFrame:
    aggregates = spec.NETWORK_READ.of_partials()
    if grain == "day":
        return days_of(network_groups(cell_hours, "hour"), aggregates)
    return by_grain(cell_hours, aggregates, TECH, grain)


def network_kpis(groups: DataFrame, grain: str) -> DataFrame:
    return text_times(with_kpis(groups, spec.NETWORK_READ, spec.NETWORK_KPIS, GRAINS[TECH][grain]))


def network_table(cell_hours: DataFrame, grain: str) -> DataFrame:
    return network_kpis(network_groups(cell_hours, grain), grain)


def network_tables(cell_hours: DataFrame, grains: tuple[str, ...] | None = None) -> DataFrame:
    """Several grains under each other, told apart by ``grain``."""
    groups = by_grains(cell_hours, spec.NETWORK_READ.of_partials(), TECH, grains)
    keys = [k for k in ALL_KEYS[TECH] if k in groups.columns]
    return text_times(with_kpis(groups, spec.NETWORK_READ, spec.NETWORK_KPIS, ["grain", *keys]))


def operator_hours(operator: DataFrame) -> DataFrame:
    """One partial per hour, cell and slice."""
    return with_slice(operator).groupBy("hour_ts", *catalog.KEYS[TECH], "slice").agg(*spec.OPERATOR_READ.of_rows())


def operator_groups(hours: DataFrame, grain: str) -> DataFrame:
    """Groups of all slices at once."""
    aggregates = spec.OPERATOR_READ.of_partials()
    if grain == "day":
        return days_of(operator_groups(hours, "hour"), aggregates, ["slice"])
    return by_grain(hours, aggregates, TECH, grain, ["slice"])


def operator_kpis(own: DataFrame, network: DataFrame, grain: str) -> DataFrame:
    """KPIs of one operator from its groups and those of the network."""
    keys = GRAINS[TECH][grain]
    both = own.join(network.select(*keys, *spec.SHARED.columns()), list(keys))
    return text_times(with_kpis(both, spec.OPERATOR_READ + spec.SHARED, spec.OPERATOR_KPIS, keys))


def operator_table(cell_hours: DataFrame, operator: DataFrame, grain: str, slice_name: str) -> DataFrame:
    """KPIs of one operator, from the rows per operator. Both sides are grouped by the keys of the
    join, so the join itself shuffles nothing, and each side has one row per key."""
    own = by_grain(only_slice(operator, slice_name), spec.OPERATOR_READ.of_rows(), TECH, grain)
    shared = by_grain(cell_hours, spec.SHARED.of_partials(), TECH, grain)
    return operator_kpis(own, shared, grain)


def summary(integrity: DataFrame, days: summary_rows.SliceTables) -> DataFrame:
    """``integrity`` is the one-row result of ``cell_integrity``."""
    return summary_rows.before_after(
        TECH,
        days,
        spec.SUMMARY_ROWS,
        spec.NETWORK_KPIS,
        spec.SHARED_ROWS,
        spec.NETWORK_ONLY_ROWS,
        integrity,
    )


def day_tables(cell_hours: DataFrame, operator: DataFrame) -> summary_rows.SliceTables:
    return {
        "ALL": network_table(cell_hours, "day"),
        "A": operator_table(cell_hours, operator, "day", "A"),
        "B": operator_table(cell_hours, operator, "day", "B"),
    }


def kpis_of(slice_name: str) -> Sequence[Kpi]:
    return spec.NETWORK_KPIS if slice_name == "ALL" else spec.OPERATOR_KPIS


def write_report(
    spark: SparkSession,
    reports: LteReports,
    out: str,
    format: str = "parquet",
    labels: bool = False,
    mode: str = "error",
    staging: str | None = None,
    drop_unmatched: bool = False,
) -> None:
    """Write all tables under ``out``. ``drop_unmatched`` as in :func:`~netkpi.operators.joins.join_reports`.

    The joined cells and the sums per operator are written once to the staging folder, then one
    aggregate per grain of each (days from hours); all tables of a grain are made from these. A lost
    executor never sends the job back to the CSV files. If a table fails, the staged tables are kept:
    called again with their folder as ``staging`` and ``mode="resume"``, only what is missing is written.

    With ``mode="update"`` the reports hold some days only: these are replaced in the tables that are there, or added to them,
    and the summary is made anew from the day tables. A day without rows in a table stays as it is there. If it fails, run it again.
    """
    with settled(spark), Stage(spark, staging) as stage:
        network_reports = {"lte_daily": reports.daily, "lte_daily1": reports.daily1, "lte_emtc": reports.emtc}
        used_twice = list(network_reports) if drop_unmatched and reports.checks else []
        read, rejected = split_reads(stage, {**network_reports, "lte_operator": reports.operator}, used_twice)
        inputs = {
            "cells": cells(read["lte_daily"], read["lte_daily1"], read["lte_emtc"], drop_unmatched=drop_unmatched),
            "operator": operator_hours(read["lte_operator"]),
        }
        staged = staged_inputs(stage, inputs, reports.checks, TECH)
        cell_hours, operator = staged["cells"], staged["operator"]
        network = stage_groups(
            stage,
            "network",
            partial(network_groups, cell_hours),
            lambda hours: days_of(hours, spec.NETWORK_READ.of_partials()),
        )
        own = stage_groups(
            stage,
            "own",
            partial(operator_groups, operator),
            lambda hours: days_of(hours, spec.OPERATOR_READ.of_partials(), ["slice"]),
        )

        def table(slice_name: str, grain: str) -> DataFrame:
            if slice_name == "ALL":
                return network_kpis(network[grain], grain)
            return operator_kpis(only_slice(own[grain], slice_name), network[grain], grain)

        def write(slice_name: str, grain: str) -> None:
            write_table(table(slice_name, grain), out, TECH, slice_name, grain, kpis_of(slice_name), format, labels, mode)

        details = [partial(write, s, g) for s in SLICE_NAMES for g in GRAINS[TECH]]
        quality = partial(write_quality, staged["quality"], out, TECH, format, mode)
        if rejected is not None:
            details.append(partial(write_rejects, rejected, out, TECH, format, mode))
        if mode == "update":  # the summary is about all days that are there now
            run_together([*details, quality])

            def back(slice_name: str, grain: str) -> DataFrame:
                return read_back(spark, out, TECH, slice_name, grain, kpis_of(slice_name), format, labels)

            days = {s: back(s, "day").drop("day") for s in SLICE_NAMES}
            integrity = cell_integrity_of_tables(back("ALL", "hour"), back("ALL", "cell_hour"))
            write_summary(summary(integrity, days), out, TECH, format, mode)
        else:
            days = {s: table(s, "day") for s in SLICE_NAMES}
            hours = hours_of(network["hour"])
            lines = summary(cell_integrity(cell_hours, hours=hours), days)
            run_together([*details, quality, partial(write_summary, lines, out, TECH, format, mode)])
