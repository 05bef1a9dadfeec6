"""CSV exports in, detail tables out."""

from __future__ import annotations

import datetime as dt

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from netkpi.__main__ import arguments, main
from netkpi.operators.grains import GRAINS
from netkpi.plans import lte, lte_kpis, umts, umts_kpis
from netkpi.plans.registered import all_queries, write_exports
from netkpi.plans.writing import SETTINGS, settled, split_reads
from netkpi.sinks.tables import read_table, write_table
from netkpi.sources import adapters, catalog, reports
from netkpi.sources.reports import line_counts, read_report, read_text, rejects
from netkpi.sources.staging import Stage
from tests.conftest import SF_DIR
from tests.helpers import write_export

EMTC = [c.label for c in catalog.LTE_EMTC.counters]
NAMES = ["Start Time", "Period", "NE Name", "Cell", *EMTC]
CELL = "eNodeB Function Name=E1, Local Cell ID=1, Cell Name=CELL_A, eNodeB ID=5"


def _read(spark, path, **options):
    rows = read_report(spark, catalog.LTE_EMTC, str(path), **options).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_cells_of_an_export(spark, tmp_path):
    write_export(
        tmp_path / "a.csv",
        NAMES,
        [
            ["2021-01-29 13:30", "60", "NE1", CELL, "NIL", ""],
            ["2021-01-29 14:00", "60", "NA", "bad cell", "1.5", "2"],
            ["", "60", "NE1", CELL, "7", "7"],
        ],
    )
    assert _read(spark, tmp_path / "a.csv") == [
        (dt.datetime(2021, 1, 29, 13), "NE1", "CELL_A", 0.0, None),
        (dt.datetime(2021, 1, 29, 14), None, None, 1.5, 2.0),
    ]


def test_several_files_and_column_orders(spark, tmp_path):
    write_export(tmp_path / "x1.csv", NAMES, [["2021-01-29 13:00", "60", "NE1", CELL, "1", "2"]])
    write_export(tmp_path / "x2.csv", NAMES, [["2021-01-29 14:00", "60", "NE1", CELL, "3", "4"]])
    swapped = [*NAMES[:4], EMTC[1], EMTC[0], "Extra"]
    write_export(tmp_path / "y.csv", swapped, [["2021-01-29 15:00", "60", "NE1", CELL, "6", "5", "x"]])
    assert [r[3:] for r in _read(spark, tmp_path / "x*.csv")] == [(1.0, 2.0), (3.0, 4.0)]
    both = read_report(spark, catalog.LTE_EMTC, [str(tmp_path / "x*.csv"), str(tmp_path / "y.csv")])
    assert sorted(tuple(r)[3:] for r in both.collect()) == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]


def test_rejects_are_written_beside_the_tables(spark, tmp_path):
    """Lenient: each report is read once into one table, of which rows and rejects are parts."""
    argv = _exports(spark, tmp_path, "umts")
    operator = next((tmp_path / "umts_operator").glob("part-*"))
    lines = operator.read_text().splitlines()
    names, first, second = lines[7].split(","), lines[8], lines[9]
    cells = first.split('","')
    junk = '","'.join([*cells[:-1], '2f"'])
    bad = [first[: first.rindex(",")], junk, '"yesterday' + second[second.index('","') :], ""]
    operator = operator.with_name("part-bad.csv")
    operator.write_text("\n".join([*lines[:8], *bad]) + "\n")
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="missing or additional|not a number|cannot read"):
        main([*argv, "--out", str(tmp_path / "strict")])
    main([*argv, "--out", out, "--lenient"])
    found = spark.read.parquet(f"{out}/umts/rejects").collect()
    assert {(r.report, r.reason, r.columns) for r in found} == {
        ("umts_operator", "missing or additional cells", None),
        ("umts_operator", "not a number", names[-1]),
        ("umts_operator", "start time", None),
    }
    assert {r.line for r in found} == set(bad[:3]) and all(r.file.endswith(operator.name) for r in found)
    quality = {(r.report, r.measure): r.n for r in spark.read.parquet(f"{out}/umts/quality").collect()}
    assert quality["umts_operator", "damaged"] == 1 and quality["umts_operator", "junk_cells"] == 1


def test_files_of_one_pattern_must_share_the_header(spark, tmp_path):
    write_export(tmp_path / "a.csv", NAMES, [["2021-01-29 13:00", "60", "NE1", CELL, "1", "2"]])
    swapped = [*NAMES[:4], EMTC[1], EMTC[0]]
    write_export(tmp_path / "b.csv", swapped, [["2021-01-29 14:00", "60", "NE1", CELL, "4", "3"]])
    with pytest.raises(Exception, match="different headers"):
        _read(spark, tmp_path / "*.csv")


def test_bad_exports(spark, tmp_path):
    write_export(tmp_path / "missing.csv", NAMES[:-1], [["2021-01-29 13:00", "60", "NE1", CELL, "1"]])
    with pytest.raises(ValueError, match="eMTC.bits.UL"):
        _read(spark, tmp_path / "missing.csv")
    write_export(tmp_path / "time.csv", NAMES, [["yesterday", "60", "NE1", CELL, "1", "2"]])
    with pytest.raises(Exception, match="cannot read start time: yesterday"):
        _read(spark, tmp_path / "time.csv")
    (tmp_path / "short.csv").write_text("one line\n")
    with pytest.raises(ValueError, match="no header"):
        _read(spark, tmp_path / "short.csv")


def test_junk_rows(spark, tmp_path):
    rows = [["2021-01-29 13:00", "60", "NE1", CELL, "oops", "2"], ["2021-01-29 14:00", "60", "NE1", CELL, "1", "NIL"]]
    write_export(tmp_path / "a.csv", NAMES, rows)
    with pytest.raises(Exception, match="not a number: oops"):
        _read(spark, tmp_path / "a.csv")
    assert [r[3:] for r in _read(spark, tmp_path / "a.csv", strict=False)] == [(None, 2.0), (1.0, 0.0)]
    lines = read_text(spark, str(tmp_path / "a.csv"))
    [bad] = rejects(read_report(spark, catalog.LTE_EMTC, str(tmp_path / "a.csv"), with_rejects=True), "r").collect()
    assert (bad.report, bad.reason, bad.columns) == ("r", "not a number", EMTC[0])
    [counts] = line_counts(lines, catalog.LTE_EMTC).collect()
    assert tuple(counts)[1:] == (10, 1, 7, 0, 0, 0, 1)


@pytest.mark.parametrize("junk", ["1d", "2f", "0x10", "0x1p3", "1e", "--1", "1,5"])
def test_junk_numbers(spark, tmp_path, junk):
    write_export(tmp_path / "a.csv", NAMES, [["2021-01-29 13:00", "60", "NE1", CELL, junk, "2"]])
    with pytest.raises(Exception, match="not a number"):
        _read(spark, tmp_path / "a.csv")


def _awkward(path, preamble, rows):
    path.write_text("\n".join([*preamble, ",".join(NAMES), *rows]) + "\n")


GOOD = '2021-01-29 13:00,60,NE1,"' + CELL + '",1,2'


def test_preambles_that_look_like_data(spark, tmp_path):
    """Whatever stands on the first seven lines is preamble: rows, headers, lines as wide as a row."""
    for n, wide in enumerate((GOOD, ",".join(NAMES), ",60,NE1,x,1,2", "yesterday,a,b,c,d,e", ",,,,,", '"')):
        preamble = ["", "2021-02-01 10:00,a", "Start Time,2021-01-29 00:00", wide, "Query,by,user,admin,x", "", wide]
        _awkward(tmp_path / f"{n}.csv", preamble, [GOOD])
    assert [r[3:] for r in _read(spark, tmp_path / "*.csv")] == [(1.0, 2.0)] * 6


def _timed(path, *times):
    write_export(path, NAMES, [[t, "60", "NE1", CELL, "1", "2"] for t in times])


def test_each_file_tells_the_order_of_day_and_month(spark, tmp_path):
    _timed(tmp_path / "day.csv", "01/02/2021 05:00", "13/02/2021 06:00", "30-01-2021 07:00")
    _timed(tmp_path / "month.csv", "01/02/2021 05:00", "01/13/2021 1:00 PM")
    _timed(tmp_path / "equal.csv", "03/03/2021 05:00", "04/04/2021 05:00")
    _timed(tmp_path / "iso.csv", "2021-05-06 07:00", "2021/05/07 08:00")
    _timed(tmp_path / "empty.csv")
    found = [r[0] for r in _read(spark, tmp_path / "*.csv", day_first=None)]
    assert sorted(found) == [
        dt.datetime(2021, 1, 2, 5),
        dt.datetime(2021, 1, 13, 13),
        dt.datetime(2021, 1, 30, 7),
        dt.datetime(2021, 2, 1, 5),
        dt.datetime(2021, 2, 13, 6),
        dt.datetime(2021, 3, 3, 5),
        dt.datetime(2021, 4, 4, 5),
        dt.datetime(2021, 5, 6, 7),
        dt.datetime(2021, 5, 7, 8),
    ]


def test_files_that_do_not_tell_their_order_fail(spark, tmp_path):
    _timed(tmp_path / "both.csv", "13/02/2021 05:00", "02/13/2021 05:00")
    with pytest.raises(Exception, match="both.csv.*day first and with the month first"):
        _read(spark, tmp_path / "both.csv", day_first=None)
    _timed(tmp_path / "unsure.csv", "01/02/2021 05:00", "03/03/2021 05:00")
    with pytest.raises(Exception, match="unsure.csv.*say which"):
        _read(spark, tmp_path / "unsure.csv", day_first=None)
    # a time that neither order can read decides nothing: it is a reject
    _timed(tmp_path / "junk.csv", "31/01/2021 05:00", "02/31/20210 05:00", "13/29/2021 05:00", "00/13/2021 05:00")
    rows = read_report(spark, catalog.LTE_EMTC, str(tmp_path / "junk.csv"), day_first=None, with_rejects=True)
    assert [r.hour_ts for r in rows.where("hour_ts IS NOT NULL").collect()] == [dt.datetime(2021, 1, 31, 5)]
    assert rejects(rows, "r").count() == 3


def test_day_order_of_the_command_line():
    given = ["lte", "--daily", "a", "--daily1", "b", "--emtc", "c", "--operator", "d", "--out", "o"]
    assert arguments().parse_args([*given, "--day-order-by-file"]).day_order_by_file
    with pytest.raises(SystemExit):
        arguments().parse_args([*given, "--day-order-by-file", "--day-first"])


WIDE = ",60,NE1,x,1,2"  # as wide as a row, with a blank start time
DAMAGED = GOOD.rsplit(",", 1)[0]


@pytest.mark.parametrize(
    ("name", "preamble", "rows", "said"),
    [
        ("long.csv", ["x"] * 7, [GOOD, GOOD + ",3"], "missing or additional cells"),
        ("short.csv", ["x"] * 7, [GOOD, DAMAGED], "missing or additional cells"),
        ("wide preamble and short.csv", ["x"] * 6 + [WIDE], [GOOD, DAMAGED, GOOD], "missing or additional cells"),
        ("wide preamble and long.csv", [GOOD] + ["x"] * 6, [GOOD, GOOD + ","], "missing or additional cells"),
        ("two headers.csv", ["x"] * 7, [",".join(NAMES), GOOD], "header"),
        ("late header.csv", ["x"] * 8, [GOOD], "header"),
        ("early header.csv", ["x"] * 6, [GOOD], "header"),
    ],
)
def test_damage_fails_with_the_name_of_the_file(spark, tmp_path, name, preamble, rows, said):
    _awkward(tmp_path / "0 good.csv", ["x"] * 7, [GOOD])
    _awkward(tmp_path / name, preamble, rows)
    with pytest.raises(Exception, match=f"{name.replace(' ', '(?: |%20)')}.*{said}"):
        _read(spark, tmp_path / "*.csv")


def test_a_file_without_header_fails_by_name(spark, tmp_path):
    _awkward(tmp_path / "a.csv", ["x"] * 7, [GOOD])
    (tmp_path / "b.csv").write_text("x\n" * 7)
    with pytest.raises(Exception, match="b.csv: no header on line 8"):
        _read(spark, tmp_path / "*.csv")


def test_blank_lines_after_the_header_are_passed_over(spark, tmp_path):
    _awkward(tmp_path / "a.csv", ["x"] * 7, [GOOD, "", GOOD, "   "])
    assert [r[3:] for r in _read(spark, tmp_path / "a.csv")] == [(1.0, 2.0)] * 2


@pytest.mark.parametrize("most", [10, 0])
def test_many_files_and_splits(spark, tmp_path, monkeypatch, most):
    """Several files in a task, and files of several splits; the first lines broadcast or joined by shuffle."""
    monkeypatch.setattr(reports, "MOST_BROADCAST_FILES", most)
    for n in range(9):
        many = [GOOD.replace(",1,2", f",{n},{i}") for i in range(200 if n % 2 else 2)]
        _awkward(tmp_path / f"{n}.csv", [GOOD, "x", WIDE, "", *"abc"], many)
    want = sorted((float(n), float(i)) for n in range(9) for i in range(200 if n % 2 else 2))
    for size in ("2k", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert sorted(r[3:] for r in _read(spark, tmp_path / "*.csv")) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_parsed_once(spark, tmp_path):
    _awkward(tmp_path / "a.csv", ["x"] * 7, [GOOD])
    plan = read_report(spark, catalog.LTE_EMTC, str(tmp_path / "a.csv"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 1


def test_counts_in_the_same_pass(spark, tmp_path):
    late = GOOD.replace("2021-01-29 13:00", "")
    _awkward(tmp_path / "a.csv", ["x"] * 7, [GOOD, late, GOOD.replace(",1,2", ",1d,2")])
    _awkward(tmp_path / "b.csv", ["x"] * 7, [GOOD])
    checks = []
    rows = read_report(spark, catalog.LTE_EMTC, str(tmp_path / "*.csv"), strict=False, checks=checks)
    assert rows.count() == 3
    want = {"n_lines": 20, "headers": 2, "preamble": 14, "blank": 0, "without_time": 1, "damaged": 0, "junk_cells": 1}
    assert checks[0].counts() == want
    assert checks[0].counts(observed=False) == want


@pytest.mark.parametrize("folder", ["with blank", "100%", "a%20b", "in [brackets]", "{curly}"])
def test_awkward_paths(spark, tmp_path, folder):
    (tmp_path / folder).mkdir()
    write_export(tmp_path / folder / "LTE Daily.csv", NAMES, [["2021-01-29 13:00", "60", "NE1", CELL, "1", "2"]])
    plain = "".join("\\" + c if c in "[]{}" else c for c in str(tmp_path / folder))
    assert [r[3:] for r in _read(spark, plain + "/*.csv")] == [(1.0, 2.0)]


@pytest.mark.parametrize("label", ["BSC6910UCell", "BSC6900UCell"])
def test_both_controller_types(spark, tmp_path, label):
    counters = [c.label for c in catalog.UMTS_DAILY1.counters]
    names = ["Start Time", "Period", "NE Name", label, *counters]
    row = ["01/29/2021 13:00", "60", "RNC", "Label=SITE1_2, CellID=4711, LogicRNCID=3", *"123456"]
    write_export(tmp_path / "u.csv", names, [row])
    [r] = read_report(spark, catalog.UMTS_DAILY1, str(tmp_path / "u.csv")).collect()
    assert tuple(r) == (dt.datetime(2021, 1, 29, 13), "SITE1", "SITE1_2", "4711", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)


def test_unused_counters_may_be_missing(spark, tmp_path):
    used = [c.label for c in catalog.UMTS_OPERATOR.counters if "PLMN3" not in c.name]
    names = ["Start Time", "Period", "NE Name", "BSC6910UCell", *used]
    write_export(tmp_path / "u.csv", names, [["2021-01-29 13:00", "60", "R", "Label=S_1, CellID=1", *"123456789"]])
    [r] = read_report(spark, catalog.UMTS_OPERATOR, str(tmp_path / "u.csv")).collect()
    assert r.vs_psload_ulthruput_mocn_plmn3 is None
    assert r.vs_cs_erlang_equiv_mocn_plmn2 == 9.0


def _exports(spark, folder, tech):
    rows = adapters.measurements(spark, SF_DIR)
    names = {"lte_daily": "daily", "lte_daily1": "daily1", "lte_emtc": "emtc", "lte_operator": "operator"}
    names |= {"umts_daily": "daily", "umts_daily1": "daily1", "umts_operator": "operator"}
    argv = [tech]
    for report in catalog.REPORTS.values():
        if report.tech == tech:
            path = f"{folder}/{report.name}"
            write_exports(adapters.text_report(rows, report), path)
            argv += [f"--{names[report.name]}", f"{path}/part-*"]
    return argv


def test_lte_command_line(spark, tmp_path):
    """Exports in, all tables out; each table equals the query over the same rows."""
    out = str(tmp_path / "out")
    main([*_exports(spark, tmp_path, "lte"), "--out", out])
    queries = all_queries()
    for grain, keys in GRAINS["lte"].items():
        for slice_name, query in [("ALL", f"lte_kpi_{grain}"), ("A", f"lte_plmn_{grain}_a"), ("B", f"lte_plmn_{grain}_b")]:
            if grain in ("cell", "hour") and slice_name != "ALL":
                continue  # the other tables cover these paths
            written = read_table(spark, out, "lte", slice_name, grain)
            kpis = lte_kpis.NETWORK_KPIS
            assert written.columns == [*keys, *[k.column for k in kpis]]
            assert sorted(map(repr, written.collect())) == sorted(map(repr, queries[query](spark, SF_DIR).collect()))
    days = spark.read.parquet(f"{out}/lte/detail/slice=ALL/grain=day").select("date", "day").collect()
    assert len({r.date for r in days}) == len(days) > 20 and all(str(r.day) == r.date for r in days)
    summary = spark.read.parquet(f"{out}/lte/summary").collect()
    assert [r.position for r in summary] == list(range(1, 26))
    quality = {(r.report, r.measure): r.n for r in spark.read.parquet(f"{out}/lte/quality").collect()}
    assert quality["lte_emtc", "preamble"] == 7 * quality["lte_emtc", "headers"] > 0
    assert quality["lte_operator", "without_time"] == 0 and quality["lte", "repeated_keys"] >= 0
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        main([*_exports(spark, tmp_path / "again", "lte"), "--out", out])


def test_umts_command_line_csv_with_labels(spark, tmp_path):
    out = str(tmp_path / "out")
    main([*_exports(spark, tmp_path, "umts"), "--out", out, "--format", "csv", "--labels"])
    table = spark.read.csv(f"{out}/umts/detail/slice=ALL/grain=cell", header=True).drop("day")
    assert table.columns == ["Date", "Site", "Cell", "CellID", *[k.label for k in umts_kpis.NETWORK_KPIS]]
    written = sorted(tuple(r) for r in table.collect())
    queries = all_queries()
    want = queries["umts_kpi_cell"](spark, SF_DIR).collect()
    assert written == sorted(tuple(None if v is None else str(v) for v in r) for r in want)
    whole = spark.read.csv(f"{out}/umts/detail/slice=B/grain=hour", header=True)
    assert whole.columns == ["Date", "Hour", *[k.label for k in umts_kpis.operator_kpis("B")], "day"]
    assert spark.read.csv(f"{out}/umts/summary", header=True).count() == 10


def _state(folder):
    """Data files of each day of each table."""
    found = {}
    for path in folder.rglob("part-*"):
        if path.parent.name.startswith("day="):
            found.setdefault(path.parent, set()).add((path.name, path.stat().st_mtime_ns))
    return found


def test_a_day_is_added_and_replaced(spark, tmp_path):
    """One more day changes that day's folders only; the tables and the summary are those of all days."""
    reports = [adapters.clean_report(adapters.measurements(spark, SF_DIR), r) for r in (catalog.UMTS_DAILY, catalog.UMTS_DAILY1, catalog.UMTS_OPERATOR)]
    *_, second_last, last = sorted({r.hour_ts.date() for r in reports[2].select("hour_ts").collect()})
    day = F.to_date("hour_ts")
    out, whole = tmp_path / "out", tmp_path / "whole"

    def write(path, keep, mode, factor=1):
        vs = [c for c in reports[2].columns if c.startswith("vs_")]
        parts = [r.where(keep) for r in reports]
        parts[2] = parts[2].withColumns({c: F.col(c) * factor for c in vs})
        umts.write_report(spark, umts.UmtsReports(*parts), str(path), "csv", labels=True, mode=mode)

    write(whole, day <= last, "error")
    write(out, day < last, "error")
    write(out, day == second_last, "update", factor=3)
    before = _state(out / "umts" / "detail")
    write(out, day == last, "update")
    after = _state(out / "umts" / "detail")
    assert {p.name for p in after.keys() - before.keys()} == {f"day={last}"} and before.keys() <= after.keys()
    assert all(after[p] == before[p] for p in before)
    write(out, day == second_last, "update")
    again = _state(out / "umts" / "detail")
    assert again.keys() == after.keys() and {p.name for p in after if after[p] != again[p]} == {f"day={second_last}"}
    for part in ("detail", "summary"):
        tables = [spark.read.csv(f"{p}/umts/{part}", header=True, recursiveFileLookup=True) for p in (out, whole)] if part == "summary" else [
            spark.read.csv(f"{p}/umts/detail/slice={s}/grain={g}", header=True) for p in (out, whole) for s, g in (("A", "hour"),)
        ]
        assert sorted(map(repr, tables[0].collect())) == sorted(map(repr, tables[1].collect()))
    with pytest.raises(ValueError, match="mode"):
        write(out, day == last, "append")


def test_tables_are_in_order_as_a_whole(spark, tmp_path):
    """Also a table that many tasks write: by day, file name and row."""
    rows = spark.range(20_000).selectExpr(
        "concat('2024-01-', lpad(id * 5 % 28 + 1, 2, '0')) AS date", "lpad(id * 13 % 24, 2, '0') AS hour",
        "concat('C', id * 7919 % 20000) AS cell_name", "CAST(id AS DOUBLE) AS k",
    ).repartition(7)
    kpi = lte_kpis.NETWORK_KPIS[:1]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that no tasks are put together
    try:
        write_table(rows.withColumnRenamed("k", kpi[0].column), str(tmp_path), "lte", "ALL", "cell_hour", kpi)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    folder = tmp_path / "lte" / "detail" / "slice=ALL" / "grain=cell_hour"
    files = sorted(folder.rglob("part-*.parquet"), key=lambda p: (p.parent.name, p.name))
    keys = [tuple(r.values()) for f in files for r in pq.read_table(f, columns=["date", "hour", "cell_name"], partitioning=None).to_pylist()]
    assert len(keys) == 20_000 and keys == sorted(keys)
    assert len({f.name.split("-")[1] for f in files}) > 1 and len(files) >= 28


def test_unmatched_rows_may_go_before_the_sums(spark, tmp_path):
    """The same tables, from exports that are parsed once; also if a run ended when these were read."""
    argv = _exports(spark, tmp_path, "umts")
    paths = dict(zip(argv[1::2], argv[2::2]))
    reports = umts.read_reports(spark, paths["--daily"], paths["--daily1"], paths["--operator"])
    parts = {"umts_daily": reports.daily, "umts_daily1": reports.daily1}
    stage = Stage(spark, str(tmp_path / "staged"))
    split_reads(stage, parts, list(parts))
    outs = [str(tmp_path / n) for n in ("all", "matched", "resumed")]
    main([*argv, "--out", outs[0]])
    main([*argv, "--out", outs[1], "--drop-unmatched"])
    main([*argv, "--out", outs[2], "--drop-unmatched", "--mode", "resume", "--staging", stage.folder])
    for table in ("detail/slice=ALL/grain=cell_hour", "detail/slice=B/grain=day", "summary", "quality"):
        want, *got = [sorted(map(repr, spark.read.parquet(f"{o}/umts/{table}").collect())) for o in outs]
        assert want and got == [want, want], table


def test_all_inputs_are_required():
    with pytest.raises(SystemExit):
        arguments().parse_args(["lte", "--daily", "a.csv", "--out", "x"])


def test_stage_goes_away(spark):
    with Stage(spark) as stage:
        table = stage.table(spark.range(5), "t")
        assert table.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{stage.folder}/t")


def test_a_failed_report_is_taken_up_again(spark, tmp_path):
    out = str(tmp_path / "out")
    argv = [*_exports(spark, tmp_path, "umts"), "--out", out]
    blocked = tmp_path / "out" / "umts" / "detail" / "slice=A" / "grain=cell"
    blocked.mkdir(parents=True)
    (blocked / "in the way").write_text("x")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists") as failed:
        main(argv)
    [note] = failed.value.__notes__
    staging = note.removeprefix("staged tables are kept in ")
    written = tmp_path / "out" / "umts" / "detail" / "slice=ALL" / "grain=cell"
    before = sorted((p.name, p.stat().st_mtime_ns) for p in written.iterdir())
    main([*argv, "--mode", "resume", "--staging", staging])
    assert sorted((p.name, p.stat().st_mtime_ns) for p in written.iterdir()) == before
    tables = sorted(str(p.parent) for p in (tmp_path / "out").rglob("_SUCCESS"))
    assert len(tables) == 14  # twelve tables, summary, quality
    again = read_table(spark, out, "umts", "A", "cell").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, all_queries()["umts_plmn_cell_a"](spark, SF_DIR).collect()))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{staging}/cells")
    main([*argv, "--mode", "overwrite"])


def test_passes_over_the_staged_data(spark, tmp_path, monkeypatch):
    """Cells and operator rows are read three times each, and nothing is copied for a grain."""
    read, plans = {"cells": 0, "operator": 0}, []
    write = Stage.table

    def table(self, df, name, partition_by=()):
        execution = df._jdf.queryExecution()
        plans.append(execution.toString())
        leaves = execution.optimizedPlan().collectLeaves()
        for i in range(leaves.size()):
            if "Relation" in leaves.apply(i).nodeName():
                path = leaves.apply(i).relation().location().rootPaths().apply(0).toString()
                for source in read:
                    read[source] += path.endswith(f"/{source}")
        return write(self, df, name, partition_by)

    monkeypatch.setattr(Stage, "table", table)
    out = str(tmp_path / "out")
    rows = adapters.measurements(spark, SF_DIR)
    names = ("lte_daily", "lte_daily1", "lte_emtc", "lte_operator")
    lte.write_report(spark, lte.LteReports(*[adapters.clean_report(rows, catalog.REPORTS[n]) for n in names]), out)
    assert read == {"cells": 4, "operator": 3}  # the fourth counts repeated keys, from one column
    assert not any("Expand" in p for p in plans)


def test_settings_hold_while_a_report_is_written(spark, tmp_path, monkeypatch):
    (name, value), seen = next(iter(SETTINGS.items())), []
    table = Stage.table
    monkeypatch.setattr(Stage, "table", lambda self, *args: seen.append(spark.conf.get(name)) or table(self, *args))
    rows = adapters.measurements(spark, SF_DIR).limit(50)
    names = ("umts_daily", "umts_daily1", "umts_operator")
    before = spark.conf.get(name)
    parts = [adapters.clean_report(rows, catalog.REPORTS[n]) for n in names]
    umts.write_report(spark, umts.UmtsReports(*parts), str(tmp_path / "out"))
    assert seen and set(seen) == {value} and spark.conf.get(name) == before
    spark.conf.set(name, "9000")  # the caller's own stays
    try:
        with settled(spark):
            assert spark.conf.get(name) == "9000"
        assert spark.conf.get(name) == "9000"
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("name", ["lte_daily", "lte_operator", "umts_daily"])
def test_reports_are_summed_after_their_narrow_rows_are_dealt(spark, name):
    report = catalog.REPORTS[name]
    rows = adapters.measurements(spark, SF_DIR)
    for df in (adapters.clean_report(rows, report), adapters.text_report(rows, report)):
        nodes = df._jdf.queryExecution().sparkPlan().toString().splitlines()
        dealt = [i for i, n in enumerate(nodes) if "Exchange hashpartitioning" in n]
        sums = [i for i, n in enumerate(nodes) if "Aggregate" in n]
        assert len(dealt) == 1 and dealt[0] > max(sums)  # the scan is last
        executed = df._jdf.queryExecution().executedPlan().toString()
        assert executed.count("Exchange hashpartitioning") == 1


def test_sums_of_a_report_do_not_depend_on_how_rows_are_dealt(spark):
    hour = dt.datetime(2024, 1, 1, 5)
    rows = [(hour, u, t, 100 * i, 7 * i) for i, (u, t) in enumerate([(1, "view"), (1, "view"), (None, "view"), (None, "click"), (1, "click"), (1, None)])]
    rows = spark.createDataFrame(rows, "h timestamp_ntz, u long, t string, x long, v long")
    for report in (catalog.LTE_EMTC, catalog.LTE_OPERATOR):
        once = adapters.clean_report(rows.coalesce(1), report, all_kinds=True).collect()
        many = adapters.clean_report(rows.repartition(5), report, all_kinds=True).collect()
        assert sorted(map(repr, once)) == sorted(map(repr, many))
        assert len(once) == (5 if report.per_operator_rows else 2)
