"""Queries over the test tables, one per operator of the engine.

Each takes the session and a folder with the tables. Reports are made from ``events``
by the adapters, so the work of every query grows with that table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netkpi.functions.labels import lte_cell_name, umts_cell
from netkpi.functions.numbers import counter_value, quoted
from netkpi.functions.times import parse_start_time, time_keys
from netkpi.operators.grains import GRAINS
from netkpi.operators.joins import duplicate_keys
from netkpi.operators.slices import with_slice
from netkpi.operators.snapshots import cell_integrity, first_last_rows
from netkpi.plans import lte, umts
from netkpi.sinks.tables import DAY, SLICE_NAMES
from netkpi.sources import adapters, catalog
from netkpi.sources.reports import PREAMBLE_LINES, line_counts, read_report, read_text, rejects
from netkpi.sources.staging import Stage

PREAMBLE = tuple(f"Preamble line {i + 1}" for i in range(PREAMBLE_LINES))

Query = Callable[[SparkSession, str], DataFrame]


def _clean(
    spark: SparkSession, sf_dir: str, report: catalog.Report, table: str = "events", all_kinds: bool = False
) -> DataFrame:
    return adapters.clean_report(adapters.measurements(spark, sf_dir, table), report, all_kinds)


def _text(spark: SparkSession, sf_dir: str, report: catalog.Report, all_kinds: bool = False) -> DataFrame:
    return adapters.text_report(adapters.measurements(spark, sf_dir), report, all_kinds)


def lte_cells(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    reports = (catalog.LTE_DAILY, catalog.LTE_DAILY1, catalog.LTE_EMTC)
    return lte.cells(*[_clean(spark, sf_dir, r, table) for r in reports])


def umts_cells(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    return umts.cells(*[_clean(spark, sf_dir, r, table) for r in (catalog.UMTS_DAILY, catalog.UMTS_DAILY1)])


def lte_operator(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    return _clean(spark, sf_dir, catalog.LTE_OPERATOR, table)


def umts_operator(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    return _clean(spark, sf_dir, catalog.UMTS_OPERATOR, table)


def _scratch(spark: SparkSession) -> str:
    """A folder for files that the returned DataFrame still reads; it goes with the session."""
    return Stage.of_session(spark).folder


def _with_text_times(rows: DataFrame) -> DataFrame:
    return rows.select(*[c.alias(n) for n, c in time_keys(F.col("hour_ts")).items()], "*").drop("hour_ts")


def _whole_counts(rows: DataFrame) -> DataFrame:
    """Counts of a partial as whole numbers."""
    counts = [c for c in rows.columns if c.startswith("n_") or c == "joined_rows"]
    return rows.withColumns({c: F.col(c).cast("bigint") for c in counts})


# --- cleaning -----------------------------------------------------------------


def nil_to_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _text(spark, sf_dir, catalog.LTE_DAILY1, all_kinds=True)
    counters = [f"{counter_value(c.label)} AS {c.column}" for c in catalog.LTE_DAILY1.counters]
    return rows.selectExpr("`Start Time` AS start_time", "Cell AS label", *counters)


def lte_cell_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _text(spark, sf_dir, catalog.LTE_EMTC, all_kinds=True)
    return rows.select(
        F.col("Start Time").alias("start_time"),
        F.col("Cell").alias("label"),
        lte_cell_name(F.col("Cell")).alias("cell_name"),
    )


def umts_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of two controller types, read together."""
    rows = _text(spark, sf_dir, catalog.UMTS_DAILY1, all_kinds=True).select("`Start Time`", "BSC6910UCell")
    newer = F.col("BSC6910UCell").rlike("[02468],|short")
    older = rows.filter(~newer).withColumnRenamed("BSC6910UCell", "BSC6900UCell")
    both = rows.filter(newer).unionByName(older, allowMissingColumns=True)
    label = F.coalesce("BSC6910UCell", "BSC6900UCell")
    parts = [expr.alias(name) for name, expr in umts_cell(label).items()]
    return both.select(F.col("Start Time").alias("start_time"), label.alias("label"), *parts)


def time_key_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start times in six spellings."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    spellings = (
        "yyyy-MM-dd HH:mm:ss",
        "yyyy/MM/dd HH:mm",
        "MM/dd/yyyy HH:mm",
        "MM/dd/yyyy hh:mm a",
        "dd-MMM-yyyy HH:mm",
        "yyyyMMdd HH:mm:ss",
    )
    spelling = F.col("event_id") % len(spellings)
    text = F.coalesce(*[F.when(spelling == i, F.date_format("ts", f)) for i, f in enumerate(spellings)])
    keys = time_keys(parse_start_time(text))
    return rows.select("event_id", *[expr.alias(name) for name, expr in keys.items()])


def operator_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_slice(lte_operator(spark, sf_dir))
    return _with_text_times(rows).select(
        "start_time", "ne_name", "cell_name", "slice", "l_traffic_user_avg_plmn", "l_thrp_bits_dl_plmn"
    )


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = duplicate_keys(_clean(spark, sf_dir, catalog.LTE_DAILY1, all_kinds=True), catalog.KEYS["lte"])
    return _with_text_times(rows).select("start_time", "ne_name", "cell_name", "n_rows")


# --- joins and snapshots ------------------------------------------------------


def _lte_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = (catalog.LTE_DAILY, catalog.LTE_DAILY1, catalog.LTE_EMTC)
    return lte.cells(*[_clean(spark, sf_dir, r) for r in reports], everything=True)


def lte_report_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_text_times(_whole_counts(_lte_join(spark, sf_dir))).drop("date", "hour")


def umts_report_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_text_times(_whole_counts(umts_cells(spark, sf_dir))).drop("date", "hour")


def lte_join_drop_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined report, with rows that have no partner left out before the sums."""
    reports = (catalog.LTE_DAILY, catalog.LTE_DAILY1, catalog.LTE_EMTC)
    cells = lte.cells(*[_clean(spark, sf_dir, r) for r in reports], everything=True, drop_unmatched=True)
    return _with_text_times(_whole_counts(cells)).drop("date", "hour")


def umts_join_drop_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = umts.cells(*[_clean(spark, sf_dir, r) for r in (catalog.UMTS_DAILY, catalog.UMTS_DAILY1)], drop_unmatched=True)
    return _with_text_times(_whole_counts(cells)).drop("date", "hour")


def _few_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined report with ten cell names: they repeat in each report, and from site to site."""
    name = F.concat(F.lit("C"), F.right("cell_name", F.lit(1)))
    reports = [_clean(spark, sf_dir, r) for r in (catalog.LTE_DAILY, catalog.LTE_DAILY1, catalog.LTE_EMTC)]
    return lte.cells(*[r.withColumn("cell_name", name) for r in reports])


def lte_join_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_text_times(_whole_counts(_few_names(spark, sf_dir)))
    return rows.select("start_time", "ne_name", "cell_name", "joined_rows", "l_thrp_bits_dl", "n_l_cell_avail_dur")


def lte_kpi_shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one name on several sites fall together at this grain."""
    return lte.network_table(_few_names(spark, sf_dir), "cell_hour")


def first_last_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _whole_counts(first_last_rows(_lte_join(spark, sf_dir)))
    return _with_text_times(rows).select(
        "moment", "start_time", "ne_name", "cell_name", "joined_rows", "l_thrp_bits_dl", "l_uecntx_normrel"
    )


def lte_cell_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_integrity(lte_cells(spark, sf_dir))


# --- KPI tables ---------------------------------------------------------------


def lte_kpi(grain: str) -> Query:
    return lambda spark, sf_dir: lte.network_table(lte_cells(spark, sf_dir), grain)


def umts_kpi(grain: str) -> Query:
    return lambda spark, sf_dir: umts.network_table(umts_cells(spark, sf_dir), grain)


def lte_plmn(grain: str, slice_name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lte.operator_table(lte_cells(spark, sf_dir), lte_operator(spark, sf_dir), grain, slice_name)

    return query


def umts_plmn(grain: str, slice_name: str) -> Query:
    return lambda spark, sf_dir: umts.operator_table(umts_operator(spark, sf_dir), grain, slice_name)


def lte_kpi_all_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lte.network_tables(lte_cells(spark, sf_dir))


def umts_kpi_all_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return umts.network_tables(umts_cells(spark, sf_dir))


def lte_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = lte_cells(spark, sf_dir)
    return lte.summary(cell_integrity(cells), lte.day_tables(cells, lte_operator(spark, sf_dir)))


def umts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return umts.summary(umts.day_tables(umts_cells(spark, sf_dir), umts_operator(spark, sf_dir)))


# --- files --------------------------------------------------------------------


def write_exports(rows: DataFrame, path: str, preamble: Sequence[str] = PREAMBLE) -> None:
    """Write text cells as exports: each partition becomes a file with preamble and header."""
    cells = [f"""concat('"', replace({quoted(n)}, '"', '""'), '"')""" for n in rows.columns]
    line = F.expr(f"array_join(array({', '.join(cells)}), ',', '')")
    top = [*preamble, ",".join(rows.columns)]

    def with_top(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("value", pa.string())])
        yield pa.RecordBatch.from_pydict({"value": top}, schema)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], schema=schema)

    rows.select(line.alias("value")).mapInArrow(with_top, "value string").write.text(path)


def _exported(spark: SparkSession, sf_dir: str, report: catalog.Report, folder: str) -> str:
    path = f"{folder}/{report.name}"
    write_exports(_text(spark, sf_dir, report), path)
    return f"{path}/part-*"


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-operator report through CSV files: every row, every counter."""
    path = _exported(spark, sf_dir, catalog.LTE_OPERATOR, _scratch(spark))
    return _with_text_times(read_report(spark, catalog.LTE_OPERATOR, path)).drop("date", "hour")


def csv_umts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _exported(spark, sf_dir, catalog.UMTS_OPERATOR, _scratch(spark))
    return _with_text_times(read_report(spark, catalog.UMTS_OPERATOR, path)).drop("date", "hour")


def csv_awkward_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preambles that look like data (one line is as wide as a row), in a folder with a blank and a percent sign in its name."""
    preamble = ["", "2021-02-01 10:00,a,b,c,5,6", "Start Time,2021-01-29 00:00", '"Query, by",user', ",,,,,,,,,,,,", ",,,,,", "x"]
    path = f"{_scratch(spark)}/export 100%20 [a]"
    write_exports(_text(spark, sf_dir, catalog.LTE_EMTC, all_kinds=True), path, preamble)
    pattern = f"{_scratch_pattern(path)}/part-*"
    return _with_text_times(read_report(spark, catalog.LTE_EMTC, pattern)).drop("date", "hour")


def csv_day_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the day first and files with the month first under one pattern; each tells its order by itself."""
    rows = _text(spark, sf_dir, catalog.LTE_EMTC, all_kinds=True)
    time = F.col("Start Time")
    year, month, day, clock = time.substr(1, 4), time.substr(6, 2), time.substr(9, 2), time.substr(11, 20)
    even = F.right("NE Name", F.lit(1)).cast("int") % 2 == 0
    folder = _scratch(spark)
    for name, taken, parts in (("day", even, (day, month)), ("month", ~even, (month, day))):
        spelled = F.concat(parts[0], F.lit("/"), parts[1], F.lit("/"), year, clock)
        write_exports(rows.where(taken).withColumn("Start Time", spelled), f"{folder}/orders-{name}")
    return _with_text_times(read_report(spark, catalog.LTE_EMTC, f"{folder}/orders-*/part-*", day_first=None)).drop("date", "hour")


def _scratch_pattern(path: str) -> str:
    return path.replace("[", "\\[").replace("]", "\\]")


def csv_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the source says it has left out: rows without a time, junk in a counter."""
    rows = _text(spark, sf_dir, catalog.LTE_EMTC, all_kinds=True)
    number = F.right("NE Name", F.lit(1))
    first = f"`{catalog.LTE_EMTC.counters[0].label}`"
    rows = rows.withColumn("Start Time", F.when(number != "3", F.col("Start Time")))
    rows = rows.withColumn(first.strip("`"), F.when(number == "4", F.lit("2f")).otherwise(F.col(first)))
    path = f"{_scratch(spark)}/{catalog.LTE_EMTC.name}"
    write_exports(rows, path)
    counts = line_counts(read_text(spark, f"{path}/part-*"), catalog.LTE_EMTC)
    return counts.agg(
        F.sum(F.col("n_lines") - F.col("preamble") - F.col("headers")).alias("n_rows"),
        F.sum(F.col("preamble") - PREAMBLE_LINES * F.col("headers") + F.col("blank") + F.col("damaged")).alias("more_not_data"),
        F.sum("without_time").alias("without_time"),
        F.sum("junk_cells").alias("junk_cells"),
    )


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lenient reading: rows without a readable time and rows with junk in a counter, by reason."""
    rows = _text(spark, sf_dir, catalog.LTE_EMTC, all_kinds=True)
    number = F.right("NE Name", F.lit(1))
    first = catalog.LTE_EMTC.counters[0].label
    rows = rows.withColumn("Start Time", F.when(number == "3", F.lit("yesterday")).otherwise(F.col("Start Time")))
    rows = rows.withColumn(first, F.when(number == "4", F.lit("2f")).otherwise(F.col(quoted(first))))
    folder = _scratch(spark)
    write_exports(rows, f"{folder}/{catalog.LTE_EMTC.name}")
    marked = read_report(spark, catalog.LTE_EMTC, f"{folder}/{catalog.LTE_EMTC.name}/part-*", with_rejects=True)
    marked.write.parquet(f"{folder}/read")
    read = spark.read.schema(marked.schema).parquet(f"{folder}/read")
    good = read.where("hour_ts IS NOT NULL").agg(F.lit("rows").alias("reason"), F.count("*").alias("n"))
    return rejects(read, catalog.LTE_EMTC.name).groupBy("reason").agg(F.count("*").alias("n")).unionByName(good)


def csv_lte_kpi_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day KPIs from CSV files of all three network reports."""
    folder = _scratch(spark)
    daily, daily1, emtc = (
        read_report(spark, r, _exported(spark, sf_dir, r, folder))
        for r in (catalog.LTE_DAILY, catalog.LTE_DAILY1, catalog.LTE_EMTC)
    )
    return lte.network_table(lte.cells(daily, daily1, emtc), "day")


def csv_umts_kpi_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day KPIs from CSV files of both network reports, 118 counters."""
    folder = _scratch(spark)
    daily, daily1 = (
        read_report(spark, r, _exported(spark, sf_dir, r, folder)) for r in (catalog.UMTS_DAILY, catalog.UMTS_DAILY1)
    )
    return umts.network_table(umts.cells(daily, daily1), "day")


def _write_lte(spark: SparkSession, sf_dir: str, out: str) -> None:
    reports = (catalog.LTE_DAILY, catalog.LTE_DAILY1, catalog.LTE_EMTC, catalog.LTE_OPERATOR)
    lte.write_report(spark, lte.LteReports(*[_clean(spark, sf_dir, r) for r in reports]), out)


def _write_umts(spark: SparkSession, sf_dir: str, out: str) -> None:
    reports = (catalog.UMTS_DAILY, catalog.UMTS_DAILY1, catalog.UMTS_OPERATOR)
    umts.write_report(spark, umts.UmtsReports(*[_clean(spark, sf_dir, r) for r in reports]), out)


def grain_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve written UMTS tables, read back as one."""
    out = _scratch(spark)
    _write_umts(spark, sf_dir, out)
    written = spark.read.option("mergeSchema", True).parquet(f"{out}/umts/detail")
    return written.groupBy("slice", "grain").agg(
        F.count("*").alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max("traffic_dl_volume_gb").alias("max_dl_gb"),
    )


def _all_details(spark: SparkSession, out: str, tech: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{out}/{tech}/detail").drop(DAY)


def lte_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve written LTE tables, every key and KPI."""
    out = _scratch(spark)
    _write_lte(spark, sf_dir, out)
    return _all_details(spark, out, "lte")


def umts_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve written UMTS tables, every key and KPI."""
    out = _scratch(spark)
    _write_umts(spark, sf_dir, out)
    return _all_details(spark, out, "umts")


def _by_day(write: Callable[..., None], tech: str, out: str, reports: Sequence[DataFrame]) -> None:
    """Write a report in three parts: the first half, the rest, and the day in the middle once more."""
    dates = reports[0].agg(F.min("hour_ts").cast("date").alias("a"), F.max("hour_ts").cast("date").alias("b"))
    middle = dates.select(F.date_add("a", (F.date_diff("b", "a") / 2).cast("int"))).first()[0]
    day = F.to_date("hour_ts")
    for part, mode in ((day <= middle, "error"), (day >= middle, "update"), (day == middle, "update")):
        write([r.where(part) for r in reports], out, mode)


def lte_report_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The LTE tables after later days were written into a written report: as if all had come at once."""
    out = _scratch(spark)
    reports = (catalog.LTE_DAILY, catalog.LTE_DAILY1, catalog.LTE_EMTC, catalog.LTE_OPERATOR)

    def write(parts: list[DataFrame], out: str, mode: str) -> None:
        lte.write_report(spark, lte.LteReports(*parts), out, mode=mode)

    _by_day(write, "lte", out, [_clean(spark, sf_dir, r) for r in reports])
    return _all_details(spark, out, "lte")


def lte_summary_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a report that was written in parts."""
    out = _scratch(spark)
    reports = (catalog.LTE_DAILY, catalog.LTE_DAILY1, catalog.LTE_EMTC, catalog.LTE_OPERATOR)

    def write(parts: list[DataFrame], out: str, mode: str) -> None:
        lte.write_report(spark, lte.LteReports(*parts), out, mode=mode)

    _by_day(write, "lte", out, [_clean(spark, sf_dir, r) for r in reports])
    return spark.read.parquet(f"{out}/lte/summary")


def umts_report_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _scratch(spark)
    reports = (catalog.UMTS_DAILY, catalog.UMTS_DAILY1, catalog.UMTS_OPERATOR)

    def write(parts: list[DataFrame], out: str, mode: str) -> None:
        umts.write_report(spark, umts.UmtsReports(*parts), out, mode=mode)

    _by_day(write, "umts", out, [_clean(spark, sf_dir, r) for r in reports])
    return _all_details(spark, out, "umts")


def summary_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written summaries of both technologies."""
    out = _scratch(spark)
    _write_lte(spark, sf_dir, out)
    _write_umts(spark, sf_dir, out)
    return spark.read.parquet(f"{out}/lte/summary").unionByName(spark.read.parquet(f"{out}/umts/summary"))


def _file_order(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows of a table, and how many are not where the order of the whole table has them.

    Rows are ranked in their file; then the files, by day and name, must follow each other: none may begin below the
    last key of those before it. The window over files has one row per file.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    rows = table.select(F.struct(*keys).alias("key"), DAY, *where)
    place = F.row_number().over(Window.partitionBy("file").orderBy("key")) - 1
    files = (
        rows.withColumn("place", place)
        .groupBy(DAY, "file")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("place") != F.col("at")).alias("wrong"),
            F.min("key").alias("least"),
            F.max("key").alias("most"),
        )
    )
    before = F.max("most").over(Window.orderBy(DAY, "file").rowsBetween(Window.unboundedPreceding, -1))
    late = F.coalesce(F.col("before") > F.col("least"), F.lit(False))
    return files.withColumn("before", before).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(late, F.col("n")).otherwise(F.col("wrong"))), F.lit(0)).alias("out_of_place"),
    )


def sink_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the written LTE tables, and how many are not at their place in the whole table."""
    out = _scratch(spark)
    _write_lte(spark, sf_dir, out)
    parts = []
    for slice_name in SLICE_NAMES:
        for grain, keys in GRAINS["lte"].items():
            table = spark.read.parquet(f"{out}/lte/detail/slice={slice_name}/grain={grain}")
            parts.append(
                _file_order(table, keys).select(F.lit(slice_name).alias("slice"), F.lit(grain).alias("grain"), "n_rows", "out_of_place")
            )
    return reduce(DataFrame.unionByName, parts)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "nil_to_zero": nil_to_zero,
        "lte_cell_name": lte_cell_names,
        "umts_label_parse": umts_label_parse,
        "time_keys": time_key_texts,
        "operator_slice": operator_slice,
        "duplicate_keys": repeated_keys,
        "lte_report_join": lte_report_join,
        "umts_report_join": umts_report_join,
        "lte_join_drop_unmatched": lte_join_drop_unmatched,
        "umts_join_drop_unmatched": umts_join_drop_unmatched,
        "first_last_snapshot": first_last_snapshot,
        "cell_integrity": lte_cell_integrity,
        "lte_summary": lte_summary,
        "umts_summary": umts_summary,
        "lte_kpi_all_grains": lte_kpi_all_grains,
        "umts_kpi_all_grains": umts_kpi_all_grains,
        "csv_roundtrip": csv_roundtrip,
        "csv_umts_roundtrip": csv_umts_roundtrip,
        "csv_lte_kpi_day": csv_lte_kpi_day,
        "csv_awkward_roundtrip": csv_awkward_roundtrip,
        "csv_day_orders": csv_day_orders,
        "csv_line_counts": csv_line_counts,
        "csv_rejects": csv_rejects,
        "csv_umts_kpi_day": csv_umts_kpi_day,
        "lte_join_repeated_keys": lte_join_repeated_keys,
        "lte_kpi_shared_names": lte_kpi_shared_names,
        "grain_sink_roundtrip": grain_sink_roundtrip,
        "lte_sink_roundtrip": lte_sink_roundtrip,
        "umts_sink_roundtrip": umts_sink_roundtrip,
        "summary_sink_roundtrip": summary_sink_roundtrip,
        "sink_order": sink_order,
        "lte_report_by_day": lte_report_by_day,
        "lte_summary_by_day": lte_summary_by_day,
        "umts_report_by_day": umts_report_by_day,
    }
    for grain in GRAINS["lte"]:
        found[f"lte_kpi_{grain}"] = lte_kpi(grain)
        found[f"umts_kpi_{grain}"] = umts_kpi(grain)
        for slice_name in ("A", "B"):
            found[f"lte_plmn_{grain}_{slice_name.lower()}"] = lte_plmn(grain, slice_name)
            found[f"umts_plmn_{grain}_{slice_name.lower()}"] = umts_plmn(grain, slice_name)
    return found
