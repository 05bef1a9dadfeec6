from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from netkpi.functions.labels import lte_cell_name, umts_cell
from netkpi.functions.numbers import MISSING, counter_value, is_junk, round_even
from netkpi.functions.times import hour_floor, parse_start_time, time_keys


def _texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")


def _column(df, expr):
    return [r[0] for r in df.select(expr, "i").orderBy("i").collect()]


def test_counter_values(spark):
    df = _texts(spark, ["NIL", "", None, " 12 ", "1.5", "-3", *MISSING])
    values = _column(df, F.expr(counter_value("c")))
    assert values[:6] == [0.0, None, None, 12.0, 1.5, -3.0]
    assert values[6:] == [None] * len(MISSING)


def test_junk_fails_or_is_missing(spark):
    df = _texts(spark, ["7", "oops", "NIL", None])
    with pytest.raises(Exception, match="not a number: oops"):
        df.select(F.expr(counter_value("c"))).collect()
    assert _column(df, F.expr(counter_value("c", strict=False))) == [7.0, None, 0.0, None]
    assert _column(df, F.expr(is_junk("c"))) == [False, True, False, False]


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0, 0.125), (1, 1.005), (2, 2.5), (3, 3.5), (4, 0.375), (5, None)], "i int, x double")
    assert _column(df, F.expr(round_even("x", 2))) == [0.12, 1.0, 2.5, 3.5, 0.38, None]
    assert _column(df, F.expr(round_even("x", 0))) == [0.0, 1.0, 2.0, 4.0, 0.0, None]


def test_lte_cell_names(spark):
    full = "eNodeB Function Name=E1, Local Cell ID=1, Cell Name=CELL_A, eNodeB ID=5, Cell FDD TDD indication=CELL_FDD"
    df = _texts(
        spark,
        [full, "  " + full.replace(" ", "   "), "bad cell", None, "", "a b c d e f g h", "a b c d e f g x=,y", "a b c d e f g x=p=q,r"],
    )
    assert _column(df, lte_cell_name(F.col("c"))) == ["CELL_A", "CELL_A", None, None, None, None, "", "p"]


def test_umts_labels(spark):
    df = _texts(spark, ["Label=SITE1_2, CellID=4711, LogicRNCID=3", "Label=short", "Label", None, "Label=A_B_C,  CellID=9"])
    parts = umts_cell(F.col("c"))
    assert _column(df, parts["cell"]) == ["SITE1_2", "short", None, None, "A_B_C"]
    assert _column(df, parts["cell_id"]) == ["4711", None, None, None, "9"]
    assert _column(df, parts["site"]) == ["SITE1", "short", None, None, "A"]


def test_start_times(spark):
    df = _texts(
        spark,
        ["2021-01-29 13:30", "2021/1/9 03:05:07", "01/29/2021 13:00", "2021-03-28 02:45:00", "junk", "2021", "13:00", None,
         "01/29/2021 01:00 PM", "29-Jan-2021 13:00", "20210129 13:00", "1/9/2021 12:05:01 am", "28-mar-2021 02:45:00",
         "13/29/2021 01:00", "01/29/2021 13:00 PM", "29-Foo-2021 13:00", "20211329 13:00"],
    )
    ts = parse_start_time(F.col("c"))
    assert _column(df, ts) == [
        dt.datetime(2021, 1, 29, 13, 30),
        dt.datetime(2021, 1, 9, 3, 5, 7),
        dt.datetime(2021, 1, 29, 13),
        dt.datetime(2021, 3, 28, 2, 45),  # does not exist in the session time zone
        None,
        None,
        None,
        None,
        dt.datetime(2021, 1, 29, 13),
        dt.datetime(2021, 1, 29, 13),
        dt.datetime(2021, 1, 29, 13),
        dt.datetime(2021, 1, 9, 0, 5, 1),
        dt.datetime(2021, 3, 28, 2, 45),
        None,
        None,
        None,
        None,
    ]
    own = parse_start_time(F.col("c"), formats=["dd-MMM-yyyy HH:mm:ss"])
    assert _column(df, own)[8:11] == [None, dt.datetime(2021, 1, 29, 13), None]
    keys = time_keys(hour_floor(ts))
    assert _column(df, keys["start_time"])[:4] == [
        "2021-01-29 13:00",
        "2021-01-09 03:00",
        "2021-01-29 13:00",
        "2021-03-28 02:00",
    ]
    assert _column(df, keys["date"])[3] == "2021-03-28"
    assert _column(df, keys["hour"])[3] == "02:00"


def test_month_names(spark):
    """Each month by its name; three letters out of two neighbouring names are none."""
    names = ["Jan", "feb", "MAR", "April", "May", "Jun", "Jul", "Aug", "September", "Oct", "Nov", "Dec"]
    texts = [f"05-{n}-2021 13:00" for n in [*names, "Anf", "nfe", "ecj"]]
    want = [dt.datetime(2021, m, 5, 13) for m in range(1, 13)] + [None] * 3
    assert _column(_texts(spark, texts), parse_start_time(F.col("c"))) == want


def test_day_first(spark):
    df = _texts(spark, ["01/02/2021 05:00"])
    assert _column(df, parse_start_time(F.col("c"))) == [dt.datetime(2021, 1, 2, 5)]
    assert _column(df, parse_start_time(F.col("c"), day_first=True)) == [dt.datetime(2021, 2, 1, 5)]
