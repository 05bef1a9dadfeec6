from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from netkpi.operators.grains import GRAINS, by_grain, by_grains, text_times
from netkpi.operators.joins import duplicate_keys, join_reports, shared_keys, with_shared_key
from netkpi.operators.measures import Measures
from netkpi.operators.slices import only_slice, with_slice
from netkpi.operators.snapshots import cell_integrity, first_last_rows, hour_range

KEYS = ("ne_name", "cell_name")
T0 = dt.datetime(2021, 1, 1)
SCHEMA = "hour_ts timestamp_ntz, ne_name string, cell_name string"


def _random_rows(seed: int, n: int, columns: int):
    """Few keys, so that they repeat; a third of the rows share one key without a cell name."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            key = (T0, "N0", None)
        else:
            key = (
                T0 + dt.timedelta(hours=rnd.randrange(50)),
                rnd.choice(["N0", "N1", None]),
                rnd.choice(["C0", "C1", "C2", "", None]),
            )
        values = [rnd.choice([None, 0.0, float(rnd.randrange(100))]) for _ in range(columns)]
        rows.append((*key, *values))
    return rows


def _plain(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("drop_unmatched", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_row_by_row_join(spark, seed, drop_unmatched):
    a = _random_rows(seed, 300, 2)
    b = _random_rows(seed + 10, 200, 1)
    c = _random_rows(seed + 20, 100, 1)
    left = spark.createDataFrame(a, SCHEMA + ", x double, y double")
    middle = spark.createDataFrame(b, SCHEMA + ", z double")
    right = spark.createDataFrame(c, SCHEMA + ", w double")
    sides = [
        (left, Measures(("x", "y"), ("x",), ("y",))),
        (middle, Measures(("z",))),
        (right, Measures(("w",), ("w",), ("w",))),
    ]
    got = {
        (r.hour_ts, r.ne_name, r.cell_name): (r.x, r.y, r.n_x, r.max_y, r.z, r.w, r.n_w, r.max_w, r.joined_rows)
        for r in join_reports(sides, KEYS, drop_unmatched).collect()
    }

    # pandas also joins missing keys with missing keys
    names = ["hour_ts", *KEYS]
    rows = (
        pd.DataFrame(a, columns=[*names, "x", "y"])
        .merge(pd.DataFrame(b, columns=[*names, "z"]), on=names)
        .merge(pd.DataFrame(c, columns=[*names, "w"]), on=names)
    )
    want = {}
    for key, g in rows.groupby(names, dropna=False):

        def total(c, g=g):
            return None if g[c].notna().sum() == 0 else g[c].sum()

        def top(c, g=g):
            return None if g[c].notna().sum() == 0 else g[c].max()

        key = (key[0].to_pydatetime(), *[None if pd.isna(k) else k for k in key[1:]])
        want[key] = (
            total("x"), total("y"), g.x.notna().sum(), top("y"), total("z"), total("w"), g.w.notna().sum(), top("w"), len(g),
        )
    assert got == want


def test_hot_missing_key_does_not_multiply_out(spark):
    """20,000 x 20,000 rows under one missing key: the join has 4e8 rows, but none is made."""
    rows = spark.range(20_000).selectExpr(
        "timestamp_ntz '2021-01-01 00:00:00' hour_ts", "'N' ne_name", "cast(null as string) cell_name", "1D x"
    )
    other = rows.withColumnRenamed("x", "z")
    [r] = join_reports([(rows, Measures(("x",), ("x",))), (other, Measures(("z",)))], KEYS).collect()
    assert (r.x, r.n_x, r.z, r.joined_rows, r.cell_name) == (4e8, 400_000_000, 4e8, 400_000_000, None)


def test_join_shuffles_each_report_once(spark):
    def side(name):
        return spark.range(10).selectExpr(
            "timestamp_ntz '2021-01-01 00:00:00' + make_dt_interval(0, int(id)) hour_ts",
            "nullif(string(id), '7') ne_name",
            "nullif(string(id), '8') cell_name",
            f"1D {name}",
        )

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_reports([(side(n), Measures((n,))) for n in "xyz"], KEYS)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 3
    assert plan.count("SortMergeJoin") == 2


def _keyed(spark, first: int, n: int):
    """``n`` rows of unique keys; some lack a part of their key."""
    return spark.range(first, first + n).selectExpr(
        "timestamp_ntz '2021-01-01 00:00:00' + make_dt_interval(0, int(id % 100)) hour_ts",
        "if(id % 7 = 0, null, 'N' || id) ne_name",
        "if(id % 11 = 0, null, 'C' || id) cell_name",
        "id",
    )


def test_rows_without_partners_go_before_the_sums(spark):
    """Half of the keys match: no row of these is lost, and few others stay."""
    names = ["hour_ts", *KEYS]
    sides = [_keyed(spark, 0, 20_000), _keyed(spark, 10_000, 20_000), _keyed(spark, 9_000, 21_000)]
    found = shared_keys(sides, names, words=2**14)
    for side in sides:
        left = {r.id for r in with_shared_key(side, found, names, words=2**14).select("id").collect()}
        assert set(range(10_000, 20_000)) <= left
        assert len(left) < 11_000
    assert with_shared_key(sides[0], found, names, words=2**14).columns == sides[0].columns


def test_a_key_filter_that_is_too_small_loses_nothing(spark):
    names = ["hour_ts", *KEYS]
    sides = [_keyed(spark, 0, 3_000), _keyed(spark, 1_000, 3_000)]
    found = shared_keys(sides, names, words=2)
    assert found.count() == 2
    left = {r.id for r in with_shared_key(sides[0], found, names, words=2).collect()}
    assert set(range(1_000, 3_000)) <= left


def test_a_report_without_rows_leaves_no_keys(spark):
    names = ["hour_ts", *KEYS]
    sides = [_keyed(spark, 0, 100), _keyed(spark, 0, 0)]
    assert shared_keys(sides, names).count() == 0
    measured = [(s.withColumn(c, F.lit(1.0)), Measures((c,))) for s, c in zip(sides, "xz")]
    assert join_reports(measured, KEYS, drop_unmatched=True).count() == 0


def test_the_key_filter_is_below_the_sums(spark, tmp_path):
    """Each report's rows meet the filter before the exchange of their sums; for the filter only keys are read."""
    sides = []
    for c, first in (("x", 0), ("z", 500)):
        _keyed(spark, first, 1_000).withColumn(c, F.lit(1.0)).write.parquet(str(tmp_path / c))
        sides.append((spark.read.parquet(str(tmp_path / c)), Measures((c,))))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = join_reports(sides, KEYS, drop_unmatched=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = plan.splitlines()
    for c in ("x", "z"):
        summed = next(i for i, line in enumerate(lines) if f"partial_sum({c}#" in line)
        below = "\n".join(lines[summed : summed + 4])
        assert "BroadcastHashJoin" in below and "LeftSemi" in below, below
    schemas = [line.split("ReadSchema: ")[1] for line in lines if "ReadSchema: " in line]
    keys_only = [s for s in schemas if ":double" not in s]
    assert len(keys_only) >= 2 and len(schemas) - len(keys_only) == 2, schemas


def test_duplicate_keys(spark):
    rows = [(T0, "N", "C"), (T0, "N", "C"), (T0, "N", None), (T0, "N", None), (T0, "N", "D")]
    found = duplicate_keys(spark.createDataFrame(rows, SCHEMA), KEYS)
    assert _plain(found) == sorted(map(repr, [(T0, "N", "C", 2), (T0, "N", None, 2)]))


M = Measures(("x",), ("x",), ("x",))


@pytest.fixture(scope="module")
def partials(spark):
    rows = spark.createDataFrame(_random_rows(5, 400, 1), SCHEMA + ", x double")
    return rows.groupBy("hour_ts", *KEYS).agg(*M.of_rows())


def test_all_grains_in_one_pass(spark, partials):
    together = text_times(by_grains(partials, M.of_partials(), "lte"))
    for grain, keys in GRAINS["lte"].items():
        alone = text_times(by_grain(partials, M.of_partials(), "lte", grain))
        own = together.filter(F.col("grain") == grain).select(*alone.columns)
        assert _plain(own) == _plain(alone)
        assert alone.select(*keys).distinct().count() == alone.count()
        assert alone.filter(" OR ".join(f"{k} IS NULL" for k in keys)).count() == 0


def test_days_are_the_sum_of_their_hours(partials):
    day = by_grain(partials, M.of_partials(), "lte", "day")
    hours = by_grain(partials, M.of_partials(), "lte", "hour").groupBy("date").agg(*M.of_partials())
    assert _plain(day) == _plain(hours.select(*day.columns))


def test_order_of_rows_does_not_matter(partials):
    shuffled = partials.repartition(3).orderBy(F.rand(1))
    for grain in GRAINS["lte"]:
        assert _plain(by_grain(partials, M.of_partials(), "lte", grain)) == _plain(
            by_grain(shuffled, M.of_partials(), "lte", grain)
        )


def test_same_cell_name_on_two_sites_merges_at_cell_hour(spark):
    rows = spark.createDataFrame([(T0, "N0", "C", 1.0), (T0, "N1", "C", 2.0)], SCHEMA + ", x double")
    assert [r.x for r in by_grain(rows, M.of_rows(), "lte", "cell_hour").collect()] == [3.0]
    assert by_grain(rows, M.of_rows(), "lte", "cell").count() == 2


def test_slices(spark):
    ids = [0, 1, 2, 3, None]
    rows = spark.createDataFrame([(None if i is None else f"CN Operator ID={i}", i) for i in ids], "cn_operator string, i int")
    assert sorted((r.i, r.slice) for r in with_slice(rows).collect()) == [(0, "A"), (1, "A"), (2, "B")]
    assert sorted(r.i for r in only_slice(rows, "A").collect()) == [0, 1]
    assert [r.i for r in only_slice(with_slice(rows), "B").collect()] == [2]


def test_first_and_last_hour(spark):
    h = [T0 + dt.timedelta(hours=i) for i in range(3)]
    rows = [(h[2], "N", "C1"), (h[0], "N", "C1"), (h[1], "N", "C9"), (h[0], "M", "C1"), (h[0], "N", None), (h[2], "N", "C2")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert tuple(hour_range(df).first()) == (h[0], h[2])
    assert tuple(cell_integrity(df).first()) == (1, 2)
    marked = sorted((r.moment, r.hour_ts) for r in first_last_rows(df).collect())
    assert marked == [("first", h[0])] * 3 + [("last", h[2])] * 2


def test_hours_are_looked_up_once(spark, tmp_path):
    rows = [(T0 + dt.timedelta(hours=i), "N", f"C{i % 3}") for i in range(9)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "cells"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = cell_integrity(spark.read.parquet(str(tmp_path / "cells")))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert tuple(found.first()) == (1, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "ReusedSubquery" in plan
    assert plan.count("FileScan") == 2  # the cells, and one look for both hours


def test_hours_from_another_table(spark):
    h = [T0 + dt.timedelta(hours=i) for i in range(3)]
    rows = [(h[0], "N", "C1"), (h[1], "N", "C9"), (h[2], "N", "C1"), (h[2], "N", "C2")]
    df = spark.createDataFrame(rows, SCHEMA)
    hours = spark.createDataFrame([(x,) for x in h], "hour_ts timestamp_ntz")
    assert tuple(cell_integrity(df, hours=hours).first()) == (1, 2)
    nothing = hours.where("false")
    assert tuple(cell_integrity(df.where("false"), hours=nothing).first()) == (0, 0)


def test_single_hour_is_first(spark):
    df = spark.createDataFrame([(T0, "N", "C")], SCHEMA)
    assert [r.moment for r in first_last_rows(df).collect()] == ["first"]
    assert tuple(cell_integrity(df).first()) == (1, 1)
