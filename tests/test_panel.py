import math

import pytest
from pyspark.sql import functions as F

from panelspark.operators import panel as pn

SPEC = pn.PanelSpec(["u"], "t")
GAPPED = [("a", 1, 2.0), ("a", 2, 3.0), ("a", 4, 0.0), ("b", 2, 5.0), ("b", 3, None), (None, 3, 7.0)]


@pytest.fixture()
def gapped(spark):
    return spark.createDataFrame(GAPPED, "u string, t int, x double")


def _by_key(df, col):
    return {(r["u"], r["t"]): r[col] for r in df.collect()}


def test_lag_time_is_null_across_gap_row_lag_is_not(gapped):
    lt = _by_key(gapped.withColumn("l", pn.lag_time("x", SPEC)), "l")
    lr = _by_key(gapped.withColumn("l", pn.lag_row("x", SPEC)), "l")
    assert lt[("a", 2)] == 2.0 and lt[("a", 4)] is None and lt[("a", 1)] is None
    assert lr[("a", 4)] == 3.0
    assert lt[("b", 3)] == 5.0 and lt[(None, 3)] is None


def test_lag_time_two_periods(gapped):
    l2 = _by_key(gapped.withColumn("l", pn.lag_time("x", SPEC, periods=2)), "l")
    assert l2[("a", 4)] == 3.0 and l2[("a", 2)] is None


def test_dlog_and_growth(gapped):
    df = gapped.withColumns({"d": pn.dlog("x", SPEC), "g": pn.growth("x", SPEC)})
    d, g = _by_key(df, "d"), _by_key(df, "g")
    assert math.isclose(d[("a", 2)], math.log(3.0 / 2.0))
    assert math.isclose(g[("a", 2)], 0.5)
    assert d[("a", 4)] is None  # gap
    assert d[("b", 3)] is None  # missing value


def test_dlog_of_zero_is_minus_inf(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 0.0), ("a", 3, 0.0)], "u string, t int, x double")
    d = _by_key(df.withColumn("d", pn.dlog("x", SPEC)), "d")
    assert d[("a", 2)] == float("-inf") and math.isnan(d[("a", 3)])


def test_index_to_base_drops_late_start_units(spark):
    rows = [("a", 1995, 50.0), ("a", 1996, 100.0), ("c", 1996, 10.0), ("c", 1997, 20.0)]
    df = spark.createDataFrame(rows, "u string, t int, x double")
    out = pn.index_to_base(df, "x", SPEC, 1995, "idx")
    got = _by_key(out, "idx")
    assert got == {("a", 1995): 100.0, ("a", 1996): 200.0}


def test_chain_index(spark):
    df = spark.createDataFrame([(1, 0.1), (2, -0.5), (3, 1.0)], "t int, g double")
    got = [r["c"] for r in pn.chain_index(df, "g", "t", "c").orderBy("t").collect()]
    assert [round(v, 9) for v in got] == [110.0, 55.0, 110.0]


def test_lagged_share_sums_to_one(spark):
    rows = [("a", 1, 1.0, 3.0), ("a", 2, 2.0, 2.0), ("a", 3, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "u string, t int, c double, i double")
    s_c, s_i = pn.lagged_share("c", "i", SPEC)
    out = df.select("t", s_c.alias("s_c"), s_i.alias("s_i")).orderBy("t").collect()
    assert out[0]["s_c"] is None
    assert out[1]["s_c"] == 0.25 and out[1]["s_c"] + out[1]["s_i"] == 1.0


def test_panel_summary_counts_gaps_and_duplicates(spark):
    rows = [("a", 1, 1.0), ("a", 1, 2.0), ("a", 3, 1.0), ("b", 2, 1.0)]
    df = spark.createDataFrame(rows, "u string, t int, x double")
    s = {r["u"]: r for r in pn.panel_summary(df, SPEC).collect()}
    assert s["a"]["n_duplicates"] == 1 and s["a"]["n_gaps"] == 1 and s["a"]["n_periods"] == 2
    assert s["b"]["n_gaps"] == 0
    with pytest.raises(ValueError):
        pn.assert_unique(df, SPEC)


def test_log_rebase_and_base_value(spark):
    rows = [("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 3.0), ("b", 2, 3.0)]
    df = spark.createDataFrame(rows, "u string, t int, x double")
    r = _by_key(df.withColumn("r", pn.log_rebase("x", SPEC)), "r")
    assert r[("a", 1)] == 0.0 and math.isclose(r[("a", 2)], math.log(2.0))
    b = _by_key(df.withColumn("b", pn.base_value("x", SPEC, 2)), "b")
    assert b[("a", 1)] == 4.0 and b[("b", 1)] == 3.0


def test_series_splice(spark):
    df = spark.createDataFrame([(1998, 1.0, 2.0), (1999, 1.0, 2.0), (None, 1.0, 2.0)], "t int, new double, old double")
    got = [r[0] for r in df.select(pn.series_splice("t", 1998, F.col("new"), F.col("old"))).collect()]
    assert got == [2.0, 1.0, None]
