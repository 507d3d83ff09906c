"""Lags, products and first values over partitions against windows over units."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import panel as pn
from panelspark.operators.longpanel import LongPanel, chain_index_scan, log_rebase_scan
from panelspark.operators.panel import PanelSpec

SPEC = PanelSpec(["unit", "sub"], "t")


@pytest.fixture(scope="module")
def panel(spark):
    """One unit with two thirds of the rows, a unit of NULLs, units of one row, gaps in time."""
    r = random.Random(3)
    rows = [("hot", 1, t, r.choice([None, 0.0, -2.0, 1.5, 3.0])) for t in range(400) if t % 7]
    rows += [(None, None, t, float(t)) for t in range(0, 60, 3)] + [("b", None, t, 2.0) for t in range(5)]
    rows += [(f"u{i}", i % 3, i, 1.0 + i) for i in range(60)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "unit string, sub int, t int, x double").repartition(4).cache()


def same(a, b):
    key = lambda df: sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    assert sorted(a.columns) == sorted(b.columns) and key(a) == key(b)


@pytest.mark.parametrize("partitions", [1, 5, 60])
def test_lags_of_long_units(panel, partitions):
    got = LongPanel(panel, SPEC, partitions)
    for by, lagger in (("time", pn.lag_time), ("row", pn.lag_row)):
        for periods in (1, 4):
            same(got.lags(["x"], periods, by=by).rows, panel.withColumn("lag_x", lagger("x", SPEC, periods)))


def test_no_window_holds_more_than_a_partition(spark, panel):
    got = LongPanel(panel, SPEC, 20)
    sizes = [r["count"] for r in got.placed.groupBy("_pid").count().collect()]
    assert max(sizes) <= 80 and panel.where("unit = 'hot'").count() > 300
    plan = got.lags(["x"]).rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and all("_pid" in line for line in plan.splitlines() if "Window [" in line)
    assert got.halo(["x"], 2).groupBy("_pid").count().where("count > 2").count() == 0


@pytest.mark.parametrize("partitions", [1, 17])
def test_products_and_first_values_of_long_units(panel, partitions):
    small = panel.withColumn("x", F.when(F.col("t") % 50 == 0, F.col("x")).otherwise(F.col("x") / 2))
    got = LongPanel(small, SPEC, partitions)
    want = {tuple(r[:3]): r for r in pn.chain_index(small, "x", "t", "i", partition=SPEC.units).collect()}
    for r in chain_index_scan(got, "x", "i").rows.collect():
        w = want[tuple(r[:3])]["i"]
        assert r["i"] == w if w is None else r["i"] == pytest.approx(w, rel=1e-9, nan_ok=True)
    same(log_rebase_scan(got, "t", "y").rows, small.withColumn("y", pn.log_rebase("t", SPEC)))


def test_an_empty_long_panel(panel):
    got = LongPanel(panel.limit(0), SPEC, 4)
    assert got.lags(["x"]).rows.collect() == [] and chain_index_scan(got, "x", "i").rows.collect() == []
