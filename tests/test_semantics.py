import math

from pyspark.sql import functions as F

from panelspark.functions import semantics as sem

INF, NAN = float("inf"), float("nan")


def _same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b


def test_rln_ieee(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (None,), (NAN,), (INF,)], "x double")
    got = [r[0] for r in df.select(sem.rln("x")).collect()]
    for g, e in zip(got, [-INF, NAN, 0.0, None, NAN, INF]):
        assert _same(g, e), (got,)


def test_rdiv_table(spark):
    cases = [(1.0, 0.0, INF), (-1.0, 0.0, -INF), (0.0, 0.0, NAN), (4.0, 2.0, 2.0), (None, 0.0, None),
             (1.0, None, None), (None, None, None), (NAN, 0.0, NAN), (INF, 0.0, INF), (INF, INF, NAN),
             (1.0, NAN, NAN), (1.0, INF, 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a double, b double")
    got = [r[0] for r in df.select(sem.rdiv("a", "b")).collect()]
    for g, (_, _, e) in zip(got, cases):
        assert _same(g, e), (got,)


def test_ifelse_na_propagates_missing_condition(spark):
    df = spark.createDataFrame([(2011,), (2000,), (None,)], "y int")
    got = [r[0] for r in df.select(sem.ifelse_na(F.col("y") > 2010, "A", "B")).collect()]
    assert got == ["A", "B", None]


def test_complete_cases_then_inf_to_zero(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (INF,), (-INF,)], "x double")
    kept = df.na.drop()
    assert sorted(r[0] for r in kept.collect()) == [-INF, 1.0, INF]
    assert sorted(r[0] for r in sem.inf_to_zero(kept).collect()) == [0.0, 0.0, 1.0]


def test_try_number(spark):
    df = spark.createDataFrame([("abc",), (" 12 ",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(sem.try_number("s")).collect()] == [None, 12.0, None, None]


def test_id_scale(spark):
    df = spark.createDataFrame([(10000000000000,), (10000000000007,), (None,)], "g bigint")
    assert [r[0] for r in df.select(sem.id_scale("g")).collect()] == [100000000, None, None]


def test_weighted_sum_propagates_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(sem.weighted_sum({"a": 10, "b": 100})).collect()]
    assert got == [210.0, None]


def test_format_numeric_shows_significant_digits(spark):
    rows = [(-1.89, 100.0, 0.00123, 3), (-13.17, 250.0, 12.0, 40), (None, 1000.0, float("inf"), 7)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int")
    got = [tuple(r) for r in sem.format_numeric(df, 2).collect()]
    assert got == [("-1.9", "100", "0.0012", "3"), ("-13.2", "250", "12.0000", "40"), ("NA", "1000", "Inf", "7")]
    # a common format has no decimals that are zero in every entry, and 9.96 shows as 10
    more = spark.createDataFrame([(0.5, 9.96), (20.0, 30.0)], "a double, b double")
    assert [tuple(r) for r in sem.format_numeric(more, 2).collect()] == [("0.5", "10"), ("20.0", "30")]
