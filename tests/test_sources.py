import pytest
from pyspark.sql import functions as F

from panelspark.sources.files import (
    read_csv_header, read_csv_multi, read_fixed_width, write_csv, write_yearly, year_by_file_order,
)
from panelspark.sources.nested import nested_series_scan, unnest_obs


def test_headerless_multi_file_csv_with_year_by_file_order(spark, tmp_dir):
    rows = [("10000000000000", 62, 1.0, 2011), ("10000000100000", 5, 2.0, 2011), ("10000000000000", 62, 3.0, 2012)]
    df = spark.createDataFrame(rows, "govid string, type_emp int, full_time double, year int")
    path = write_yearly(df, f"{tmp_dir}/emp", "csv")
    raw = read_csv_multi(spark, path, "govid string, type_emp int, full_time double")
    by_order = year_by_file_order(raw, 2011, 2)
    got = sorted((r["govid"], r["type_emp"], r["full_time"], r["year"]) for r in by_order.collect())
    assert got == sorted(rows)


def test_year_of_a_folder_with_several_files(spark, tmp_dir):
    df = spark.range(400).select((F.col("id") % 3 + 2011).cast("int").alias("year"), F.col("id").cast("string").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # small data would become one task
    try:
        path = write_yearly(df, f"{tmp_dir}/y", "csv", files_per_year=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    raw = read_csv_multi(spark, path, "v string")
    assert len(raw.inputFiles()) > 3
    got = {r["v"]: r["year"] for r in year_by_file_order(raw, 2011, 3).collect()}
    assert got == {str(i): 2011 + i % 3 for i in range(400)}


def test_single_files_are_years_too(spark, tmp_dir):
    for y in (2011, 2012):
        with open(f"{tmp_dir}/emp_{y}.csv", "w") as f:
            f.write(f"a{y}\n")
    raw = read_csv_multi(spark, tmp_dir, "v string")
    assert sorted((r["v"], r["year"]) for r in year_by_file_order(raw, 2011, 2).collect()) == [("a2011", 2011), ("a2012", 2012)]


def test_a_missing_year_is_an_error(spark, tmp_dir):
    df = spark.createDataFrame([("a", 2011), ("b", 2013)], "v string, year int")
    raw = read_csv_multi(spark, write_yearly(df, f"{tmp_dir}/m", "csv"), "v string")
    with pytest.raises(ValueError, match="3 yearly files are expected"):
        year_by_file_order(raw, 2011, 3)


def test_fixed_width(spark, tmp_dir):
    lines = [("AB   12345", 2001), ("CD        ", 2001)]
    df = spark.createDataFrame(lines, "value string, year int")
    path = write_yearly(df, f"{tmp_dir}/fw", "text")
    out = read_fixed_width(spark, path, [("code", 1, 2), ("num", 6, 10)]).drop("_file")
    assert sorted((r["code"], r["num"]) for r in out.collect()) == [("AB", "12345"), ("CD", None)]


def test_csv_header_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, s string")
    back = read_csv_header(spark, write_csv(df, f"{tmp_dir}/c"), "k bigint, s string")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, "b")]


def test_nested_series_scan_and_unnest(spark, tmp_dir):
    import datetime as dt
    rows = [("click", 1, [(dt.date(2024, 1, 1), 1.5), (dt.date(2024, 1, 2), 2.5)]), ("view", 2, [])]
    df = spark.createDataFrame(rows, "freq string, ref_area bigint, obs array<struct<day: date, value: double>>")
    df.write.parquet(f"{tmp_dir}/s")
    clicks = nested_series_scan(spark, f"{tmp_dir}/s", freq="click")
    assert unnest_obs(clicks).count() == 2
    all_series = nested_series_scan(spark, f"{tmp_dir}/s")
    assert unnest_obs(all_series, keep_empty=True).count() == 3
    plan = clicks._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "freq" in plan


def test_nested_series_area_and_date_range(spark, tmp_dir):
    import datetime as dt
    obs = [(dt.date(2024, 1, d), float(d)) for d in (1, 2, 3)]
    rows = [("click", 1, obs), ("click", 2, obs), ("view", 1, obs)]
    df = spark.createDataFrame(rows, "freq string, ref_area bigint, obs array<struct<day: date, value: double>>")
    df.write.parquet(f"{tmp_dir}/s2")
    s = nested_series_scan(spark, f"{tmp_dir}/s2", freq="click", areas=[1],
                           start=dt.date(2024, 1, 2), end=dt.date(2024, 1, 3))
    got = sorted((r["ref_area"], r["day"].day) for r in unnest_obs(s).collect())
    assert got == [(1, 2), (1, 3)]
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "In(ref_area" in plan or "EqualTo(ref_area" in plan
