"""Stata files against another reader and writer of the format (pandas)."""

import datetime as dt
import glob
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.sources import stata
from panelspark.sources.stata import read_dta, write_dta


def frame(n=1000):
    i = np.arange(n)
    return pd.DataFrame({
        "b": (i % 100).astype(np.int8), "h": (i * 31 % 32000).astype(np.int16), "w": (i * 7919).astype(np.int32),
        "f": (i / 4).astype(np.float32), "d": np.where(i % 10 == 0, np.nan, i / 3),
        "s": [["", "a", "straße", "日本"][k % 4] + "x" * (k % 7) for k in i],
        "day": pd.Timestamp("1959-12-25") + pd.to_timedelta(i, "D"),
        "at": pd.Timestamp("2020-02-29 12:00:00.250") + pd.to_timedelta(i, "h")})


@pytest.mark.parametrize("version", [117, 118, 119])
@pytest.mark.parametrize("order", ["little", "big"])
def test_files_of_another_writer(spark, tmp_dir, version, order):
    want = frame()
    if version == 117:
        want["s"] = want["s"].str.replace("日本", "é")
    want.to_stata(f"{tmp_dir}/x.dta", version=version, write_index=False, byteorder=order,
                  convert_dates={"day": "td", "at": "tc"}, data_label="a <map> label", time_stamp=dt.datetime(2020, 1, 1))
    df = read_dta(spark, f"{tmp_dir}/x.dta", split_bytes=8000)
    assert [f.dataType.simpleString() for f in df.schema] == [
        "tinyint", "smallint", "int", "float", "double", "string", "date", "timestamp_ntz"]
    assert df.rdd.getNumPartitions() > 3   # one file, several tasks
    got = [tuple(r) for r in df.orderBy("w").collect()]
    for g, w in zip(got, want.itertuples(index=False)):
        assert g[:4] == (w.b, w.h, w.w, w.f) and g[5] == w.s and g[6] == w.day.date() and g[7] == w.at.to_pydatetime()
        assert g[4] is None if np.isnan(w.d) else g[4] == w.d
    assert len(got) == len(want)


def test_another_reader_reads_written_files(spark, tmp_dir):
    df = spark.createDataFrame(
        [(i, i % 3, i * 1.5 if i % 5 else None, "é" * (i % 4), dt.date(1950 + i % 80, 1, 2), i % 2 == 0, 2**40 + i)
         for i in range(500)], "k int, g tinyint, v double, s string, day date, flag boolean, far bigint").repartition(3)
    path = write_dta(df, f"{tmp_dir}/out", labels={"g": {0: "zero", 1: "eins"}}, file_bytes=4000)
    files = glob.glob(f"{path}/*.dta")
    assert len(files) > 3
    parts = [pd.read_stata(f, convert_categoricals=False) for f in files]
    got = pd.concat(parts).sort_values("k").reset_index(drop=True)
    for r, g in zip(df.orderBy("k").collect(), got.itertuples(index=False)):
        assert (r.k, r.g, r.s, r.day, int(r.flag), r.far) == (g.k, g.g, g.s, g.day.date(), g.flag, g.far)
        assert np.isnan(g.v) if r.v is None else g.v == r.v
    texts = pd.read_stata(files[0])["g"].astype(str)
    assert set(texts) == {"zero", "eins", "2"}


def test_roundtrip_with_labels_and_missing_codes(spark, tmp_dir):
    rows = [(1, 1, 5, None), (2, 2, None, ".a"), (3, None, None, ".z"), (4, 9, None, None), (5, 1, -7, None)]
    df = spark.createDataFrame(rows, "k int, g int, v smallint, why string")
    path = write_dta(df, f"{tmp_dir}/c", labels={"g": {1: "one", 2: "two"}}, missing_codes={"v": "why"})
    got = read_dta(spark, path, value_labels=True, missing_codes=True)
    assert got.columns == ["k", "k_missing", "g", "g_missing", "v", "v_missing"]
    assert sorted(tuple(r) for r in got.drop("k_missing").collect()) == [
        (1, "one", None, 5, None), (2, "two", None, None, ".a"), (3, None, ".", None, ".z"), (4, "9", None, None, "."),
        (5, "one", None, -7, None)]
    some = read_dta(spark, path, columns=["v", "k"])
    assert some.columns == ["v", "k"] and some.where("v = 5").first().k == 1
    for kind in ("float", "double"):
        one = df.select("k", F.col("v").cast(kind).alias("v"), "why")
        back = read_dta(spark, write_dta(one, f"{tmp_dir}/{kind}", missing_codes={"v": "why"}), missing_codes=True)
        assert {r.k: (r.v, r.v_missing) for r in back.collect()} == {
            1: (5.0, None), 2: (None, ".a"), 3: (None, ".z"), 4: (None, "."), 5: (-7.0, None)}


def test_numbers_at_the_edge_of_a_type_get_a_wider_one(spark, tmp_dir):
    df = spark.createDataFrame([(100, 32740, 2147483620), (101, 32741, 2147483621), (-128, -32768, -2147483648)],
                               "a tinyint, b smallint, c int")
    back = read_dta(spark, write_dta(df, f"{tmp_dir}/e"))
    assert [f.dataType.simpleString() for f in back.schema] == ["smallint", "int", "double"]
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,)], "x double")
    assert sorted((r.x is None, r.x) for r in read_dta(spark, write_dta(odd, f"{tmp_dir}/n")).collect()) == [
        (False, 1e300), (True, None), (True, None)]


def test_empty_tables_and_empty_columns(spark, tmp_dir):
    none = spark.createDataFrame([], "k int, s string")
    back = read_dta(spark, write_dta(none, f"{tmp_dir}/z"))
    assert back.collect() == [] and back.columns == ["k", "s"]
    null = spark.createDataFrame([(None, None)], "k bigint, s string")
    assert [tuple(r) for r in read_dta(spark, write_dta(null, f"{tmp_dir}/y")).collect()] == [(None, "")]


def test_only_committed_files_are_read(spark, tmp_dir):
    df = spark.range(50).select(F.col("id").cast("int").alias("k"))
    path = write_dta(df, f"{tmp_dir}/p")
    stray = f"{path}/part-stray.dta"
    with open(glob.glob(f"{path}/part-*.dta")[0], "rb") as f, open(stray, "wb") as g:
        g.write(f.read())
    assert read_dta(spark, path).count() == 50          # as a failed attempt would leave
    write_dta(df, path, mode="append")
    assert read_dta(spark, path).count() == 100
    write_dta(df.limit(7), path)
    assert read_dta(spark, path).count() == 7
    with open(f"{path}/_committed") as f:
        assert {os.path.basename(x) for x in glob.glob(f"{path}/*.dta")} == {*json.load(f), "part-stray.dta"}
    os.rename(f"{path}/_committed", f"{path}/other")
    with pytest.raises(Exception, match="was not committed"):
        read_dta(spark, path)


def test_a_failing_task_leaves_nothing_behind(spark, tmp_dir):
    good = write_dta(spark.range(9).select(F.col("id").cast("int").alias("k")), f"{tmp_dir}/f")
    before = sorted(os.listdir(good))
    bad = spark.createDataFrame([(1.0,), (1.7e308,)], "x double").repartition(2)
    with pytest.raises(Exception, match="largest"):
        write_dta(bad, good)
    assert sorted(os.listdir(good)) == before and read_dta(spark, good).count() == 9


def test_errors_name_the_column_or_the_file(spark, tmp_dir):
    for kind, value, what in (("string", "x" * 2046, "longest is 2045"), ("bigint", 2**60, "2\\^53"), ("binary", b"x", "no type")):
        with pytest.raises(ValueError, match=what):
            write_dta(spark.createDataFrame([(value,)], f"v {kind}"), f"{tmp_dir}/q")
    with pytest.raises(ValueError, match="not a name"):
        write_dta(spark.range(1).select(F.col("id").alias("a b")), f"{tmp_dir}/q")
    os.mkdir(f"{tmp_dir}/m")
    pd.DataFrame({"a": [1.0]}).to_stata(f"{tmp_dir}/m/1.dta", version=118, write_index=False)
    pd.DataFrame({"a": ["x"]}).to_stata(f"{tmp_dir}/m/2.dta", version=118, write_index=False)
    with pytest.raises(Exception, match="2.dta: a is a text"):
        read_dta(spark, f"{tmp_dir}/m")
    long = pd.DataFrame({"k": [1, 2], "t": ["x" * 3000, "y"]})
    long.to_stata(f"{tmp_dir}/l.dta", version=118, write_index=False, convert_strl=["t"])
    with pytest.raises(Exception, match="strL"):
        read_dta(spark, f"{tmp_dir}/l.dta")
    assert [r.k for r in read_dta(spark, f"{tmp_dir}/l.dta", columns=["k"]).orderBy("k").collect()] == [1, 2]


def test_files_of_different_widths(spark, tmp_dir):
    os.mkdir(f"{tmp_dir}/w")
    pd.DataFrame({"a": np.array([1, 2], np.int8), "s": ["x", "y"]}).to_stata(f"{tmp_dir}/w/1.dta", version=118, write_index=False)
    pd.DataFrame({"s": ["long text"], "a": np.array([1 << 20], np.int32)}).to_stata(f"{tmp_dir}/w/2.dta", version=118, write_index=False)
    got = read_dta(spark, f"{tmp_dir}/w")
    assert got.schema["a"].dataType.simpleString() == "int"
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x"), (2, "y"), (1 << 20, "long text")]
    assert stata.wider(stata.FLOAT, stata.LONG) == stata.DOUBLE and stata.wider(stata.FLOAT, stata.INT) == stata.FLOAT
