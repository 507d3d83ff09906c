import os

import pytest

from panelspark.sources.inferred import read_csv_inferred


def folder(tmp_dir, **files):
    for name, text in files.items():
        with open(f"{tmp_dir}/{name}.csv", "w") as f:
            f.write(text)
    return tmp_dir


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def test_columns_that_differ_and_types_over_all_files(spark, tmp_dir):
    path = folder(tmp_dir, a="k,when,x,code\n1,2020-01-31,1,007\n2,NA,,010\n",
                  b="x,k,flag\n2.5,3,TRUE\nInf,4,false\n1e3, 5 ,\n", c="k,void\n-6,\n", d="")
    df = read_csv_inferred(spark, path)
    assert types(df) == {"k": "bigint", "when": "date", "x": "double", "code": "string", "void": "string", "flag": "boolean"}
    got = {r.k: (str(r.when), r.x, r.code, r.flag) for r in df.collect()}
    assert got == {1: ("2020-01-31", 1.0, "007", None), 2: ("None", None, "010", None), 3: ("None", 2.5, None, True),
                   4: ("None", float("inf"), None, False), 5: ("None", 1000.0, None, None), -6: ("None", None, None, None)}


def test_one_late_value_decides(spark, tmp_dir):
    rows = "".join(f"{i},{i}\n" for i in range(5000))
    df = read_csv_inferred(spark, folder(tmp_dir, a="k,v\n" + rows + "5000,0.5\n"))
    assert types(df) == {"k": "bigint", "v": "double"} and df.count() == 5001


@pytest.mark.parametrize("value", ["abc", "2020-02-30", "1234567890123456789", "00", "1,5"])
def test_values_that_are_text(spark, tmp_dir, value):
    assert types(read_csv_inferred(spark, folder(tmp_dir, a=f'v\n"{value}"\n')))["v"] == "string"


def test_a_clash_names_the_files(spark, tmp_dir):
    path = folder(tmp_dir, one="k,v\n1,2\n", two="k,v\n2,2020-01-01\n")
    with pytest.raises(ValueError, match=r"v: types clash, bigint in .*one.csv, date in .*two.csv"):
        read_csv_inferred(spark, path)
    df = read_csv_inferred(spark, path, clash="string")
    assert types(df) == {"k": "bigint", "v": "string"} and {r.v for r in df.collect()} == {"2", "2020-01-01"}


def test_awkward_names_and_headers(spark, tmp_dir):
    path = folder(tmp_dir, a="﻿\"a b\",c.d;e,_file\r\n1,x,y\r\n")
    os.rename(f"{path}/a.csv", f"{path}/a file.csv")
    df = read_csv_inferred(spark, path)
    assert df.columns == ["a b", "c.d;e", "_file"] and tuple(df.first()) == (1, "x", "y")


@pytest.mark.parametrize("header", ["a,,b", "a,A"])
def test_bad_headers_name_the_file(spark, tmp_dir, header):
    with pytest.raises(Exception, match="bad.csv: names of the header"):
        read_csv_inferred(spark, folder(tmp_dir, bad=header + "\n1,2,3\n"))


def test_no_files_and_too_many_headers(spark, tmp_dir):
    with pytest.raises(ValueError, match="no CSV files"):
        read_csv_inferred(spark, folder(tmp_dir, a=""))
    with pytest.raises(ValueError, match="different headers"):
        read_csv_inferred(spark, folder(tmp_dir, b="x\n1\n", c="y\n1\n"), most_headers=1)
