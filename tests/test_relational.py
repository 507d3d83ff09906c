import pytest
from pyspark.sql import functions as F

from panelspark.operators import relational as rel


def test_join_suffix(spark):
    a = spark.createDataFrame([(1, "x", 1.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "y")], "k int, s string")
    out = rel.join_suffix(a, b, ["k"])
    assert set(out.columns) == {"k", "s_x", "v", "s_y"}


def test_null_safe_join_matches_null_keys(spark):
    rows = [(k,) for k in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, None]]
    df = spark.createDataFrame(rows, "k int")
    assert df.join(df, "k").count() == 12
    assert rel.join_na_match(df, df, ["k"], "inner").count() == 13


def test_dense_id_nulls_last_and_factor_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "k string")
    ids = {r["k"]: r["i"] for r in rel.dense_id(df, ["k"], "i").collect()}
    assert ids == {"a": 1, "b": 2, None: 3}
    codes = {r["k"]: r["i"] for r in rel.dense_id(df, ["k"], "i", na_gets_id=False).collect()}
    assert codes == {"a": 1, "b": 2, None: None}


def test_sequence_number_spans_partitions(spark):
    n = 5000
    df = spark.range(n).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % n).alias("v"))
    out = rel.sequence_number(df.repartition(16), [F.desc("v")], "rn", group=["g"])
    # row numbers within each group are exactly 1..size, in order of v descending
    w = out.groupBy("g").agg(F.count("*").alias("n"), F.min("rn").alias("lo"), F.max("rn").alias("hi"),
                             F.countDistinct("rn").alias("d"))
    for r in w.collect():
        assert r["lo"] == 1 and r["hi"] == r["n"] == r["d"]
    top = out.where("rn = 1").orderBy("g").collect()
    exp = df.groupBy("g").agg(F.max("v").alias("m")).orderBy("g").collect()
    assert [r["v"] for r in top] == [r["m"] for r in exp]


def test_top_k_keeps_ties(spark):
    rows = [("a", 5.0), ("a", 4.0), ("a", 3.0), ("a", 3.0), ("a", 3.0), ("a", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert rel.top_k_ties(df, ["g"], "v", 3).count() == 5


def test_top_k_ranks_missing_values_last(spark):
    rows = [("a", float("nan")), ("a", None), ("a", 1.0), ("a", 2.0), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = sorted((r["g"], repr(r["v"])) for r in rel.top_k_ties(df, ["g"], "v", 1).collect())
    assert got == [("a", "2.0"), ("b", "nan")]
    low = [r["v"] for r in rel.top_k_ties(df.where("g = 'a'"), ["g"], "v", 1, largest=False).collect()]
    assert low == [1.0]


def test_natural_join_names_what_is_missing(spark):
    with pytest.raises(ValueError, match="no shared column"):
        rel.natural_join(spark.range(1), spark.range(1).withColumnRenamed("id", "x"))


def test_sequence_number_is_a_bigint_and_handles_nulls(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, v int")
    out = rel.sequence_number(df, ["v"], "rn", group=["g"])
    assert out.schema["rn"].dataType.typeName() == "long"
    assert sorted((r["g"] or "", r["v"], r["rn"]) for r in out.collect()) == [("", 1, 1), ("", 3, 2), ("a", 2, 1)]
    assert rel.sequence_number(df.limit(0), ["v"], "rn").count() == 0


def test_semi_restrict_keeps_sample_units(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("z",)], "u string")
    facts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "u string, t int")
    out = rel.semi_restrict(keys, facts, ["u"])
    assert sorted((r["u"], r["t"]) for r in out.collect()) == [("a", 1), ("a", 2), ("z", None)]
    assert rel.semi_restrict(keys, facts, ["u"], keep_unmatched=False).count() == 2


def test_key_override(spark):
    df = spark.createDataFrame([("Belgium", None), ("France", "FRA"), (None, "X")], "c string, iso string")
    got = [r[0] for r in df.select(rel.key_override("iso", "c", {"Belgium": "BEL"})).collect()]
    assert got == ["BEL", "FRA", None]


def test_sum_dropping_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, None), (2, None)], "t int, x double")
    out = {r["t"]: r["x"] for r in rel.sum_dropping_missing(df, "x", ["t"]).collect()}
    assert out == {1: 1.0}
