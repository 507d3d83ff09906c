import pytest
from hypothesis import given, strategies as st

from panelspark.operators import factors as fa

SIZES = ["small", "middle", "large"]


@pytest.fixture()
def sizes(spark):
    rows = [(1, "large"), (2, "small"), (3, None), (4, "middle"), (5, "odd"), (6, "small")]
    return fa.as_factor(spark.createDataFrame(rows, "k int, size string"), "size", SIZES)


def test_sort_follows_the_levels(sizes):
    assert [r.k for r in fa.factor_sort(sizes, "size", "k").collect()] == [2, 6, 4, 1, 3, 5]
    assert {r.k: r["size"] for r in sizes.collect()}[5] is None     # no level


def test_levels_survive_parquet_and_plain_operators(spark, sizes, tmp_dir):
    sizes.write.parquet(f"{tmp_dir}/f")
    back = spark.read.parquet(f"{tmp_dir}/f")
    assert fa.levels_of(back, "size") == SIZES
    counts = back.where("k > 1").select("size", "k").groupBy("size").count()
    assert [tuple(r) for r in fa.factor_sort(counts, "size").collect()] == [("small", 2), ("middle", 1), (None, 2)]


def test_union_merges_levels(spark, sizes, tmp_dir):
    other = fa.as_factor(spark.createDataFrame([(7, "huge"), (8, "tiny"), (9, "large")], "k int, size string"), "size",
                         ["tiny", "middle", "large", "huge"])
    both = fa.factor_union(sizes, other.select("size", "k"))
    assert fa.levels_of(both, "size") == ["small", "tiny", "middle", "large", "huge"]
    both.write.parquet(f"{tmp_dir}/u")
    back = fa.factor_sort(spark.read.parquet(f"{tmp_dir}/u"), "size", "k")
    assert [r.k for r in back.collect()] == [2, 6, 8, 4, 1, 9, 7, 3, 5]
    assert fa.levels_of(fa.drop_unused(both.where("k < 5"), "size"), "size") == SIZES


def test_join_merges_levels_of_keys(spark, sizes):
    price = fa.as_factor(spark.createDataFrame([("large", 9.0), ("giant", 99.0)], "size string, price double"), "size",
                         ["large", "giant"])
    out = fa.factor_join(sizes, price, ["size"], "full")
    assert fa.levels_of(out, "size") == [*SIZES, "giant"]
    assert [r.price for r in fa.factor_sort(out, "size", "k").collect()][-4:] == [9.0, 99.0, None, None]


def test_clashes_are_errors(spark, sizes):
    turned = fa.as_factor(sizes, "size", SIZES[::-1])
    with pytest.raises(ValueError, match="clash"):
        fa.factor_union(sizes, turned)
    with pytest.raises(ValueError, match="clash"):
        fa.factor_join(sizes, turned, ["size"])
    plain = spark.createDataFrame([(1, "small")], "k int, size string")
    for op in (lambda: fa.factor_union(sizes, plain), lambda: fa.factor_join(sizes, plain, ["size"])):
        with pytest.raises(ValueError, match="one side only"):
            op()
    with pytest.raises(ValueError, match="repeat"):
        fa.as_factor(plain, "size", ["a", "a"])
    with pytest.raises(ValueError, match="not a factor"):
        fa.levels_of(plain, "size")
    assert fa.as_factor(plain, "size", []).first()["size"] is None


@given(st.permutations("abcdef"), st.sets(st.sampled_from("abcdef")), st.sets(st.sampled_from("abcdef")))
def test_merged_levels_keep_both_orders(order, one, two):
    a, b = [x for x in order if x in one], [x for x in order if x in two]
    out = fa.merged_levels(a, b)
    assert [x for x in out if x in one] == a and [x for x in out if x in two] == b and len(out) == len(one | two)
