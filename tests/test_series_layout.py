"""Series laid out for skipping: what a scan for some areas reads, against an unordered layout."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelspark.sources.nested import SERIES_SCHEMA, nested_series_scan, write_series

AREAS = 1500


@pytest.fixture(scope="module")
def series(spark):
    obs = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.struct(
        F.date_add(F.lit("2024-01-01").cast("date"), i).alias("day"), F.rand(3).alias("value")))
    all_areas = spark.range(AREAS).select((F.col("id") * 2).alias("ref_area"), F.explode(
        F.array(F.lit("A"), F.lit("M"), F.lit("Q"))).alias("freq"))
    # one area holds a third of all rows
    hot = spark.range(AREAS * 3 // 2).select(F.lit(1000).cast("long").alias("ref_area"), F.lit("M").alias("freq"))
    return all_areas.unionByName(hot).select("freq", "ref_area", obs.alias("obs")).repartition(6, F.rand(5))


def rows_read(df):
    """(rows that the scan gave, rows of the result)."""
    n = len(df.collect())
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value(), n


def groups(path):
    """(rows, least and greatest (freq, area)) of every row group."""
    out = []
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            g = meta.row_group(g)
            freq, area = g.column(0).statistics, g.column(1).statistics
            out.append((g.num_rows, freq.min, freq.max, area.min, area.max))
    return out


def test_scan_skips_row_groups(spark, series, tmp_dir):
    laid = write_series(series, f"{tmp_dir}/laid", row_group_bytes=64 << 10)
    plain = f"{tmp_dir}/plain"
    series.write.option("parquet.block.size", 64 << 10).parquet(plain)
    total = series.count()
    found = groups(laid)
    assert sum(g[0] for g in found) == total and len(found) >= 20
    areas = [10, 2990]
    wanted = nested_series_scan(spark, laid, freq="Q", areas=areas)
    read, n = rows_read(wanted)
    assert n == 2
    hit = [g for g in found if g[1] <= "Q" <= g[2] and any(g[3] <= a <= g[4] for a in areas)]
    assert len(hit) < len(found) / 5 and read <= sum(g[0] for g in hit) < total / 5
    same = nested_series_scan(spark, plain, freq="Q", areas=areas)
    read_plain, n = rows_read(same)
    assert n == 2 and read_plain > 5 * read
    key = lambda rows: sorted((r.freq, r.ref_area, str(r.obs)) for r in rows)
    assert key(wanted.collect()) == key(same.collect())
    # an area that no series has: between the least and greatest of its groups
    assert rows_read(nested_series_scan(spark, laid, freq="Q", areas=[1001]))[1] == 0


def test_a_hot_area_is_cut_over_files(spark, series, tmp_dir):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # this table is small enough to be merged
    try:
        laid = write_series(series, f"{tmp_dir}/hot")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{laid}/*.parquet")]
    assert max(sizes) < series.count() / 3


def test_missing_keys_repeats_and_empty(spark, tmp_dir):
    rows = [("A", None, []), ("A", 1, None), ("A", 1, None), (None, 2, [])]
    df = spark.createDataFrame(rows, SERIES_SCHEMA)
    back = spark.read.parquet(write_series(df, f"{tmp_dir}/a")).collect()
    assert sorted(map(str, back)) == sorted(map(str, df.collect()))
    assert spark.read.schema(SERIES_SCHEMA).parquet(write_series(df.limit(0), f"{tmp_dir}/b")).count() == 0
    with pytest.raises(ValueError, match="no such columns: indicator"):
        write_series(df, f"{tmp_dir}/c", keys=("indicator", "ref_area"))
