"""Nested series source: records of (freq, ref_area, obs array<struct<day, value>>)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES_SCHEMA = "freq string, ref_area bigint, obs array<struct<day: date, value: double>>"
#: Yearly series between two areas, as a data service delivers them: times and values are text.
TRADE_SERIES_SCHEMA = ("freq string, ref_area string, counterpart_area string, "
                       "obs array<struct<time: string, value: string>>")


def nested_series_scan(spark: SparkSession, path: str, freq: str | None = None,
                       areas: Sequence | None = None, start=None, end=None,
                       schema: str = SERIES_SCHEMA, time: str = "day") -> DataFrame:
    """Read nested series with a declared schema.

    ``freq`` and ``areas`` are filters on top-level columns and reach the Parquet scan;
    ``start`` / ``end`` keep only observations inside the range of ``time``, inside each array
    (a higher-order ``filter``, no explode).
    """
    df = spark.read.schema(schema).parquet(path)
    if freq is not None:
        df = df.where(F.col("freq") == freq)
    if areas is not None:
        df = df.where(F.col("ref_area").isin(list(areas)))
    if start is not None or end is not None:
        def keep(o):
            cond = F.lit(True)
            if start is not None:
                cond = cond & (o[time] >= F.lit(start))
            if end is not None:
                cond = cond & (o[time] <= F.lit(end))
            return cond
        df = df.withColumn("obs", F.filter("obs", keep))
    return df


def write_series(series: DataFrame, path: str, keys: Sequence[str] = ("freq", "ref_area"),
                 row_group_bytes: int = 8 << 20, distinct_in_group: int = 4096) -> str:
    """Write series so that a scan for some frequencies and areas skips the rest; returns ``path``.

    Rows are range-partitioned and sorted by ``keys`` and then by a hash of the whole row: the rows of
    one area lie together, and an area with a large share of all rows is cut over several files
    instead of making one task. Row groups are small, so each spans few keys and its minimum and
    maximum rule it out for most areas; Bloom filters of the keys, sized for ``distinct_in_group``
    values, rule out those areas that lie between the two but are missing. They are left out by the
    writer where a dictionary of all values serves the same end.

    A scan's IN-list reaches the file as such up to ``spark.sql.parquet.pushdown.inFilterThreshold``
    values (10 by default) and beyond them as its least and greatest value; results are the same.
    Rows that repeat are written as often; a missing key sorts first; an empty table is written as
    files without rows.
    """
    missing = [k for k in keys if k not in series.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    order = [F.col(k).asc_nulls_first() for k in keys] + [F.xxhash64(*series.columns).asc()]
    writer = series.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option(
        "parquet.block.size", row_group_bytes)
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{k}", distinct_in_group)
    writer.parquet(path)
    return path


def unnest_obs(series: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per observation: the series' columns and those of its observations."""
    gen = F.inline_outer if keep_empty else F.inline
    return series.select(*[c for c in series.columns if c != "obs"], gen("obs"))
