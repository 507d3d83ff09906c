"""Text-file scans and sinks: headered CSV, headerless multi-file CSV, fixed-width text,
year-by-file attachment, and write / read-back round trips.

Every reader takes an explicit schema (no inference pass over the data) and reads all
files of a folder in one scan, so files are split across tasks instead of being read one
after another on the driver.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv_header(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header row; columns are bound by the declared schema's names."""
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("recursiveFileLookup", True).csv(path))


def read_csv_multi(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Headerless CSV files of one folder; names come from the schema by position.

    Ids should be declared ``string`` so long numeric codes keep every digit.
    """
    return (spark.read.schema(schema).option("header", False)
            .option("recursiveFileLookup", True).csv(path))


def read_fixed_width(spark: SparkSession, path: str,
                     fields: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Fixed-width text: (name, start, end) with 1-based inclusive positions.

    Values are trimmed; an empty field is NULL. Everything is a string; cast afterwards.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    cols = [
        F.nullif(F.trim(F.substring("value", start, end - start + 1)), F.lit("")).alias(name)
        for name, start, end in fields
    ]
    return raw.select(*cols, F.col("_metadata.file_path").alias("_file"))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:/*"
_PART = r"/part-[^/]*$"


def with_file(df: DataFrame) -> DataFrame:
    return df if "_file" in df.columns else df.withColumn("_file", F.col("_metadata.file_path"))


def _norm_path(c):
    """A file URI without its scheme and leading slashes (file:/a and file:///a agree)."""
    return F.regexp_replace(c, _SCHEME, "")


def year_by_file_order(df: DataFrame, first_year: int, n_years: int, out: str = "year") -> DataFrame:
    """Attach ``first_year + position`` of each row's file in the sorted file list.

    A "file" is what holds one year: a single file, or a folder that a distributed writer has
    filled with part files (``part-...``). ``n_years`` files are required: with one missing or
    added, positions would name the wrong years, which is an error. The names come from the list
    the driver holds for planning the scan; what is broadcast has one row a year.
    """
    spark = df.sparkSession
    units = sorted({re.sub(_PART, "", re.sub(_SCHEME, "", f)) for f in df.inputFiles()})
    if len(units) != n_years:
        raise ValueError(f"{n_years} yearly files are expected from {first_year} on, found {len(units)}: {units[:20]}")
    table = spark.createDataFrame([(u, first_year + i) for i, u in enumerate(units)], f"_fkey string, {out} int")
    keyed = with_file(df).withColumn("_fkey", F.regexp_replace(_norm_path(F.col("_file")), _PART, ""))
    return keyed.join(F.broadcast(table), "_fkey").drop("_file", "_fkey")


# ---------------------------------------------------------------- sinks


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header row (no row-number column)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_yearly(df: DataFrame, path: str, fmt: str, year: str = "year", files_per_year: int = 4) -> str:
    """One folder per year with up to ``files_per_year`` part files, so a year is not one task."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != year]), F.lit(files_per_year))
    w = df.repartition(F.col(year), salt).write.mode("overwrite").partitionBy(year)
    if fmt == "text":
        w.text(path)
    else:
        w.option("header", False).csv(path)
    return path
