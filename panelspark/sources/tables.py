"""Parquet table scans with column pruning at the source."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table_path(base_dir: str, name: str) -> str:
    return f"{base_dir.rstrip('/')}/{name}.parquet"


def scan_table(spark: SparkSession, base_dir: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Read one parquet table; listing ``columns`` keeps the scan's ReadSchema narrow."""
    df = spark.read.parquet(table_path(base_dir, name))
    return df.select(*columns) if columns else df

