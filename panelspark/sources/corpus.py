"""Corpus scan: documents with their metadata, one row per document."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.tables import scan_table


def corpus_scan(spark: SparkSession, base_dir: str, group_col: str = "lang",
                groups: Sequence[str] | None = None, meta: Sequence[str] = ("source",)) -> DataFrame:
    """(doc_id, author, text, meta...) where ``author`` is the grouping column.

    ``groups`` is an IN-list on the grouping column, pushed into the parquet scan. The texts
    are read in the splits of the files; nothing shuffles them.
    """
    docs = scan_table(spark, base_dir, "documents", ["doc_id", "text", group_col, *meta])
    if groups is not None:
        docs = docs.where(F.col(group_col).isin(list(groups)))
    return docs.select("doc_id", F.col(group_col).alias("author"), "text", *meta)
