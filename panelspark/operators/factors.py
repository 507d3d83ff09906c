"""Ordered categories: text columns whose levels and their order are column metadata.

The levels travel with the column through selections, filters, grouping and Parquet files.
Sorting follows them (``factor_sort``), unions and joins merge them (``factor_union``,
``factor_join``): two orders merge if the levels they share come in the same order in both, else
it is an error. A value that is no level is NULL, as is a missing one; NULL sorts last.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "levels"


def levels_of(df: DataFrame, name: str) -> list[str]:
    """The levels of a factor; an error if the column is none."""
    found = df.schema[name].metadata.get(KEY)
    if found is None:
        raise ValueError(f"{name} is not a factor")
    return list(found)


def is_factor(df: DataFrame, name: str) -> bool:
    return KEY in df.schema[name].metadata


def as_factor(df: DataFrame, name: str, levels: Sequence[str]) -> DataFrame:
    """Give a text column its levels in order; values that are no level become NULL."""
    if len(set(levels)) != len(levels) or None in levels:
        raise ValueError(f"levels of {name} repeat or are missing: {list(levels)}")
    value = F.when(F.col(name).isin(*levels), F.col(name)) if levels else F.lit(None).cast("string")
    return df.withColumn(name, value.cast("string").alias(name, metadata={KEY: list(levels)}))


def with_levels(df: DataFrame, name: str, levels: Sequence[str]) -> DataFrame:
    """The same values under other metadata (all values must be levels already)."""
    return df.withMetadata(name, {**df.schema[name].metadata, KEY: list(levels)})


def level_number(df: DataFrame, name: str) -> Column:
    """Place of the value among its levels, from 1; NULL for a missing one."""
    places = F.array_position(F.array(*map(F.lit, levels_of(df, name))), F.col(name))
    return F.when(places > 0, places).cast("int")


def merged_levels(a: Sequence[str], b: Sequence[str], name: str = "") -> list[str]:
    """An order that keeps both: levels between two shared ones come from ``a``, then from ``b``."""
    shared = [x for x in a if x in set(b)]
    if shared != [x for x in b if x in set(a)]:
        raise ValueError(f"levels of {name} clash: {list(a)} and {list(b)}")
    out, i, j = [], 0, 0
    for x in [*shared, None]:
        end_a, end_b = (list(a).index(x), list(b).index(x)) if x is not None else (len(a), len(b))
        out += [*a[i:end_a], *b[j:end_b], *([x] if x is not None else [])]
        i, j = end_a + 1, end_b + 1
    return out


def factor_sort(df: DataFrame, *names: str) -> DataFrame:
    """Sort by factors in the order of their levels, by other columns as they are; NULL last."""
    return df.orderBy(*[(level_number(df, n) if is_factor(df, n) else F.col(n)).asc_nulls_last() for n in names])


def factor_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by name; factors keep their merged levels. A factor must be one in both."""
    out = a.unionByName(b)
    for n in a.columns:
        if is_factor(a, n) != is_factor(b, n):
            raise ValueError(f"{n} is a factor on one side only")
        if is_factor(a, n):
            out = with_levels(out, n, merged_levels(levels_of(a, n), levels_of(b, n), n))
    return out


def factor_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by name; factors among the keys keep their merged levels, all others their own."""
    for n in on:
        if is_factor(a, n) != is_factor(b, n):
            raise ValueError(f"{n} is a factor on one side only")
    out = a.join(b, list(on), how)
    for n in on:
        if is_factor(a, n):
            out = with_levels(out, n, merged_levels(levels_of(a, n), levels_of(b, n), n))
    return out


def drop_unused(df: DataFrame, name: str) -> DataFrame:
    """Leave only levels that occur (one aggregate; as many rows reach the driver as there are levels)."""
    seen = {r[0] for r in df.where(F.col(name).isNotNull()).select(name).distinct().toLocalIterator()}
    return with_levels(df, name, [x for x in levels_of(df, name) if x in seen])
