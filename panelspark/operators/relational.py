"""Relational helpers: joins with R-style options, key bridges, dense ids, top-k with ties."""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.semantics import col, is_missing
from panelspark.session import materialize


# ---------------------------------------------------------------- joins


def join_suffix(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join on ``on``; non-key columns present on both sides get ``_x`` / ``_y`` suffixes."""
    on = list(on)
    clash = [c for c in left.columns if c in right.columns and c not in on]
    lft = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    rgt = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return lft.join(rgt, on, how)


def join_na_match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                  na_match: bool = True) -> DataFrame:
    """Equi-join where, with ``na_match``, a NULL key matches a NULL key (``<=>``).

    The result keeps one copy of each key column (the left one, or the right one where
    the left row is absent). Like any equi-join, rows sharing a key pair up; with NULL
    matching, all NULL-key rows share one key, so join against a keyed table (one row per
    key, e.g. an aggregate) when many keys may be NULL.
    """
    on = list(on)
    if not na_match:
        return left.join(right, on, how)
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    cond = None
    for k in on:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    j = left.join(r, cond, how)
    keys = {k: F.coalesce(F.col(k), F.col(f"_r_{k}")) if how in ("right", "full", "outer") else F.col(k)
            for k in on}
    return j.withColumns(keys).drop(*[f"_r_{k}" for k in on])


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every column name the two sides share."""
    on = [c for c in left.columns if c in right.columns]
    if not on:
        raise ValueError(f"natural_join: no shared column in {left.columns} and {right.columns}")
    return left.join(right, on, how)


def semi_restrict(keys: DataFrame, facts: DataFrame, on: Sequence[str], keep_unmatched: bool = True) -> DataFrame:
    """Restrict facts to a sample of units.

    The facts are reduced first, by a left-semi join with the distinct sample keys (a small
    key table is broadcast by the planner, so the facts are not shuffled). ``keep_unmatched``
    then adds the sample units without facts, as the left join from the keys in the analysis
    does: the keys that no reduced fact has, found by an anti join.
    """
    on = list(on)
    k = keys.select(*on).distinct()
    kept = facts.join(k, on, "left_semi")
    if not keep_unmatched:
        return kept
    units = kept.select(*on).distinct()
    missing = k.join(units, on, "left_anti")
    rest = [c for c in facts.columns if c not in on]
    empty = missing.select(*on, *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in rest])
    return kept.select(*on, *rest).unionByName(empty)


def key_override(c: str, key_col: str, overrides: Mapping[str, object]) -> Column:
    """Force ``c`` to a constant for listed keys (a NULL key keeps NULL, as an if-else on NA)."""
    key = F.col(key_col)
    expr = F.col(c)
    for k, v in overrides.items():
        expr = F.when(key.isNull(), F.lit(None)).when(key == F.lit(k), F.lit(v)).otherwise(expr)
    return expr


def bridge(facts: DataFrame, crosswalk: DataFrame, first_key: str, second_key: str,
           target: DataFrame, target_keys: Sequence[str]) -> DataFrame:
    """Two-hop key bridge: facts -(first_key)-> crosswalk -(second_key + others)-> target."""
    step = facts.join(crosswalk, first_key, "left")
    return step.join(target, list(target_keys), "left")


# ---------------------------------------------------------------- ordering and ids


def sequence_number(df: DataFrame, order: Sequence[Column | str], out: str,
                    group: Sequence[str] = ()) -> DataFrame:
    """1-based row number (bigint) by ``order`` within ``group`` without a single-task window.

    The rows are range-partitioned and sorted on (group, order), numbered within their
    partition and written once to the shared checkpoint folder, so the numbering is stable if
    a task is recomputed. A second, small table has one row per (partition, group): where the
    group starts in the partition and how many of its rows are in earlier partitions. It is
    written too, so the planner knows its size and broadcasts it: the numbered rows are not
    shuffled again. Without a group it has one row per partition; with groups it exceeds
    their number by less than the number of partitions.
    """
    group = list(group)
    keys = [F.col(g) for g in group] + [col(o) for o in order]
    s = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    s = materialize(s.withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}), "seq")
    parts = s.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_min"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_min") + 1
    parts = materialize(parts.select(F.col("_pid").alias("_p_pid"), offset.alias("_add"),
                                     *[F.col(g).alias(f"_p_{g}") for g in group]), "seq-parts")
    j = s.join(parts, _cond(group), "inner")
    return j.withColumn(out, (F.col("_mid") + F.col("_add")).cast("bigint")).drop(
        "_mid", "_pid", "_add", "_p_pid", *[f"_p_{g}" for g in group])


def _cond(group: Sequence[str]) -> Column:
    c = F.col("_pid") == F.col("_p_pid")
    for g in group:
        c = c & F.col(g).eqNullSafe(F.col(f"_p_{g}"))
    return c


def dense_id(df: DataFrame, keys: Sequence[str], out: str, na_gets_id: bool = True) -> DataFrame:
    """Dense 1-based id of the composite key, ordered by the key (NULLs last).

    The numbering runs on the distinct key table (distributed, see
    :func:`sequence_number`) and is joined back. With ``na_gets_id=False`` a row with a
    NULL key part keeps a NULL id (factor codes).
    """
    keys = list(keys)
    distinct = df.select(*keys).distinct()
    if not na_gets_id:
        cond = None
        for k in keys:
            c = F.col(k).isNotNull()
            cond = c if cond is None else cond & c
        distinct = distinct.where(cond)
    ids = sequence_number(distinct, [F.col(k).asc_nulls_last() for k in keys], out)
    ids = ids.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    return df.join(ids, cond, "left").drop(*[f"_k_{k}" for k in keys])


def top_k_ties(df: DataFrame, group: Sequence[str], value: Column | str, k: int, rank_col: str | None = None,
               largest: bool = True) -> DataFrame:
    """Rows whose rank by ``value`` within ``group`` is <= k; ties at the k-th place are kept.

    NULL and NaN rank last, after every number. ``rank() <= k`` is planned with a partial
    WindowGroupLimit before the exchange, so each map task ships at most its own top k (plus
    ties) per group.
    """
    v = col(value)
    if df.select(v.alias("v")).schema["v"].dataType.typeName() in ("double", "float"):
        v = F.when(~F.isnan(v), v)
    w = Window.partitionBy(*group).orderBy(F.desc_nulls_last(v) if largest else F.asc_nulls_last(v))
    name = rank_col or "_rank"
    out = df.withColumn(name, F.rank().over(w)).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)


# ---------------------------------------------------------------- aggregation helpers


def sum_dropping_missing(df: DataFrame, value: str, by: Sequence[str], out: str | None = None) -> DataFrame:
    """Sum by group after dropping rows where the value is NULL or NaN (formula aggregate)."""
    return df.where(~is_missing(value)).groupBy(*by).agg(F.sum(value).alias(out or value))


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
