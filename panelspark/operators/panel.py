"""Panel (unit x time) operators.

A panel is a DataFrame plus a :class:`PanelSpec` naming the unit columns, the integer time
column and the time step. Every time operator is a window over ``partitionBy(unit)
.orderBy(time)``; because (unit, time) is unique (see :func:`panel_summary`), one window
partition holds at most one row per period, so partitions are bounded by the length of
the time axis and never by the size of the data. All operators that share a panel share
one hash exchange and one sort: Catalyst puts window expressions with the same partition
and order keys into a single ``Window`` node.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.semantics import col, ifelse_na, rdiv, rln


@dataclass(frozen=True)
class PanelSpec:
    unit: Sequence[str]
    time: str
    step: int = 1
    _unit: tuple = field(init=False, repr=False, default=())

    def __post_init__(self):
        object.__setattr__(self, "_unit", tuple([self.unit] if isinstance(self.unit, str) else self.unit))

    @property
    def units(self) -> list[str]:
        return list(self._unit)

    def ordered(self):
        """``partitionBy(unit).orderBy(time)``."""
        return Window.partitionBy(*self.units).orderBy(self.time)

    def by_unit(self):
        """``partitionBy(unit)`` without order (whole-unit aggregates)."""
        return Window.partitionBy(*self.units)


# ---------------------------------------------------------------- validation


def panel_summary(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per unit: periods, first and last period, gaps and duplicate (unit, time) rows.

    A plain aggregate (partial + final), so it scales with the number of units.
    """
    t = F.col(spec.time)
    per_cell = df.groupBy(*spec.units, spec.time).agg(F.count(F.lit(1)).alias("_rows"))
    return per_cell.groupBy(*spec.units).agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.min(t).alias("first_period"),
        F.max(t).alias("last_period"),
        ((F.max(t) - F.min(t)) / F.lit(spec.step) + 1 - F.count(F.lit(1))).cast("bigint").alias("n_gaps"),
        (F.sum("_rows") - F.count(F.lit(1))).cast("bigint").alias("n_duplicates"),
    )


def assert_unique(df: DataFrame, spec: PanelSpec) -> None:
    """Fail loudly when a (unit, time) cell holds more than one row (one small job)."""
    dup = df.groupBy(*spec.units, spec.time).count().where("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"panel index is not unique, e.g. {dup[0].asDict()}")


# ---------------------------------------------------------------- lags


def lag_time(c: str | Column, spec: PanelSpec, periods: int = 1) -> Column:
    """Value of ``c`` at time t - periods*step of the same unit; NULL across a gap."""
    t = F.col(spec.time)
    w = spec.ordered()
    if periods == 1:
        return F.when(F.lag(t, 1).over(w) == t - spec.step, F.lag(col(c), 1).over(w))
    off = periods * spec.step
    return F.first(col(c)).over(w.rangeBetween(-off, -off))


def lag_row(c: str | Column, spec: PanelSpec, periods: int = 1) -> Column:
    """Value of ``c`` ``periods`` rows earlier within the unit, whatever the time gap."""
    return F.lag(col(c), periods).over(spec.ordered())


def growth(c: str | Column, spec: PanelSpec, lagger=lag_time) -> Column:
    """Growth rate (x_t - x_{t-1}) / x_{t-1} with IEEE division."""
    prev = lagger(c, spec)
    return rdiv(col(c) - prev, prev)


def dlog(c: str | Column, spec: PanelSpec, lagger=lag_time) -> Column:
    """Log difference ln x_t - ln x_{t-1} (ln 0 = -inf, ln of a negative = NaN)."""
    x = col(c)
    return rln(x) - rln(lagger(x, spec))


def with_lags(df: DataFrame, spec: PanelSpec, cols: Iterable[str], lagger=lag_time,
              prefix: str = "_lag_") -> DataFrame:
    """Add one lag column per input column (all in one window node).

    Computing each lag once as a named column keeps the later arithmetic on plain
    columns: the IEEE helpers reference their arguments several times, and repeating a
    window expression inside them makes analysis slower without changing the plan.
    """
    return df.withColumns({f"{prefix}{c}": lagger(F.col(c), spec) for c in cols})


def held_lag(c: str, spec: PanelSpec, prefix: str = "_lag_") -> Column:
    """A lag that :func:`with_lags` has put into a column (to pass as ``lagger``)."""
    return F.col(f"{prefix}{c}")


def dlog_many(df: DataFrame, spec: PanelSpec, cols: Iterable[str], lagger=lag_time) -> DataFrame:
    """Replace each column by its log difference; one window node serves all columns."""
    cols = list(cols)
    lagged = with_lags(df, spec, cols, lagger, "_lag_")
    return lagged.withColumns({c: rln(c) - rln(f"_lag_{c}") for c in cols}).drop(
        *[f"_lag_{c}" for c in cols])


def drop_first_period(df: DataFrame, spec: PanelSpec, first: int | None = None) -> DataFrame:
    """Drop the first period (given, or each unit's own first period)."""
    if first is not None:
        return df.where(F.col(spec.time) != F.lit(first))
    first_t = F.min(spec.time).over(spec.by_unit())
    return df.withColumn("_first", first_t).where(F.col(spec.time) != F.col("_first")).drop("_first")


def null_at(c: Column, spec: PanelSpec, period: int) -> Column:
    """``c`` except at ``period`` where it is NULL (the guard the analyses put on base years)."""
    return ifelse_na(F.col(spec.time) == F.lit(period), F.lit(None), c)


# ---------------------------------------------------------------- shares and weights


def lagged_share(a: str, b: str, spec: PanelSpec, lagger=lag_time) -> tuple[Column, Column]:
    """(s_a, s_b) with s_a = L(a) / (L(a) + L(b)) and s_b = 1 - s_a."""
    la, lb = lagger(a, spec), lagger(b, spec)
    s_a = rdiv(la, la + lb)
    return s_a, F.lit(1.0) - s_a


def lagged_ratio(num: str, den: str, spec: PanelSpec, lagger=lag_time) -> Column:
    """L(num) / L(den), e.g. a trade weight from last period's exports."""
    return rdiv(lagger(num, spec), lagger(den, spec))


# ---------------------------------------------------------------- base periods and indices


def base_value(c: str | Column, spec: PanelSpec, period: int) -> Column:
    """Value of ``c`` at ``period`` carried to every row of the unit (NULL if absent)."""
    return F.max(F.when(F.col(spec.time) == F.lit(period), col(c))).over(spec.by_unit())


def has_period(spec: PanelSpec, period: int) -> Column:
    return F.max(F.when(F.col(spec.time) == F.lit(period), F.lit(1))).over(spec.by_unit()).isNotNull()


def index_to_base(df: DataFrame, c: str, spec: PanelSpec, period: int, out: str,
                  base_col: str | None = None) -> DataFrame:
    """out = 100 * c / c[base period]; units without a base-period row are dropped."""
    tmp = base_col or "_base"
    res = (
        df.withColumns({"_has_base": has_period(spec, period), tmp: base_value(c, spec, period)})
        .where("_has_base")
        .withColumn(out, F.lit(100.0) * rdiv(F.col(c), F.col(tmp)))
        .drop("_has_base")
    )
    return res if base_col else res.drop(tmp)


def chain_index(df: DataFrame, growth_col: str, time: str, out: str, base: float = 100.0,
                partition: Sequence[str] = ()) -> DataFrame:
    """Chained index base * prod(1 + g) over time.

    Meant for series with one row per period (after aggregating over units), so the
    window holds at most one row per period of each ``partition`` group.
    """
    w = Window.partitionBy(*partition).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.product(F.lit(1.0) + F.col(growth_col)).over(w) * F.lit(base))


def series_splice(time: str, cutoff: int, after: Column, upto: Column) -> Column:
    """``after`` for periods beyond ``cutoff``, ``upto`` otherwise (NULL time gives NULL)."""
    return ifelse_na(F.col(time) > F.lit(cutoff), after, upto)


def log_rebase(c: str | Column, spec: PanelSpec) -> Column:
    """ln(x / x at the unit's first period)."""
    first = F.min_by(col(c), F.col(spec.time)).over(spec.by_unit())
    return rln(rdiv(col(c), first))
