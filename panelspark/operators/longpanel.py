"""Lags, running products and first values of panels whose units are long.

The windows of :mod:`panelspark.operators.panel` put a unit into one task. Here the rows are
range-partitioned by (unit, time) and written once, so a unit that holds most of the rows lies in
many partitions. What crosses a partition's edge is small and written as a table of its own:

* lags: the last rows of every partition (the halo), given to the partitions that go on with their
  unit;
* running products: each partition's product per unit, multiplied up over earlier partitions;
* first values: each unit's first value, by partition.

Afterwards every window is over (partition, unit), never over a unit. Rows with the same unit and
time are not allowed, as for every panel operator; a missing unit is a unit like any other.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.semantics import rdiv, rln
from panelspark.operators.panel import PanelSpec, lag_row, lag_time
from panelspark.session import materialize


class LongPanel:
    """A panel in written partitions; every method returns a new one with further columns."""

    def __init__(self, df: DataFrame, spec: PanelSpec, partitions: int | None = None, _placed: bool = False):
        self.spec = spec
        if not _placed:
            keys = [F.col(c) for c in (*spec.units, spec.time)]
            dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
            df = materialize(dealt.sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()), "long-panel")
        self.placed = df

    @property
    def rows(self) -> DataFrame:
        return self.placed.drop("_pid")

    @property
    def local(self) -> PanelSpec:
        """The same panel cut at the partitions' edges."""
        return PanelSpec(["_pid", *self.spec.units], self.spec.time, self.spec.step)

    def _with(self, df: DataFrame) -> "LongPanel":
        return LongPanel(df, self.spec, _placed=True)

    def _per_part(self, *aggs) -> DataFrame:
        """One written row for every (partition, unit): units and partitions in number."""
        return materialize(self.placed.groupBy("_pid", *self.spec.units).agg(*aggs), "long-panel-parts")

    def _joined(self, parts: DataFrame, columns: list[str]) -> DataFrame:
        """``columns`` of ``parts`` joined to the rows by (partition, unit), which splits long units."""
        named = parts.select(F.col("_pid").alias("_p_pid"), *[F.col(u).alias(f"_p_{u}") for u in self.spec.units], *columns)
        cond = F.col("_pid") == F.col("_p_pid")
        for u in self.spec.units:
            cond = cond & F.col(u).eqNullSafe(F.col(f"_p_{u}"))
        return self.placed.join(named, cond, "left").drop("_p_pid", *[f"_p_{u}" for u in self.spec.units])

    def halo(self, columns: Iterable[str], rows: int) -> DataFrame:
        """(_pid, units, time, columns): for every partition the ``rows`` rows of its first unit that
        precede it, from whichever partitions hold them."""
        units, time = self.spec.units, self.spec.time
        columns = [c for c in dict.fromkeys(columns) if c not in (*units, time)]
        back = Window.partitionBy("_pid").orderBy(*[F.col(u).desc() for u in units], F.col(time).desc())
        tail = self.placed.select("_pid", *units, time, *columns).withColumn("_at", F.row_number().over(back)).where(
            F.col("_at") <= rows).drop("_at")
        tail = materialize(tail, "halo-tails")                       # ``rows`` rows a partition
        held = Window.partitionBy(*units).orderBy(time).rowsBetween(-(rows - 1), 0)
        sent = tail.select("_pid", *units, F.lit(1).alias("_kind"), F.col(time).alias("_t"),
                           F.collect_list(F.struct(time, *columns)).over(held).alias("_held"))
        first = self.placed.groupBy("_pid").agg(F.min(F.struct(*units)).alias("_u")).select(
            "_pid", *[F.col(f"_u.{u}").alias(u) for u in units], F.lit(0).alias("_kind"),
            F.lit(None).cast(self.placed.schema[time].dataType).alias("_t"), F.lit(None).alias("_held"))
        before = Window.partitionBy(*units).orderBy("_pid", "_kind", "_t").rowsBetween(Window.unboundedPreceding, -1)
        told = sent.unionByName(first).withColumn("_halo", F.last("_held", ignorenulls=True).over(before)).where("_kind = 0")
        return materialize(told.select("_pid", *units, F.inline("_halo")), "halo")

    def lags(self, columns: Iterable[str], periods: int = 1, by: str = "time", prefix: str = "lag_") -> "LongPanel":
        """Add the lag of every column, by time (a gap gives NULL) or by row."""
        columns, lagger = list(columns), {"time": lag_time, "row": lag_row}[by]
        # within ``periods`` steps of an integer time there are at most that many other rows
        rows = periods * self.spec.step if by == "time" else periods
        halo = self.halo(columns, rows).withColumn("_own", F.lit(False))
        both = self.placed.withColumn("_own", F.lit(True)).unionByName(halo, allowMissingColumns=True)
        lagged = both.withColumns({f"{prefix}{c}": lagger(F.col(c), self.local, periods) for c in columns})
        return self._with(lagged.where("_own").drop("_own"))

    def running_product(self, factor: str, out: str) -> "LongPanel":
        """Add the product of ``factor`` over a unit's rows up to and including this one (a missing
        factor is left out)."""
        units = self.spec.units
        parts = self._per_part(F.product(factor).alias("_part"))
        earlier = Window.partitionBy(*units).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("_pid", *units, F.product("_part").over(earlier).alias("_carry"))
        upto = self.local.ordered().rowsBetween(Window.unboundedPreceding, 0)
        one = self._joined(parts, ["_carry"]).withColumn("_run", F.product(factor).over(upto))
        # a product without any factor is missing
        whole = F.when(F.col("_carry").isNull(), F.col("_run")).when(F.col("_run").isNull(), F.col("_carry")).otherwise(
            F.col("_carry") * F.col("_run"))
        return self._with(one.withColumn(out, whole).drop("_carry", "_run"))

    def first_value(self, column: str, out: str) -> "LongPanel":
        """Add ``column`` at the unit's first period."""
        units = self.spec.units
        parts = self._per_part(F.min_by(F.struct(column), self.spec.time).alias("_first"))
        whole = Window.partitionBy(*units).orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        parts = parts.select("_pid", *units, F.first("_first").over(whole)[column].alias(out))
        return self._with(self._joined(parts, [out]))


def chain_index_scan(panel: LongPanel, growth: str, out: str, base: float = 100.0) -> LongPanel:
    """Chained index base * prod(1 + growth) over each unit's time."""
    grown = LongPanel(panel.placed.withColumn("_factor", F.lit(1.0) + F.col(growth)), panel.spec, _placed=True)
    done = grown.running_product("_factor", out)
    return LongPanel(done.placed.withColumn(out, F.col(out) * F.lit(base)).drop("_factor"), panel.spec, _placed=True)


def log_rebase_scan(panel: LongPanel, column: str, out: str) -> LongPanel:
    """ln(x / x at the unit's first period)."""
    done = panel.first_value(column, "_base")
    return LongPanel(done.placed.withColumn(out, rln(rdiv(F.col(column), F.col("_base")))).drop("_base"), panel.spec, _placed=True)
