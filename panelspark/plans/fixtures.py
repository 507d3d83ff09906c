"""Reference-shaped inputs derived from the test tables.

The analyses expect a country x year national-accounts panel with bilateral exports, a
city x year crime panel with police and population files, and a corpus. These builders
derive stand-ins from the star-schema tables so that every plan reads real tables and its
work grows with them. Money has two decimals, so it is summed exactly as integer cents
(``bigint``: exact, independent of summation order, overflow-checked under ANSI, and far
cheaper than wide decimals) and turned into ``double`` once, after the sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import materialize
from panelspark.sources.tables import scan_table


@dataclass(frozen=True)
class TradeParams:
    reporter: str = "NATION_3"
    reporter_key: int = 3
    reporter_iso2: str = "ZD"
    first_year: int = 1995
    last_year: int = 2001
    base_year: int = 1995
    periods: tuple = ((1995, 1997), (1998, 2000))


def cents(c: str) -> F.Column:
    """A two-decimal amount as exact integer hundredths."""
    return F.round(F.col(c) * 100).cast("bigint")


def from_cents(total: F.Column, scale: int = 100) -> F.Column:
    return total / F.lit(float(scale))


def order_facts(spark: SparkSession, base_dir: str) -> DataFrame:
    """orders joined to their customer: key, year, customer nation, segment, status, price."""
    o = scan_table(spark, base_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                    "o_orderpriority"])
    c = scan_table(spark, base_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", "o_custkey",
        F.year("o_orderdate").cast("int").alias("year"),
        F.col("c_nationkey").alias("m"),
        "c_mktsegment", "o_orderstatus", "o_orderpriority",
        cents("o_totalprice").alias("price"),
    )


def trade_flows(spark: SparkSession, base_dir: str, orders: DataFrame) -> DataFrame:
    """Bilateral flow cube: value and quantity by (year, exporter x, importer m, return flag).

    The cube has at most years x nations^2 x flags rows, so the fact-side work is one
    partial + final aggregation after the joins. ``orders`` are the order facts.
    """
    li = scan_table(spark, base_dir, "lineitem",
                    ["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity",
                     "l_returnflag"])
    s = scan_table(spark, base_dir, "supplier", ["s_suppkey", "s_nationkey"])
    o = orders.select("o_orderkey", "year", "m")
    # net value in 1/10000 units: cents * (100 - discount in hundredths), exact
    v = cents("l_extendedprice") * (F.lit(100) - cents("l_discount"))
    return (
        li.join(s, li.l_suppkey == s.s_suppkey)
        .join(o, li.l_orderkey == o.o_orderkey)
        .groupBy("year", F.col("s_nationkey").alias("x"), "m", F.col("l_returnflag").alias("rf"))
        .agg(from_cents(F.sum(v), 10000).alias("v"), from_cents(F.sum(cents("l_quantity"))).alias("q"))
    )


# Fixed values of the stand-in: the country that the code file lacks and whose codes are put in
# by hand, the one whose code is wrong there, and the one without a two-letter code.
NOT_IN_FILE, WRONG_IN_FILE, NO_ISO2 = "NATION_5", "NATION_9", "NATION_24"


def code_list(spark: SparkSession, base_dir: str) -> DataFrame:
    """(country, iso2c, iso3c): the code dimension. Its country names differ in case from those of
    the data, and one country has no two-letter code."""
    n = scan_table(spark, base_dir, "nation", ["n_nationkey", "n_name"])
    iso2 = F.concat(F.lit("Z"), F.char(F.col("n_nationkey") + 65))
    return n.select(F.initcap("n_name").alias("country"),
                    F.when(F.col("n_name") != NO_ISO2, iso2).alias("iso2c"),
                    F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso3c"))


def code_file(spark: SparkSession, base_dir: str) -> DataFrame:
    """(country, partner_iso): the code file with the data's country names and lower-case codes;
    one country is missing, one has a code that no list knows."""
    n = scan_table(spark, base_dir, "nation", ["n_nationkey", "n_name"]).where(F.col("n_name") != NOT_IN_FILE)
    code = F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    return n.select(F.col("n_name").alias("country"),
                    F.when(F.col("n_name") == WRONG_IN_FILE, F.lit("x99")).otherwise(code).alias("partner_iso"))


def export_series(flows: DataFrame, codes: DataFrame, p: TradeParams) -> DataFrame:
    """Nested series of the reporter's exports to each partner: yearly totals as text (frequency
    "A"), and a second frequency that the analysis has to leave out. ``codes`` is (m, iso2c)."""
    yearly = flows.where((F.col("x") == p.reporter_key) & (F.col("m") != p.reporter_key)).groupBy("m", "year").agg(
        F.sum("v").alias("v"))
    obs = F.struct(F.col("year").cast("string").alias("time"), F.col("v").cast("string").alias("value"))
    nested = yearly.groupBy("m").agg(F.array_sort(F.collect_list(obs)).alias("obs")).join(codes, "m")
    kinds = F.explode(F.array(F.lit("A"), F.lit("Q")))
    return nested.select(kinds.alias("freq"), F.lit(p.reporter_iso2).alias("ref_area"),
                         F.col("iso2c").alias("counterpart_area"), "obs")


def national_accounts(spark: SparkSession, base_dir: str, p: TradeParams) -> tuple[DataFrame, DataFrame]:
    """((country, year) cells of expenditure and trade totals, bilateral flow cube), both written.

    Country cells are those with orders (the 'GDP' table); trade columns are NULL where a
    country has no flows in a year. Orders and customers are read and joined once: the narrow
    order facts are written and serve both the expenditure sums and the flows.
    """
    dbl = lambda c: c.cast("double")
    orders = materialize(order_facts(spark, base_dir).select("o_orderkey", "year", "m", "o_orderstatus", "price"),
                         "order_facts")
    gdp = orders.groupBy("m", "year").agg(
        from_cents(F.sum(F.when(F.col("o_orderstatus").isin("F", "P"), F.col("price")))).alias("cons_final"),
        from_cents(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("price")))).alias("gfcf_final"),
    )
    flows = materialize(trade_flows(spark, base_dir, orders), "trade_flows")
    # each flow row counts once for the importer and once for the exporter
    sides = flows.select(
        "year", "v", "q", "rf", "x", "m",
        F.explode(F.array(
            F.struct(F.col("m").alias("nation"), F.lit("imp").alias("side")),
            F.struct(F.col("x").alias("nation"), F.lit("exp").alias("side")),
        )).alias("s"),
    )
    imp = F.col("s.side") == "imp"
    exp_ = F.col("s.side") == "exp"
    trade = sides.groupBy(F.col("s.nation").alias("m"), "year").agg(
        dbl(F.sum(F.when(imp & (F.col("rf") != "R"), F.col("v")))).alias("cons_final_nominal"),
        dbl(F.sum(F.when(imp & (F.col("rf") == "R"), F.col("v")))).alias("gfcf_final_nominal"),
        dbl(F.sum(F.when(exp_, F.col("v")))).alias("nom_exports_dom"),
        dbl(F.sum(F.when(imp, F.col("v")))).alias("nom_imports_dom"),
        dbl(F.sum(F.when(exp_, F.col("q")))).alias("real_exports"),
        dbl(F.sum(F.when(imp, F.col("q")))).alias("real_imports"),
    )
    nation = scan_table(spark, base_dir, "nation", ["n_nationkey", "n_name"])
    cells = gdp.join(trade, ["m", "year"], "left").join(nation, F.col("m") == nation.n_nationkey)
    cells = cells.withColumnsRenamed({"n_name": "country", "m": "nation_key"}).drop("n_nationkey")
    return materialize(cells, "trade_cells"), flows


# ---------------------------------------------------------------- crime / police panel

# Fixed values of the stand-in: market segments in their id order, the priority and
# status categories that play the seven crime counts, and the cutoff / reference years.
UNIT_WITHOUT_FACTS = "99-NONE"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
VIOLENT_CATEGORIES = {
    "actual_murder": "1-URGENT",
    "actual_rape_total": "2-HIGH",
    "actual_robbery_total": "3-MEDIUM",
    "actual_assault_total": "4-NOT SPECIFIED",
}
PROPERTY_CATEGORIES = {
    "actual_burg_total": ("priority", "5-LOW"),
    "actual_theft_total": ("status", "F"),
    "actual_mtr_veh_theft_total": ("status", "P"),
}


@dataclass(frozen=True)
class CrimeParams:
    cutoff: int = 1998          # last year of the old series; files cover the years after it
    file_years: int = 3         # yearly files of each family
    reference_year: int = 1998  # year whose population becomes the weight W
    first_year: int = 1995      # first panel year (no growth there)
    sample_nations: int = 20    # units of nations below this form the sample
    id_scale: int = 100000      # the files carry GOVID * id_scale


def _ori7(m: str = "m", seg: str = "c_mktsegment"):
    return F.concat_ws("-", F.col(m).cast("string"), F.col(seg))


def _segment_index(seg: str = "c_mktsegment"):
    return (F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col(seg)) - 1).cast("bigint")


def crime_cells(spark: SparkSession, base_dir: str) -> DataFrame:
    """Order counts by category per (nation, segment, year) cell, plus cell totals."""
    o = order_facts(spark, base_dir)
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    cnt = lambda cond: F.count(F.when(cond, F.lit(1))).cast("double")
    aggs = [cnt(pr == v).alias(k) for k, v in VIOLENT_CATEGORIES.items()]
    aggs += [cnt((pr if kind == "priority" else st) == v).alias(k)
             for k, (kind, v) in PROPERTY_CATEGORIES.items()]
    aggs += [from_cents(F.sum("price")).alias("population"),
             F.count(F.lit(1)).alias("n_orders")]
    g = o.groupBy("m", "c_mktsegment", "year").agg(*aggs)
    return g.withColumns({
        "ORI7": _ori7(),
        "STATE": F.col("m").cast("string"),
        "actual_index_violent": sum((F.col(c) for c in VIOLENT_CATEGORIES), F.lit(0.0)),
        "actual_index_property": sum((F.col(c) for c in PROPERTY_CATEGORIES), F.lit(0.0)),
    })


UCR_COLUMNS = ["ORI7", "STATE", "year", *VIOLENT_CATEGORIES, *PROPERTY_CATEGORIES,
               "actual_index_property", "actual_index_violent", "population"]


def ucr(cells: DataFrame) -> DataFrame:
    """Agency x year crime counts and population."""
    return cells.select(*UCR_COLUMNS)


def leoka(spark: SparkSession, base_dir: str) -> DataFrame:
    """Agency x year officer counts: line quantities of the cell's orders."""
    li = scan_table(spark, base_dir, "lineitem", ["l_orderkey", "l_quantity"])
    o = order_facts(spark, base_dir).select("o_orderkey", "m", "c_mktsegment", "year")
    g = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("m", "c_mktsegment", "year").agg(
        from_cents(F.sum(cents("l_quantity"))).alias("total_employees_officers"))
    return g.select(_ori7().alias("ORI7"), F.col("m").cast("string").alias("STATE"), "year",
                    "total_employees_officers")


def sample_base(cells: DataFrame, p: CrimeParams = CrimeParams()) -> DataFrame:
    """The sample: units of the first nations, one row per year (so keys repeat), with the
    old growth series Z and C2 filled up to the cutoff, and one unit without any facts."""
    old = F.col("year") <= p.cutoff
    rows = cells.where(F.col("m") < p.sample_nations).select(
        "ORI7", "year",
        F.when(old, F.col("n_orders") / F.lit(1000.0)).alias("Z"),
        F.when(old, F.col("actual_burg_total") / F.lit(1000.0)).alias("C2"),
    )
    return rows.unionByName(cells.sparkSession.createDataFrame(
        [(UNIT_WITHOUT_FACTS, p.cutoff + 1, None, None)], "ORI7 string, year int, Z double, C2 double"))


def original_employment(cells: DataFrame, p: CrimeParams = CrimeParams()) -> DataFrame:
    """(ORI7, year, full_time_original): the authors' police employment up to the cutoff."""
    return cells.where(F.col("year") <= p.cutoff).select(
        "ORI7", "year", (F.col("n_orders") * F.lit(1.5)).alias("full_time_original"))


def crosswalk(spark: SparkSession, base_dir: str) -> DataFrame:
    """ORI7 -> GOVID for every (nation, segment) unit of the customer table."""
    c = scan_table(spark, base_dir, "customer", ["c_nationkey", "c_mktsegment"]).distinct()
    return c.select(
        _ori7("c_nationkey").alias("ORI7"),
        (F.lit(100000000) + F.col("c_nationkey").cast("bigint") * 10 + _segment_index()).alias("GOVID"),
    )


def _cells_with_govid(cells, p):
    cells = cells.where(F.col("year") > p.cutoff)
    govid = F.lit(100000000) + F.col("m").cast("bigint") * 10 + _segment_index()
    return cells.withColumn("GOVID", govid)


def employment_rows(cells: DataFrame, p: CrimeParams = CrimeParams()) -> DataFrame:
    """Rows of the yearly employment files: 13 columns, police rows (type 62) and decoys.

    Each cell yields one police row and one decoy row (another employment type) through an
    explode over the two types, so the cell aggregate is computed once.
    """
    c = _cells_with_govid(cells, p)
    kinds = F.explode(F.array(
        F.struct(F.lit(62).alias("type_emp"), F.lit(1.0).alias("factor")),
        F.struct(F.lit(5).alias("type_emp"), F.lit(2.0).alias("factor")),
    )).alias("k")
    c = c.select("*", kinds)
    ft = F.col("n_orders").cast("double") * F.col("k.factor")
    burg = F.col("actual_burg_total")
    return c.select(
        (F.col("GOVID") * p.id_scale).cast("string").alias("govid"), F.col("k.type_emp").alias("type_emp"),
        ft.alias("full_time"), F.lit("R").alias("full_time_flag"), (ft * 1000).alias("full_time_payroll"),
        F.lit("R").alias("full_time_payroll_flag"), burg.alias("part_time"), F.lit("R").alias("part_time_flag"),
        (burg * 500).alias("part_time_payroll"), F.lit("R").alias("part_time_payroll_flag"),
        (burg * 20).alias("part_time_hrs"), F.lit("R").alias("part_time_hrs_flag"),
        (ft + burg / 2).alias("full_time_equivalent"), "year",
    )


def population_lines(cells: DataFrame, p: CrimeParams = CrimeParams()) -> DataFrame:
    """Lines of the yearly fixed-width population files (136 characters each).

    Two units (the last nation's last two segments) carry ids that are no numbers.
    """
    c = _cells_with_govid(cells, p)
    last = F.col("m") == 24
    gid = F.when(last & (F.col("c_mktsegment") == SEGMENTS[-1]), F.lit("UNKNOWN")).when(
        last & (F.col("c_mktsegment") == SEGMENTS[-2]), F.lit("1.2.3")).otherwise((F.col("GOVID") * p.id_scale).cast("string"))
    pop = F.floor(F.col("population") / 1000).cast("bigint").cast("string")
    line = F.concat(
        F.rpad(gid, 14, " "),
        F.rpad(F.concat(F.lit("CITY "), F.col("ORI7")), 64, " "),
        F.lit("1"),
        F.rpad(F.concat(F.lit("COUNTY "), F.col("STATE")), 30, " "),
        F.lpad(F.col("m").cast("string"), 2, "0"),
        F.lpad(_segment_index().cast("string"), 3, "0"),
        F.lit(" " * 11),
        F.lpad(pop, 9, " "),
        F.substring(F.col("year").cast("string"), 3, 2),
    )
    return c.select(line.alias("value"), "year")


# ---------------------------------------------------------------- sparse customer panel


def customer_panel(spark: SparkSession, base_dir: str) -> DataFrame:
    """customer x year: urgent / low-priority order counts, orders and revenue.

    Sparse on purpose: customers skip years (gaps) and many counts are zero, so lags
    across gaps and logs of zero are exercised.
    """
    # the unit is the order's customer key, so the customer table is not needed (no join)
    o = scan_table(spark, base_dir, "orders", ["o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"])
    o = o.select("o_custkey", F.year("o_orderdate").cast("int").alias("year"), "o_orderpriority",
                 cents("o_totalprice").alias("price"))
    pr = F.col("o_orderpriority")
    return o.groupBy("o_custkey", "year").agg(
        F.count(F.when(pr == "1-URGENT", F.lit(1))).cast("double").alias("n_urgent"),
        F.count(F.when(pr == "5-LOW", F.lit(1))).cast("double").alias("n_low"),
        F.count(F.lit(1)).alias("n_orders"),
        from_cents(F.sum("price")).alias("revenue"),
    )


# ---------------------------------------------------------------- nested series


def nested_series_rows(spark: SparkSession, base_dir: str) -> DataFrame:
    """One record per (event type, user) series with its daily observations nested.

    Values are summed per day first, so each series holds at most one observation per day
    (bounded by the time axis, like an annual series), then nested in day order.
    """
    ev = scan_table(spark, base_dir, "events", ["user_id", "event_type", "ts", "value"])
    daily = ev.groupBy("event_type", "user_id", F.to_date("ts").alias("day")).agg(
        from_cents(F.sum(cents("value"))).alias("value"))
    return daily.groupBy(F.col("event_type").alias("freq"), F.col("user_id").alias("ref_area")).agg(
        F.array_sort(F.collect_list(F.struct("day", "value"))).alias("obs"))
