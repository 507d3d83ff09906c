"""Trade-ratio decomposition.

The export/import ratio of a reporter is split into terms of trade (R), relative import
intensity (RMI = FMI / DMI) and relative expenditure (RA = FA / DA):

    TR = X / M (nominal),  RA = FA / DA,  FMI = x / FA,  DMI = m / DA,  R = TR * m / x

so TR = R * RMI * RA and, over a period, dlnTR = dlnR + dlnFMI - dlnDMI + dlnFA - dlnDA.
DA is the reporter's expenditure index; FA is the trade-weighted expenditure growth of its
partners, chained into an index. Everything is a DataFrame plan: windows over the
country panel, one aggregate per year, and joins against tables with one row per year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.semantics import ifelse_na, rdiv, rln, try_number
from panelspark.operators.panel import (
    PanelSpec, assert_unique, chain_index, growth, held_lag, index_to_base, lag_time, lagged_ratio,
    lagged_share, log_rebase, null_at, with_lags,
)
from panelspark.operators.relational import join_suffix, key_override, sum_dropping_missing
from panelspark.plans import fixtures as fx
from panelspark.plans.fixtures import TradeParams
from panelspark.session import materialize, shared_path
from panelspark.sources.files import write_parquet
from panelspark.sources.nested import TRADE_SERIES_SCHEMA, nested_series_scan, unnest_obs

COUNTRY_PANEL = PanelSpec(["country"], "year")
SERIES = PanelSpec([], "year")

REPORTER_COLUMNS = [
    "year", "country", "cons_final", "cons_final_nominal", "gfcf_final_nominal", "gfcf_final",
    "nom_exports_dom", "nom_imports_dom", "real_exports", "real_imports", "DA_index",
]
LOG_TERMS = ["RA", "TR", "R", "RMI", "DMI", "FMI", "DA", "FA"]


LAGGED = ["cons_final", "gfcf_final", "cons_final_nominal", "gfcf_final_nominal",
          "exports_by_reporter", "total_exports"]


def country_codes(codes: DataFrame, code_file: DataFrame) -> DataFrame:
    """(country, partner_iso, iso2c): the code list joined to the code file, whose country names
    are those of the data; every row of the file is kept."""
    listed = codes.where(F.col("iso2c").isNotNull()).withColumnRenamed("iso3c", "partner_iso")
    named = code_file.withColumn("partner_iso", F.upper("partner_iso"))
    both = join_suffix(listed, named, ["partner_iso"], "right")
    return both.select(F.col("country_y").alias("country"), "partner_iso", "iso2c")


def with_codes(gdp: DataFrame, codes: DataFrame) -> DataFrame:
    """Every row of the accounts with its codes; the country that the file lacks is put in."""
    out = codes.join(gdp, "country", "right")
    return out.withColumns({"partner_iso": key_override("partner_iso", "country", {fx.NOT_IN_FILE: "N05"}),
                            "iso2c": key_override("iso2c", "country", {fx.NOT_IN_FILE: "ZF"})})


def partner_exports(spark: SparkSession, path: str, p: TradeParams) -> DataFrame:
    """(year, iso2c, exports_by_reporter) from the nested series: the yearly ones of the reporter
    in the years of the panel, one row per observation, text turned into numbers."""
    series = nested_series_scan(spark, path, freq="A", areas=[p.reporter_iso2], start=str(p.first_year),
                                end=str(p.last_year), schema=TRADE_SERIES_SCHEMA, time="time")
    return unnest_obs(series).select(
        try_number("time", "int").alias("year"), F.col("counterpart_area").alias("iso2c"),
        try_number("value").alias("exports_by_reporter"))


def trade_world(spark: SparkSession, base_dir: str, p: TradeParams = TradeParams()) -> DataFrame:
    """The country x year panel: codes, expenditure, trade totals, the reporter's exports to each
    country (by year and two-letter code) and its total exports (by year)."""
    cells, flows = fx.national_accounts(spark, base_dir, p)
    codes = country_codes(fx.code_list(spark, base_dir), fx.code_file(spark, base_dir))
    gdp = with_codes(cells, codes)
    keys = gdp.select(F.col("nation_key").alias("m"), "iso2c").where(F.col("iso2c").isNotNull()).distinct()
    path = write_parquet(fx.export_series(flows, keys, p), shared_path(spark, "export_series"))
    world = gdp.join(partner_exports(spark, path, p), ["year", "iso2c"], "left")
    world = materialize(world, "trade_world")
    assert_unique(world, COUNTRY_PANEL)   # a code that two countries share would double rows here
    # the reporter's own exports, one row per year, attached to every country of that year
    total = world.where(F.col("nation_key") == p.reporter_key).select(
        "year", F.col("nom_exports_dom").alias("total_exports"))
    return F.broadcast(total).join(world, "year", "right").select(
        "year", "country", "nation_key", "partner_iso", "iso2c",
        "cons_final", "gfcf_final", "cons_final_nominal", "gfcf_final_nominal",
        "nom_exports_dom", "nom_imports_dom", "real_exports", "real_imports",
        "exports_by_reporter", "total_exports",
    )


def absorption_index(world: DataFrame, p: TradeParams = TradeParams(), lagger=lag_time) -> DataFrame:
    """DA growth (share-weighted consumption and investment growth) and the DA index.

    C, I = growth of real consumption / investment; s_C = lagged nominal consumption share,
    s_I = 1 - s_C; DA_growth = C s_C + I s_I; DA_index = 100 * level / level at base year.
    w = last year's exports to the partner over last year's total exports. Countries
    without a base-year row are dropped. All lags come from one window node.
    """
    spec = COUNTRY_PANEL
    guard = lambda c: null_at(c, spec, p.base_year)
    df = with_lags(world, spec, LAGGED, lagger)
    s_c, _ = lagged_share("cons_final_nominal", "gfcf_final_nominal", spec, held_lag)
    df = df.withColumns({
        "C": guard(growth("cons_final", spec, held_lag)),
        "I": guard(growth("gfcf_final", spec, held_lag)),
        "s_C": guard(s_c),
        "w": guard(lagged_ratio("exports_by_reporter", "total_exports", spec, held_lag)),
        "DA_level": F.col("cons_final") + F.col("gfcf_final"),
    }).drop(*[f"_lag_{c}" for c in LAGGED])
    df = df.withColumn("s_I", guard(F.lit(1.0) - F.col("s_C")))
    df = df.withColumn("DA_growth", F.col("C") * F.col("s_C") + F.col("I") * F.col("s_I"))
    return index_to_base(df, "DA_level", spec, p.base_year, "DA_index", base_col="baseDA")


def foreign_demand(panel: DataFrame, p: TradeParams = TradeParams()) -> DataFrame:
    """FA per year: sum over partners of w * DA_growth (missing terms dropped), chained.

    ``w`` is last year's exports to the partner over last year's total exports. The
    aggregate has one row per year, so the chaining window is tiny.
    """
    comp = panel.select("year", (F.col("w") * F.col("DA_growth")).alias("FA_components"))
    by_year = sum_dropping_missing(comp, "FA_components", ["year"])
    return chain_index(by_year, "FA_components", "year", "FA")


def decompose(panel: DataFrame, fa: DataFrame, p: TradeParams = TradeParams()) -> DataFrame:
    """Reporter rows with FA attached, the decomposition ratios and their logs."""
    rep = panel.where(F.col("country") == F.lit(p.reporter)).select(*REPORTER_COLUMNS)
    # fa has one row per year: a bounded broadcast
    rep = rep.join(F.broadcast(fa), "year", "left")
    rep = rep.withColumn("FA", ifelse_na(F.col("year") == F.lit(p.base_year), F.lit(100.0), F.col("FA")))
    rep = rep.withColumns({
        "TR": rdiv("nom_exports_dom", "nom_imports_dom"),
        "RA": rdiv("FA", "DA_index"),
        "FMI": rdiv("real_exports", "FA"),
        "DMI": rdiv("real_imports", "DA_index"),
    })
    rep = rep.withColumns({
        "RMI": rdiv("FMI", "DMI"),
        "R": F.col("TR") * rdiv("real_imports", "real_exports"),
    })
    logs = {f"log_{t}": rln("DA_index" if t == "DA" else t) for t in LOG_TERMS}
    return rep.withColumns(logs)


def country_panel(spark: SparkSession, base_dir: str, p: TradeParams = TradeParams()) -> DataFrame:
    """The country panel with DA growth, weights and the DA index.

    It is computed from written (country, year) tables, so the partner aggregate and the
    reporter rows both read those; orders, customers and lines are each read once.
    """
    return absorption_index(trade_world(spark, base_dir, p), p)


def trade_decomposition(spark: SparkSession, base_dir: str, p: TradeParams = TradeParams()) -> DataFrame:
    panel = country_panel(spark, base_dir, p)
    return decompose(panel, foreign_demand(panel, p), p)


def decomp_long(reporter: DataFrame) -> DataFrame:
    """Log-rebased components (ToT, Exp, Tratio, switch) in long form (year, name, value)."""
    wide = reporter.select(
        "year",
        log_rebase("R", SERIES).alias("ToT"),
        log_rebase("RA", SERIES).alias("Exp"),
        log_rebase("TR", SERIES).alias("Tratio"),
        log_rebase("RMI", SERIES).alias("switch"),
    )
    return wide.unpivot(["year"], ["ToT", "Exp", "Tratio", "switch"], "name", "value")


def period_table(spark: SparkSession, periods) -> DataFrame:
    return spark.createDataFrame([(int(s), int(e)) for s, e in periods], "start int, end int")


def decomp_periods(reporter: DataFrame, periods: DataFrame) -> DataFrame:
    """Contribution of each term (x100 log change) over each (start, end) period.

    DA and DMI enter with a flipped sign, so TR = R + FA + DA + FMI + DMI per period.
    One join of the period table to the start-year and end-year rows; no loop.
    """
    terms = ["log_TR", "log_R", "log_FA", "log_DA", "log_FMI", "log_DMI"]
    at_start = reporter.select(F.col("year").alias("start"), *[F.col(t).alias(f"s_{t}") for t in terms])
    at_end = reporter.select(F.col("year").alias("end"), *[F.col(t).alias(f"e_{t}") for t in terms])
    j = periods.join(at_start, "start", "left").join(at_end, "end", "left")
    diff = lambda t: (F.col(f"e_log_{t}") - F.col(f"s_log_{t}")) * F.lit(100.0)
    return j.select(
        F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")).alias("period"),
        diff("R").alias("R"),
        diff("TR").alias("TR"),
        diff("FA").alias("FA"),
        (-diff("DA")).alias("DA"),
        diff("FMI").alias("FMI"),
        (-diff("DMI")).alias("DMI"),
    )
