"""Crime / police panel: multi-file ingest, record linkage, cost-weighted crime and a
regression-ready panel of log differences.

Shape of the plan: one scan per file family (all yearly files at once), joins on
(unit, year) keys, one panel window (partition by unit, order by year) shared by all
fourteen log differences, and dense ids computed on distinct key tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.semantics import id_scale, inf_to_zero, try_number, weighted_sum
from panelspark.operators.panel import PanelSpec, assert_unique, base_value, dlog, dlog_many, series_splice
from panelspark.operators.relational import bridge, dense_id, semi_restrict
from panelspark.plans import fixtures as fx
from panelspark.plans.fixtures import CrimeParams
from panelspark.session import materialize
from panelspark.sources.files import read_csv_multi, read_fixed_width, year_by_file_order

# Cost per offence used for the cost-weighted sums.
COST = {
    "murder": 7000000,
    "rape": 142020,
    "robbery": 12624,
    "assault": 38924,
    "burglary": 2104,
    "larceny": 473,
    "mvt": 5786,
}
VIOLENT_WEIGHTS = {
    "actual_murder": COST["murder"],
    "actual_rape_total": COST["rape"],
    "actual_robbery_total": COST["robbery"],
    "actual_assault_total": COST["assault"],
}
PROPERTY_WEIGHTS = {
    "actual_burg_total": COST["burglary"],
    "actual_theft_total": COST["larceny"],
    "actual_mtr_veh_theft_total": COST["mvt"],
}

# The series that are differenced, their final names and the layouts of the yearly
# files.
RELEVANT_VARS = [
    "actual_murder", "actual_rape_total", "actual_robbery_total", "actual_assault_total",
    "actual_burg_total", "actual_theft_total", "actual_mtr_veh_theft_total",
    "actual_index_property", "actual_index_violent", "cw_violent", "cw_property", "cw_all",
    "total_employees_officers", "population",
]
FINAL_NAMES = {
    "actual_murder": "Y1", "actual_rape_total": "Y2", "actual_robbery_total": "Y3",
    "actual_assault_total": "Y4", "actual_burg_total": "Y5", "actual_theft_total": "Y6",
    "actual_mtr_veh_theft_total": "Y7", "actual_index_violent": "Y8",
    "actual_index_property": "Y9", "cw_violent": "Y10", "cw_property": "Y11", "cw_all": "Y12",
    "total_employees_officers": "S", "population": "C1",
}

EMPLOYMENT_SCHEMA = (
    "govid string, type_emp int, full_time double, full_time_flag string, "
    "full_time_payroll double, full_time_payroll_flag string, part_time double, "
    "part_time_flag string, part_time_payroll double, part_time_payroll_flag string, "
    "part_time_hrs double, part_time_hrs_flag string, full_time_equivalent double"
)
POPULATION_FIELDS = [
    ("govid", 1, 14), ("name", 15, 78), ("region_code", 79, 79), ("county_name", 80, 109),
    ("fips_state", 110, 111), ("fips_county", 112, 114), ("pop_asg", 126, 134),
    ("pop_year", 135, 136),
]
UNIT = PanelSpec(["ORI7"], "year")
GOV_UNIT = PanelSpec(["GOVID"], "year")


def employment_raw(spark: SparkSession, path: str, p: CrimeParams = CrimeParams()) -> DataFrame:
    """All yearly employment files, named by position, with the year of each file."""
    return year_by_file_order(read_csv_multi(spark, path, EMPLOYMENT_SCHEMA), p.cutoff + 1, p.file_years)


def asg_employment(spark: SparkSession, path: str, p: CrimeParams = CrimeParams()) -> DataFrame:
    """Police rows (type 62) of every file: (GOVID, full_time, year), ids rescaled."""
    raw = employment_raw(spark, path, p)
    return raw.where(F.col("type_emp") == 62).select(
        id_scale(try_number("govid", "bigint"), p.id_scale).alias("GOVID"), "full_time", "year")


def population_raw(spark: SparkSession, path: str, p: CrimeParams = CrimeParams()) -> DataFrame:
    return year_by_file_order(read_fixed_width(spark, path, POPULATION_FIELDS), p.cutoff + 1, p.file_years)


def asg_population(spark: SparkSession, path: str, p: CrimeParams = CrimeParams()) -> DataFrame:
    """(GOVID, pop_asg, year, g_pop): parsed, incomplete rows dropped, log growth added."""
    raw = population_raw(spark, path, p)
    pop = raw.select(
        id_scale(try_number("govid", "bigint"), p.id_scale).alias("GOVID"),
        try_number("pop_asg", "double").alias("pop_asg"),
        "year",
    ).na.drop()
    return pop.withColumn("g_pop", dlog("pop_asg", GOV_UNIT))


class CrimeInputs:
    """The inputs of the crime plan, derived from the test tables.

    The (unit, year) cell table is written once (or handed in, written); it serves the crime
    counts, the sample, the original employment and the yearly files. Officers need the order
    lines, so orders are read twice in all. Members are built on first use.
    """

    def __init__(self, spark: SparkSession, base_dir: str, cells: DataFrame | None = None,
                 emp_path: str | None = None, pop_path: str | None = None, p: CrimeParams = CrimeParams()):
        self.spark, self.base_dir, self.p = spark, base_dir, p
        self.emp_path, self.pop_path = emp_path, pop_path
        self._cells = cells

    @property
    def cells(self) -> DataFrame:
        if self._cells is None:
            self._cells = materialize(fx.crime_cells(self.spark, self.base_dir), "crime_cells")
        return self._cells

    @property
    def ucr(self) -> DataFrame:
        return fx.ucr(self.cells)

    @property
    def base(self) -> DataFrame:
        return fx.sample_base(self.cells, self.p)

    @property
    def leoka(self) -> DataFrame:
        return fx.leoka(self.spark, self.base_dir)

    @property
    def original(self) -> DataFrame:
        return fx.original_employment(self.cells, self.p)

    @property
    def crosswalk(self) -> DataFrame:
        return fx.crosswalk(self.spark, self.base_dir)

    @property
    def employment(self) -> DataFrame:
        return asg_employment(self.spark, self.emp_path, self.p)

    @property
    def population(self) -> DataFrame:
        return asg_population(self.spark, self.pop_path, self.p)

    def linked(self) -> DataFrame:
        return link(self.ucr, self.leoka, self.base, self.original, self.crosswalk, self.employment, self.population)

    def prepared(self) -> DataFrame:
        return prepare(self.linked(), self.base, self.p)


def link(ucr: DataFrame, leoka: DataFrame, base: DataFrame, original: DataFrame, crosswalk: DataFrame,
         employment: DataFrame, population: DataFrame) -> DataFrame:
    """Crime and officers, restricted to the sample units, with the original employment series,
    bridged to the government id and extended with the file-based employment and population."""
    ucr_all = ucr.join(leoka, ["ORI7", "STATE", "year"], "left")
    final = semi_restrict(base, ucr_all, ["ORI7"])
    final = final.join(original, ["ORI7", "year"], "left")
    final = bridge(final, crosswalk, "ORI7", "GOVID", employment, ["GOVID", "year"])
    return final.join(population, ["GOVID", "year"], "left")


def cost_weighted(df: DataFrame) -> DataFrame:
    """cw_violent, cw_property, cw_all: counts times cost per offence."""
    df = df.withColumns({"cw_violent": weighted_sum(VIOLENT_WEIGHTS),
                         "cw_property": weighted_sum(PROPERTY_WEIGHTS)})
    return df.withColumn("cw_all", F.col("cw_violent") + F.col("cw_property"))


def prepare(linked: DataFrame, base: DataFrame, p: CrimeParams = CrimeParams()) -> DataFrame:
    """Cost sums, old growth series joined, Z spliced, state-year and city ids.

    The linked panel (one row per unit and year) is written once before the ids are
    numbered: both id tables and the growth step then read it instead of re-running the
    joins and file scans behind it.
    """
    final = cost_weighted(linked)
    final = final.join(base.select("ORI7", "year", "Z", "C2"), ["ORI7", "year"], "left")
    final = final.withColumn("Z", series_splice("year", p.cutoff, dlog("full_time", UNIT), F.col("Z")))
    final = materialize(final, "crime_linked")
    assert_unique(final, UNIT)   # a crosswalk fan-out would make the lags meaningless
    final = dense_id(final, ["STATE", "year"], "stateyear")
    return dense_id(final, ["ORI7"], "cityid", na_gets_id=False)


def growth_panel(final: DataFrame, p: CrimeParams = CrimeParams()) -> DataFrame:
    """Log differences of the fourteen series, first year dropped, C2 spliced, weight W,
    complete cases, infinities to zero, final names."""
    panel = final.withColumn("W", base_value("population", UNIT, p.reference_year))
    panel = dlog_many(panel, UNIT, RELEVANT_VARS).where(F.col("year") != p.first_year)
    panel = panel.withColumn("C2", series_splice("year", p.cutoff, F.col("g_pop"), F.col("C2")))
    panel = panel.select("ORI7", "GOVID", "STATE", "year", "cityid", "stateyear",
                         *RELEVANT_VARS, "Z", "C2", "W")
    panel = inf_to_zero(panel.na.drop())
    return panel.withColumnsRenamed(FINAL_NAMES)
