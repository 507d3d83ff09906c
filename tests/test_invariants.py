"""Identities the results must satisfy, on the real test tables."""

import math

import pytest
from pyspark.sql import functions as F

from paths import SF_MID, SF_SMALL
from panelspark.plans import trade
from panelspark.plans.fixtures import TradeParams
from panelspark.registry import QUERIES

TP = TradeParams()


@pytest.fixture(scope="module")
def reporter(spark):
    return trade.trade_decomposition(spark, SF_MID, TP).cache()


def test_ratio_identity_per_year(reporter):
    for r in reporter.collect():
        assert math.isclose(r["TR"], r["R"] * r["RMI"] * r["RA"], rel_tol=1e-9)


def test_period_contributions_add_up(spark, reporter):
    periods = trade.decomp_periods(reporter, trade.period_table(spark, TP.periods)).collect()
    assert len(periods) == 2
    for p in periods:
        assert math.isclose(p["TR"], p["R"] + p["FA"] + p["DA"] + p["FMI"] + p["DMI"], abs_tol=1e-9)


def test_base_year_values(reporter):
    base = reporter.where(F.col("year") == TP.base_year).first()
    assert base["FA"] == 100.0 and math.isclose(base["DA_index"], 100.0)


def test_shares_sum_to_one(spark):
    panel = trade.country_panel(spark, SF_MID, TP)
    bad = panel.where(F.col("s_C").isNotNull() & (F.abs(F.col("s_C") + F.col("s_I") - 1) > 1e-12)).count()
    assert bad == 0


def test_term_frequencies_sum_to_one(spark):
    from panelspark.operators import text as tx
    from panelspark.sources.corpus import corpus_scan
    counts = tx.word_counts(tx.tokenize(corpus_scan(spark, SF_SMALL)))
    z = tx.zipf_table(tx.with_totals(counts))
    sums = z.groupBy("author").agg(F.sum("term_frequency").alias("s"), F.max("rank").alias("r"),
                                   F.count("*").alias("n")).collect()
    assert len(sums) == 4 and all(abs(r["s"] - 1.0) < 1e-9 and r["r"] == r["n"] for r in sums)


def test_crime_panel_has_no_missing_or_infinite(spark):
    df = QUERIES["crime_panel_final"](spark, SF_MID)
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    cond = None
    for c in doubles:
        e = F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        cond = e if cond is None else cond | e
    assert df.count() > 0 and df.where(cond).count() == 0


def test_topics_are_distributions(spark):
    beta = QUERIES["topic_beta"](spark, SF_SMALL)
    sums = beta.groupBy("topic").agg(F.sum("beta").alias("s"), F.count("*").alias("n")).collect()
    assert sorted(r["topic"] for r in sums) == [1, 2, 3, 4]
    assert all(abs(r["s"] - 1.0) < 1e-2 for r in sums)   # entries are rounded to 6 decimals
    top = QUERIES["topic_top_terms"](spark, SF_SMALL).collect()
    assert 20 <= len(top) and all(r["beta"] > 0 for r in top)
    assert [(r["topic"], -r["beta"]) for r in top] == sorted((r["topic"], -r["beta"]) for r in top)


# ---------------------------------------------------------------- the keys' data makes their operators work


def test_sorts_emit_their_order(spark):
    for key, order in (("word_counts", lambda r: (-r["n"], r["author"].encode(), r["word"].encode())),
                       ("sort_multi", lambda r: (r["country"].encode(), r["year"]))):
        rows = QUERIES[key](spark, SF_SMALL).collect()
        assert [order(r) for r in rows] == sorted(map(order, rows)) and len(rows) > 100
        assert [r["position"] for r in rows] == list(range(1, len(rows) + 1))


def test_left_joins_have_unmatched_rows(spark):
    for key, c in (("join_left", "GOVID"), ("join_left_3key", "total_employees_officers"), ("join_left_2key", "Z")):
        rows = QUERIES[key](spark, SF_SMALL)
        n = rows.count()
        assert 0 < rows.where(F.col(c).isNull()).count() < n


def test_filters_and_levels_leave_something_out(spark):
    all_docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert 0 < QUERIES["corpus_scan"](spark, SF_SMALL).count() < all_docs
    levels = QUERIES["ordered_levels"](spark, SF_SMALL)
    assert 0 < levels.where("lang_level IS NULL").count() < levels.count() == all_docs
    assert QUERIES["stopword_antijoin_custom"](spark, SF_SMALL).count() < QUERIES["tf_idf"](spark, SF_SMALL).count()


def test_top_k_has_a_tie_at_its_cut(spark):
    from panelspark.registry import CORPUS
    per = QUERIES["topk_ties"](spark, SF_MID).groupBy("author").count().collect()
    assert any(r["count"] > CORPUS.tie_rank for r in per)


def test_ids_meet_missing_keys(spark):
    groups = QUERIES["group_id"](spark, SF_SMALL)
    missing = groups.where("STATE IS NULL").collect()
    assert len(missing) == 1 and missing[0]["stateyear"] == groups.agg(F.max("stateyear")).first()[0]
    units = QUERIES["unit_id"](spark, SF_SMALL)
    assert units.where("STATE IS NULL AND stateid IS NULL").count() == 1
    assert units.where("STATE IS NOT NULL AND stateid IS NULL").count() == 0


def test_trade_panel_has_countries_without_codes(spark):
    w = QUERIES["trade_panel"](spark, SF_MID)
    codes = {r["country"]: (r["partner_iso"], r["iso2c"]) for r in w.select("country", "partner_iso", "iso2c").distinct().collect()}
    assert codes["NATION_5"] == ("N05", "ZF")        # put in by hand
    assert codes["NATION_9"] == ("X99", None)        # no list knows its code
    assert codes["NATION_24"] == ("N24", None)       # has no two-letter code
    assert codes["NATION_7"] == ("N07", "ZH")
    per = {r["country"]: r["n"] for r in w.groupBy("country").agg(F.count("exports_by_reporter").alias("n")).collect()}
    assert per["NATION_9"] == per["NATION_24"] == per["NATION_3"] == 0 < per["NATION_7"]
