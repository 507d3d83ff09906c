"""Registered queries: one callable (spark, base_dir) -> DataFrame per operator key.

Each query reads the test tables (or data Spark derives from them) in full. Doubles are
rounded to 6 decimals at the very end so results compare exactly with the oracle.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import semantics as sem
from panelspark.functions.semantics import id_scale, rdiv, rln, round_doubles, try_number
from panelspark.functions.wordbreak import words_uax29
from panelspark.operators import blocks as bl
from panelspark.operators import factors as fa
from panelspark.operators import panel as pn
from panelspark.operators import relational as rel
from panelspark.operators import text as tx
from panelspark.operators import topics as tp
from panelspark.operators.lda import VariationalFit
from panelspark.operators.longpanel import LongPanel, chain_index_scan, log_rebase_scan
from panelspark.operators.panel import PanelSpec, base_value
from panelspark.plans import corpus as cp
from panelspark.plans import crime, trade
from panelspark.plans import fixtures as fx
from panelspark.plans.fixtures import TradeParams
from panelspark.plans.trade import trade_world
from panelspark.session import materialize, shared_path
from panelspark.sources.files import read_csv_header, write_csv, write_parquet, write_yearly
from panelspark.sources.inferred import read_csv_inferred
from panelspark.sources.nested import nested_series_scan, unnest_obs, write_series
from panelspark.sources.stata import read_dta, write_dta
from panelspark.sources.tables import scan_table
from panelspark.stages import StageStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TP = TradeParams()


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, base_dir: str) -> DataFrame:
            return round_doubles(fn(spark, base_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# ------------------------------------------------------------------ trade decomposition

def _panel(spark, d):
    return trade.country_panel(spark, d, TP)


def _reporter(spark, d):
    return trade.trade_decomposition(spark, d, TP)


@register("trade_panel")
def q_trade_panel(spark, d):
    """Country x year panel with codes, expenditure, trade totals and
    the reporter's exports from the nested series."""
    return trade_world(spark, d, TP)


@register("absorption_index")
def q_absorption_index(spark, d):
    """DA growth from lagged shares and growth rates; DA index to the base year."""
    return _panel(spark, d).select("year", "country", "C", "I", "s_C", "s_I", "DA_growth",
                                   "DA_level", "baseDA", "DA_index")


@register("foreign_demand_index")
def q_foreign_demand_index(spark, d):
    """Trade-weighted partner growth per year, chained into an index."""
    return trade.foreign_demand(_panel(spark, d), TP)


@register("trade_decomposition")
def q_trade_decomposition(spark, d):
    """C4 (flagship): TR, RA, FMI, DMI, RMI, R and their logs for the reporter."""
    return _reporter(spark, d).select("year", "country", *DECOMP_COLS)


@register("decomp_long")
def q_decomp_long(spark, d):
    """Log-rebased components in long form."""
    return trade.decomp_long(_reporter(spark, d))


@register("decomp_periods")
def q_decomp_periods(spark, d):
    """Period contribution table."""
    return trade.decomp_periods(_reporter(spark, d), trade.period_table(spark, TP.periods))


DECOMP_COLS = ["FA_components", "FA", "DA_index", "TR", "RA", "FMI", "DMI", "RMI", "R",
               "log_RA", "log_TR", "log_R", "log_RMI", "log_DMI", "log_FMI", "log_DA", "log_FA"]


# ------------------------------------------------------------------ corpus statistics


CORPUS = cp.CorpusParams()
SCANNED = cp.CorpusParams(groups=("en", "fr", "de"))


def _corpus(spark, d):
    return cp.corpus(spark, d, CORPUS)


def _counts(spark, d):
    return cp.counts(spark, d, CORPUS)


def _tfidf(spark, d):
    return cp.tfidf(spark, d, CORPUS)


def _cleaned(spark, d):
    return cp.cleaned(spark, d, CORPUS)


@register("corpus_scan")
def q_corpus_scan(spark, d):
    """Corpus with document metadata, IN-list on the grouping column."""
    return cp.corpus(spark, d, SCANNED).select("doc_id", "author", "source",
                                    F.length("text").cast("bigint").alias("text_chars"))


@register("tokenize_words")
def q_tokenize_words(spark, d):
    """Tokens per document (count, distinct words, token characters) over whole texts."""
    return tx.token_stats(_corpus(spark, d))


@register("tokenize_uax29")
def q_tokenize_uax29(spark, d):
    """Words between Unicode word boundaries: their number, distinct words and a digest per document."""
    words = cp.corpus(spark, d, CORPUS).select("doc_id", "author", words_uax29("text").alias("w"))
    return words.select("doc_id", "author", F.size("w").cast("bigint").alias("n_tokens"),
                        F.size(F.array_distinct("w")).cast("bigint").alias("n_types"),
                        F.md5(F.array_join("w", "\n")).alias("words_md5"))


@register("word_counts")
def q_word_counts(spark, d):
    """count(author, word, sort=TRUE), with each row's position in the order."""
    return tx.word_counts(tx.tokenize(_corpus(spark, d)), sort=True)  # single use: no materialisation


@register("word_totals")
def q_word_totals(spark, d):
    """Counts with the per-document total joined back."""
    return tx.with_totals(_counts(spark, d))


@register("zipf_rank")
def q_zipf_rank(spark, d):
    """Rank within document and term frequency."""
    return tx.zipf_table(tx.with_totals(_counts(spark, d)))


@register("zipf_loglog")
def q_zipf_loglog(spark, d):
    """log10 rank against log10 term frequency."""
    return tx.zipf_loglog(tx.zipf_table(tx.with_totals(_counts(spark, d))))


@register("tf_idf")
def q_tf_idf(spark, d):
    """Tf, idf = ln(N / df), tf-idf."""
    return _tfidf(spark, d)


@register("tf_idf_by_source")
def q_tf_idf_by_source(spark, d):
    """A6 / T6 over 20 documents: tf-idf with the corpus grouped by source."""
    p = cp.CorpusParams(group_col="source", groups=None)
    return cp.tfidf(spark, d, p).groupBy("author").agg(
        F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_tokens"), F.sum("tf_idf").alias("tf_idf_sum"),
        F.max("idf").alias("idf_max"))


@register("stopword_antijoin_custom")
def q_stopword_antijoin_custom(spark, d):
    """Custom stopwords (the list and the caller's words) removed after tf-idf."""
    return _cleaned(spark, d)


@register("tfidf_top_terms")
def q_tfidf_top_terms(spark, d):
    """Top 15 words per document by tf-idf, ties kept."""
    return tx.top_terms(_cleaned(spark, d), CORPUS.top_terms).select("author", "word", "n", "tf_idf")


@register("topk_ties")
def q_topk_ties(spark, d):
    """Top words per document by raw count down to a place where counts are tied; all
    words tied with it are kept."""
    return tx.top_terms(_counts(spark, d), CORPUS.tie_rank, order="n")


@register("label_reorder")
def q_label_reorder(spark, d):
    """Words of the top-terms table ordered by mean tf-idf; facet labels and their places."""
    top = tx.top_terms(_cleaned(spark, d), CORPUS.top_terms).select("author", "word", "tf_idf")
    top = materialize(top, "top_terms")
    out = tx.reorder_levels(top, "word", "tf_idf", "word_level")
    return tx.order_within(out, "word", "author", "tf_idf", "word_in_author")


def _kept_tokens(spark, d):
    return cp.kept_tokens(spark, d, CORPUS)


@register("stopword_antijoin_builtin")
def q_stopword_antijoin_builtin(spark, d):
    """Built-in stopwords removed from the tokens (kept tokens per document)."""
    return _kept_tokens(spark, d).groupBy("doc_id", "author").agg(
        F.count(F.lit(1)).alias("n_kept"))


@register("topic_word_counts")
def q_topic_word_counts(spark, d):
    """Counts after built-in stopword removal."""
    return tx.word_counts(_kept_tokens(spark, d))


def _dtm(spark, d):
    counts = cp.topic_counts(spark, d, CORPUS)
    vocab = tp.vocabulary(counts)
    return counts, vocab, tp.dtm_entries(counts, vocab)


@register("dtm_stats")
def q_dtm_stats(spark, d):
    """Document-term matrix entries per document and its width."""
    _, _, entries = _dtm(spark, d)
    return tp.dtm_stats(entries)


BLOCKS = bl.BlockShape(64, 128)


def _blocks(spark, d):
    matrix = cp.document_matrix(spark, d, CORPUS)
    return matrix, materialize(bl.to_blocks(matrix.entries, BLOCKS), "dtm-blocks")


@register("dtm_blocks")
def q_dtm_blocks(spark, d):
    """Blocks of the document-term matrix, with their rows, entries and sums."""
    return bl.block_stats(_blocks(spark, d)[1])


@register("dtm_block_margins")
def q_dtm_block_margins(spark, d):
    """Row and column sums of the blocks (axis, index, total)."""
    blocks = _blocks(spark, d)[1]
    rows = bl.row_sums(blocks, BLOCKS).select(F.lit("document").alias("axis"), F.col("doc_index").alias("index"), "total")
    return rows.unionByName(bl.col_sums(blocks, BLOCKS).select(
        F.lit("term").alias("axis"), F.col("term_index").alias("index"), "total"))


def _hash_weights(name, k):
    """``k`` weights of a name: 16 bits of the MD5 of "name#i" as a share of 65,536 (sums are exact)."""
    part = lambda i: F.conv(F.substring(F.md5(F.concat(F.col(name).cast("string"), F.lit(f"#{i}"))), 1, 4), 16, 10)
    return F.array(*[part(i).cast("double") / 65536 for i in range(1, k + 1)])


@register("dtm_block_product")
def q_dtm_block_product(spark, d):
    """The matrix times two columns of term weights."""
    matrix, blocks = _blocks(spark, d)
    w = matrix.words.select("term_index", _hash_weights("word", 2).alias("w"))
    y = bl.multiply(blocks, w, 2, BLOCKS)
    return y.select("doc_index", F.get("y", F.lit(0)).alias("y1"), F.get("y", F.lit(1)).alias("y2"))


@register("dtm_block_product_t")
def q_dtm_block_product_t(spark, d):
    """The transposed matrix times a column of document weights."""
    matrix, blocks = _blocks(spark, d)
    w = matrix.docs.where("doc_id IS NOT NULL").select("doc_index", _hash_weights("doc_id", 1).alias("w"))
    return bl.multiply_transposed(blocks, w, 1, BLOCKS).select("term_index", F.get("y", F.lit(0)).alias("y1"))


def _topics(spark, d):
    return tp.TopicFit(cp.topic_counts(spark, d, CORPUS), CORPUS.topics)


@register("topic_em_step")
def q_topic_em_step(spark, d):
    """Topic weights of every word after one step of the fit."""
    return _topics(spark, d).run(1).beta()


def _variational(spark, d):
    return VariationalFit(cp.topic_counts(spark, d, CORPUS), CORPUS.topics)


_FITS: dict = {}


def converged_topics(spark, d):
    """The variational fit of the corpus until its bound settles, made once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FITS:
        _FITS[key] = _variational(spark, d).until(CORPUS.topic_tolerance, CORPUS.topic_limit)
    return _FITS[key]


@register("topic_vem_step")
def q_topic_vem_step(spark, d):
    """Topic weights of every word after one variational step."""
    return _variational(spark, d).run(1).beta()


@register("topic_vem_bound")
def q_topic_vem_bound(spark, d):
    """Evidence bound per token after each of the steps that the fit took to settle."""
    fit = converged_topics(spark, d)
    bounds = spark.createDataFrame(list(enumerate(fit.bounds, 1)), "step int, bound double")
    return bounds.withColumn("bound", F.col("bound") / fit.counts.agg(F.sum("n")).scalar())


@register("topic_gamma")
def q_topic_gamma(spark, d):
    """Mean topic weights of every document of the settled fit."""
    return converged_topics(spark, d).gamma()


@register("topic_model")
def q_topic_model(spark, d):
    """k = 4 topics, variational fit until the bound settles; terms and total weight per topic."""
    return tp.topic_summary(converged_topics(spark, d).beta())


@register("topic_beta")
def q_topic_beta(spark, d):
    """Topic-term probabilities of the settled fit in long form."""
    return converged_topics(spark, d).beta()


@register("topic_top_terms")
def q_topic_top_terms(spark, d):
    """Top 5 terms per topic of the settled fit, ties kept, ordered by topic and beta."""
    return tp.top_topic_terms(converged_topics(spark, d).beta(), CORPUS.topic_terms)


# ------------------------------------------------------------------ crime / police panel


CP = fx.CrimeParams()
_FILES: dict = {}


def crime_files(spark, d):
    """(cell table, yearly employment CSVs, yearly fixed-width population files), written once per
    session; the files are derived from the cell table."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FILES:
        cells = materialize(fx.crime_cells(spark, d), "crime_cells")
        emp = write_yearly(fx.employment_rows(cells, CP), shared_path(spark, "employment"), "csv")
        pop = write_yearly(fx.population_lines(cells, CP), shared_path(spark, "population"), "text")
        _FILES[key] = (cells, emp, pop)
    return _FILES[key]


def _emp(spark, d):
    return crime.asg_employment(spark, crime_files(spark, d)[1], CP)


def _pop(spark, d):
    return crime.asg_population(spark, crime_files(spark, d)[2], CP)


def _inputs(spark, d, files: bool = True):
    return crime.CrimeInputs(spark, d, *(crime_files(spark, d) if files else (None, None, None)), CP)


def _linked(spark, d):
    return _inputs(spark, d).linked()


def _prepared(spark, d):
    return _inputs(spark, d).prepared()


@register("scan_csv_multi")
def q_scan_csv_multi(spark, d):
    """Every headerless yearly CSV in one scan, columns named by position."""
    return crime.employment_raw(spark, crime_files(spark, d)[1], CP)


@register("scan_fixed_width")
def q_scan_fixed_width(spark, d):
    """Fixed-width yearly files, 8 fields by 1-based positions."""
    return crime.population_raw(spark, crime_files(spark, d)[2], CP)


@register("ingest_year_from_file")
def q_ingest_year_from_file(spark, d):
    """Year attached from the file's position; rows and totals per year."""
    raw = crime.employment_raw(spark, crime_files(spark, d)[1], CP)
    return raw.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.sum("full_time").alias("full_time"))


@register("asg_employment")
def q_asg_employment(spark, d):
    """Police employment from the yearly files (filter, year, id scaling, union)."""
    return _emp(spark, d)


@register("asg_population")
def q_asg_population(spark, d):
    """Population from fixed-width files, cast, scaled, complete cases, log growth."""
    return _pop(spark, d)


@register("id_scale")
def q_id_scale(spark, d):
    """File ids divided by 100000; ids that do not divide exactly become NULL."""
    raw = crime.population_raw(spark, crime_files(spark, d)[2], CP)
    return raw.select("govid", "year", _scaled_id().alias("scaled_id"))


def _scaled_id():
    return id_scale(try_number("govid", "bigint"), CP.id_scale)


@register("crime_panel_linked")
def q_crime_panel_linked(spark, d):
    """Crime + officers, sample, crosswalk, file-based employment and population."""
    return _linked(spark, d)


@register("cost_weighted_sum")
def q_cost_weighted_sum(spark, d):
    """Cost-weighted violent, property and total crime."""
    return crime.cost_weighted(_inputs(spark, d, False).ucr).select("ORI7", "year", "cw_violent", "cw_property", "cw_all")


@register("series_splice")
def q_series_splice(spark, d):
    """Z = log growth of the file series after the cutoff, the old series before."""
    return _prepared(spark, d).select("ORI7", "year", "Z")


@register("group_id")
def q_group_id(spark, d):
    """Dense id of (STATE, year) in key order."""
    return _prepared(spark, d).select("ORI7", "year", "STATE", "stateyear")


@register("unit_id")
def q_unit_id(spark, d):
    """Dense ids of ORI7 and of STATE as factor codes (a missing STATE has none)."""
    out = _prepared(spark, d).select("ORI7", "year", "STATE", "cityid")
    return rel.dense_id(out, ["STATE"], "stateid", na_gets_id=False)


@register("base_period_weight")
def q_base_period_weight(spark, d):
    """Population of the reference year carried to all rows of the unit."""
    return _linked(spark, d).select("ORI7", "year",
                                    base_value("population", crime.UNIT, CP.reference_year).alias("W"))


@register("crime_panel_final")
def q_crime_panel_final(spark, d):
    """The regression-ready growth panel with its final names."""
    return crime.growth_panel(_prepared(spark, d), CP)


@register("sample_restrict")
def q_sample_restrict(spark, d):
    """Distinct sample units left-joined to the unit facts."""
    inp = _inputs(spark, d, False)
    ucr_all = inp.ucr.join(inp.leoka, ["ORI7", "STATE", "year"], "left")
    return rel.semi_restrict(inp.base, ucr_all, ["ORI7"])


@register("distinct_keys")
def q_distinct_keys(spark, d):
    """A5: distinct sample units."""
    return _inputs(spark, d, False).base.select("ORI7").distinct()


@register("crosswalk_bridge")
def q_crosswalk_bridge(spark, d):
    """ORI7 -> GOVID -> yearly employment."""
    inp = _inputs(spark, d)
    units = inp.ucr.select("ORI7", "year")
    return rel.bridge(units, inp.crosswalk, "ORI7", "GOVID", inp.employment, ["GOVID", "year"])


@register("join_left_3key")
def q_join_left_3key(spark, d):
    """Crime left-joined to the officers of the years up to the cutoff on (ORI7, STATE, year);
    later years have no match."""
    inp = _inputs(spark, d, False)
    return inp.ucr.join(inp.leoka.where(F.col("year") <= CP.cutoff), ["ORI7", "STATE", "year"], "left")


@register("join_left_2key")
def q_join_left_2key(spark, d):
    """Crime left-joined to the sample's old series on (ORI7, year)."""
    inp = _inputs(spark, d, False)
    return inp.ucr.select("ORI7", "year", "population").join(inp.base, ["ORI7", "year"], "left")


@register("join_left")
def q_join_left(spark, d):
    """Crime left-joined to the crosswalk of the sample's units on ORI7; other units have no match."""
    inp = _inputs(spark, d, False)
    known = inp.crosswalk.join(inp.base.select("ORI7"), "ORI7", "left_semi")
    return inp.ucr.select("ORI7", "year").join(known, "ORI7", "left")


@register("join_right")
def q_join_right(spark, d):
    """Sample right-joined to the crime cells (every cell kept)."""
    inp = _inputs(spark, d, False)
    return inp.base.join(inp.ucr.select("ORI7", "year", "population"), ["ORI7", "year"], "right")


@register("join_suffix")
def q_join_suffix(spark, d):
    """Shared non-key column gets _x / _y suffixes."""
    inp = _inputs(spark, d, False)
    return rel.join_suffix(inp.ucr.select("ORI7", "year", "STATE", "population"), inp.leoka,
                           ["ORI7", "year"], "left")


@register("join_nullsafe")
def q_join_nullsafe(spark, d):
    """NULL keys match NULL keys. Each file row is matched NULL-safely to the keyed
    table of row counts per (GOVID, year), so an unparsable id (NULL) finds the NULL group
    and every row has exactly one match (no pairing of rows within a key)."""
    raw = crime.population_raw(spark, crime_files(spark, d)[2], CP)
    ids = raw.select(_scaled_id().alias("GOVID"), "year", F.col("pop_asg").alias("pop_x"))
    per_key = ids.groupBy("GOVID", "year").agg(F.count(F.lit(1)).alias("n_rows"))
    return rel.join_na_match(ids, per_key, ["GOVID", "year"], "left", na_match=True)


# ------------------------------------------------------------------ panel operators (sparse customer grid)


CUST = PanelSpec(["o_custkey"], "year")
GRID_VARS = ["n_urgent", "n_low", "n_orders", "revenue"]


def _grid(spark, d):
    return fx.customer_panel(spark, d)


@register("panel_validate")
def q_panel_validate(spark, d):
    """Per unit periods, span, gaps and duplicate (unit, time) rows."""
    return pn.panel_summary(_grid(spark, d), CUST)


@register("panel_lag_time")
def q_panel_lag_time(spark, d):
    """Lag by time value within the unit (a gap gives NULL)."""
    return _grid(spark, d).select("o_custkey", "year", "revenue",
                                  pn.lag_time("revenue", CUST).alias("lag_revenue"))


@register("panel_lag_row")
def q_panel_lag_row(spark, d):
    """Lag by row within the unit."""
    return _grid(spark, d).select("o_custkey", "year", "revenue",
                                  pn.lag_row("revenue", CUST).alias("lag_revenue"))


@register("panel_growth")
def q_panel_growth(spark, d):
    """Growth rate with IEEE division (0 -> x gives Inf, 0 -> 0 gives NaN)."""
    return _grid(spark, d).select("o_custkey", "year",
                                  pn.growth("revenue", CUST).alias("g_revenue"),
                                  pn.growth("n_urgent", CUST).alias("g_urgent"))


@register("panel_dlog")
def q_panel_dlog(spark, d):
    """Log difference (ln 0 = -Inf)."""
    return _grid(spark, d).select("o_custkey", "year", pn.dlog("n_urgent", CUST).alias("dlog_urgent"))


def _dlog_many(spark, d):
    return pn.dlog_many(_grid(spark, d), CUST, GRID_VARS)


@register("panel_dlog_many")
def q_panel_dlog_many(spark, d):
    """Log difference of several columns in one window node."""
    return _dlog_many(spark, d)


@register("panel_drop_first")
def q_panel_drop_first(spark, d):
    """Drop the first period after differencing."""
    return pn.drop_first_period(_dlog_many(spark, d), CUST, first=1995)


@register("complete_cases")
def q_complete_cases(spark, d):
    """drop rows with NULL or NaN anywhere; +-Inf survive."""
    return _dlog_many(spark, d).na.drop()


@register("inf_to_zero")
def q_inf_to_zero(spark, d):
    """Complete cases, then +-Inf (and any NA left) to 0."""
    return sem.inf_to_zero(_dlog_many(spark, d).na.drop(), GRID_VARS)


@register("lagged_share")
def q_lagged_share(spark, d):
    """s_a = L(a) / (L(a) + L(b)), s_b = 1 - s_a."""
    s_a, s_b = pn.lagged_share("n_urgent", "n_low", CUST)
    return _grid(spark, d).select("o_custkey", "year", s_a.alias("s_urgent"), s_b.alias("s_low"))


@register("index_to_base")
def q_index_to_base(spark, d):
    """Revenue index, base year 1995 = 100; units without a base row dropped."""
    out = pn.index_to_base(_grid(spark, d), "revenue", CUST, 1995, "revenue_index", base_col="base_revenue")
    return out.select("o_custkey", "year", "revenue", "base_revenue", "revenue_index")


@register("log_rebase")
def q_log_rebase(spark, d):
    """ln(x / x at the unit's first period)."""
    return _grid(spark, d).select("o_custkey", "year", pn.log_rebase("revenue", CUST).alias("rebased"))


# ------------------------------------------------------------------ long panels (units over many partitions)


STATUS = PanelSpec(["o_orderstatus"], "o_orderkey")   # three units, each of a third of the rows or so


def _status_panel(spark, d):
    orders = scan_table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return LongPanel(orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price")), STATUS, 16)


def _daily_panel(spark, d):
    """Daily order value per priority, with its growth over the previous day that has orders."""
    orders = scan_table(spark, d, "orders", ["o_orderdate", "o_orderpriority", "o_totalprice"])
    value = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value")
    daily = orders.groupBy(F.col("o_orderpriority").alias("priority"), F.unix_date(F.to_date("o_orderdate")).alias("day")).agg(value)
    panel = LongPanel(daily, PanelSpec(["priority"], "day"), 16).lags(["value"], by="row")
    growth = rdiv(F.col("value") - F.col("lag_value"), F.col("lag_value"))
    return LongPanel(materialize(panel.placed.withColumn("growth", growth), "daily"), panel.spec, _placed=True)


@register("panel_lag_halo")
def q_panel_lag_halo(spark, d):
    """W2 to W6 on units of a third of all rows: lags by time and by row over partitions of (unit, time)."""
    panel = _status_panel(spark, d).lags(["price"], prefix="time_")
    panel = panel.lags(["price"], 3, prefix="time3_").lags(["price"], 2, by="row", prefix="row2_")
    return panel.rows.withColumn("dlog_price", rln("price") - rln("time_price"))


@register("chain_index_scan")
def q_chain_index_scan(spark, d):
    """Daily index chained over several partitions of a series."""
    return chain_index_scan(_daily_panel(spark, d), "growth", "value_index").rows


@register("log_rebase_scan")
def q_log_rebase_scan(spark, d):
    """ln(x / x at the unit's first period) on units that lie in many partitions."""
    return log_rebase_scan(_status_panel(spark, d), "price", "rebased").rows


# ------------------------------------------------------------------ trade panel extras

def _world(spark, d):
    return trade_world(spark, d, TP)


@register("absorption_growth")
def q_absorption_growth(spark, d):
    """Share-weighted growth C s_C + I s_I."""
    return _panel(spark, d).select("year", "country", "C", "I", "s_C", "s_I", "DA_growth")


@register("trade_weight")
def q_trade_weight(spark, d):
    """Lagged trade weight L(exports to partner) / L(total exports)."""
    return _panel(spark, d).select("year", "country", "w")


@register("weighted_sum_by_time")
def q_weighted_sum_by_time(spark, d):
    """A3 / A4: sum of w * growth per year, missing terms dropped first."""
    p = _panel(spark, d).withColumn("FA_components", F.col("w") * F.col("DA_growth"))
    return rel.sum_dropping_missing(p, "FA_components", ["year"])


@register("chain_index")
def q_chain_index(spark, d):
    """Chained index, base year set to 100."""
    years = _world(spark, d).select("year").distinct()
    fa = trade.foreign_demand(_panel(spark, d), TP)
    out = years.join(fa, "year", "left")
    return out.select("year", sem.ifelse_na(F.col("year") == TP.base_year, F.lit(100.0), F.col("FA")).alias("FA"))


@register("join_inner_base")
def q_join_inner_base(spark, d):
    """Inner merge with the base-year row of each country."""
    w = _world(spark, d).withColumn("DA_level", F.col("cons_final") + F.col("gfcf_final"))
    base = w.where(F.col("year") == TP.base_year).select("country", F.col("DA_level").alias("baseDA"))
    return w.join(base, "country", "inner").select("year", "country", "DA_level", "baseDA")


@register("broadcast_reporter")
def q_broadcast_reporter(spark, d):
    """The reporter's yearly series attached to every country by year."""
    return _world(spark, d).select("year", "country", "total_exports")


@register("key_override")
def q_key_override(spark, d):
    """P10: codes of the panel, forced to a constant for one country."""
    return _world(spark, d).select(
        "year", "country", rel.key_override("partner_iso", "country", {TP.reporter: "REP"}).alias("code"))


WORLD_MEASURES = ["cons_final", "gfcf_final", "cons_final_nominal", "gfcf_final_nominal"]


@register("proj_select")
def q_proj_select(spark, d):
    """Select columns by name (list given as a vector); the scan reads these alone."""
    cols = ["o_orderkey", "o_orderdate", "o_totalprice"]
    return scan_table(spark, d, "orders").select(*cols)


@register("proj_drop")
def q_proj_drop(spark, d):
    """Drop columns by name."""
    return _world(spark, d).drop("exports_by_reporter", "total_exports", "nation_key", "partner_iso", "iso2c")


@register("proj_reorder")
def q_proj_reorder(spark, d):
    """Keep / reorder columns through an explicit name list."""
    return _world(spark, d).select("total_exports", "year", "country", "real_exports", "real_imports")


@register("proj_rename")
def q_proj_rename(spark, d):
    """Rename columns."""
    return _world(spark, d).select("year", "country", "cons_final", "gfcf_final").withColumnsRenamed(
        {"cons_final": "consumption", "gfcf_final": "investment"})


@register("proj_derive")
def q_proj_derive(spark, d):
    """Derived columns by vector arithmetic."""
    return _world(spark, d).select(
        "year", "country",
        (F.col("cons_final") + F.col("gfcf_final")).alias("DA_level"),
        sem.rdiv("nom_exports_dom", "nom_imports_dom").alias("TR"),
        (-F.col("real_imports")).alias("neg_imports"),
    )


@register("filter_eq")
def q_filter_eq(spark, d):
    """equality filter, pushed into the scan."""
    return scan_table(spark, d, "orders").where(F.col("o_orderstatus") == "P").select("o_orderkey", "o_orderstatus")


@register("filter_ne")
def q_filter_ne(spark, d):
    """inequality filter, pushed into the scan."""
    return scan_table(spark, d, "orders").where(F.col("o_orderstatus") != "F").select("o_orderkey", "o_orderstatus")


@register("filter_not_null")
def q_filter_not_null(spark, d):
    """Keep rows where a column is present (the reporter and countries without a code have
    no bilateral exports)."""
    return _world(spark, d).where(F.col("exports_by_reporter").isNotNull()).select(
        "year", "country", "exports_by_reporter")


@register("ifelse_na")
def q_ifelse_na(spark, d):
    """If-else where a missing condition gives a missing result."""
    cond = F.col("exports_by_reporter") > F.lit(1000000.0)
    return _world(spark, d).select("year", "country", sem.ifelse_na(cond, F.lit("large"), F.lit("small")).alias("size"))


@register("sort_multi")
def q_sort_multi(spark, d):
    """O1: multi-key ascending sort, with each row's position in the order."""
    rows = _world(spark, d).select("country", "year", "cons_final")
    return rel.sequence_number(rows, ["country", "year"], "position").orderBy("position")


@register("union_by_name")
def q_union_by_name(spark, d):
    """N-ary union by column name (parts with different column order)."""
    w = _world(spark, d).select("year", "country", "cons_final")
    parts = [w.where(F.col("year") == y) for y in (1995, 1996)]
    parts.append(w.where(F.col("year") > 1996).select("cons_final", "country", "year"))
    return rel.union_by_name(parts)


@register("unpivot_components")
def q_unpivot_components(spark, d):
    """Wide to long."""
    return _world(spark, d).unpivot(["year", "country"], WORLD_MEASURES, "name", "value")


@register("format_numeric_cols")
def q_format_numeric_cols(spark, d):
    """Every numeric column rendered with 2 significant digits."""
    periods = trade.decomp_periods(_reporter(spark, d), trade.period_table(spark, TP.periods))
    return sem.format_numeric(periods, 2)


# ------------------------------------------------------------------ scalar functions

@register("scalar_string")
def q_scalar_string(spark, d):
    """Upper-case, concatenation with a separator."""
    c = scan_table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    return c.select("c_custkey", F.upper(F.lower("c_mktsegment")).alias("segment"),
                    F.concat_ws("-", F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("label"))


@register("scalar_math")
def q_scalar_math(spark, d):
    """IEEE log and division, arithmetic, unary minus."""
    li = scan_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                           "l_discount", "l_tax"])
    return li.select(
        "l_orderkey", "l_linenumber",
        sem.rln("l_quantity").alias("ln_qty"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("net"),
        (-F.col("l_tax")).alias("neg_tax"),
        sem.rdiv("l_extendedprice", "l_quantity").alias("unit_price"),
        sem.rdiv("l_discount", "l_tax").alias("disc_per_tax"),
    )


@register("scalar_try_cast")
def q_scalar_try_cast(spark, d):
    """Numeric coercion, failures give NULL, blanks are trimmed."""
    o = scan_table(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
    return o.select(
        "o_orderkey",
        sem.try_number(F.substring("o_orderpriority", 1, 1)).alias("prio_num"),
        sem.try_number("o_orderpriority").alias("prio_bad"),
        sem.try_number(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" "))).alias("padded"),
    )


LANG_LEVELS = ["en", "fr", "de"]   # "es" is outside


@register("ordered_levels")
def q_ordered_levels(spark, d):
    """Explicit level order; a value outside the levels gives NULL."""
    docs = scan_table(spark, d, "documents", ["doc_id", "lang"])
    levels = F.create_map(*[x for i, lv in enumerate(LANG_LEVELS, 1) for x in (F.lit(lv), F.lit(i))])
    return docs.select("doc_id", "lang", F.try_element_at(levels, F.col("lang")).alias("lang_level"))


# ------------------------------------------------------------------ scans, sinks, nested series


@register("scan_table")
def q_scan_table(spark, d):
    """Named table scan with a narrow read schema."""
    return scan_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])


CODES_SCHEMA = "c_custkey bigint, c_name string, partner_iso string"


@register("scan_csv_header")
def q_scan_csv_header(spark, d):
    """CSV with a header, read back with a declared schema; codes upper-cased."""
    c = scan_table(spark, d, "customer", ["c_custkey", "c_name", "c_mktsegment"]).select(
        "c_custkey", "c_name", F.lower("c_mktsegment").alias("partner_iso"))
    path = write_csv(c, shared_path(spark, "codes"))
    codes = read_csv_header(spark, path, CODES_SCHEMA)
    return codes.withColumn("partner_iso", F.upper("partner_iso"))


@register("scan_csv_inferred")
def q_scan_csv_inferred(spark, d):
    """CSV files whose columns differ, types inferred over all values of all files.

    Finished orders hold whole prices and a flag, the others prices with cents and the status in
    another order of columns.
    """
    o = scan_table(spark, d, "orders", ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"])
    day, folder = F.col("o_orderdate").cast("date").alias("day"), shared_path(spark, "orders_csv")
    done = F.col("o_orderstatus") == "F"
    write_csv(o.where(done).select("o_orderkey", day, F.floor("o_totalprice").alias("price"),
                                   (F.col("o_totalprice") > 100000).alias("large")), f"{folder}/finished")
    write_csv(o.where(~done).select("o_orderstatus", F.round(F.col("o_totalprice").cast("double"), 2).alias("price"),
                                    "o_orderkey", day), f"{folder}/open")
    found = read_csv_inferred(spark, folder)
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    return round_doubles(found).withColumn("types", F.lit(", ".join(f"{c} {kinds[c]}" for c in sorted(kinds))))


DECOMP_SCHEMA = "year int, country string, " + ", ".join(f"{c} double" for c in DECOMP_COLS)


@register("sink_csv_roundtrip")
def q_sink_csv_roundtrip(spark, d):
    """K1 / K3: result written as CSV (no row numbers) and read back."""
    rep = _reporter(spark, d).select("year", "country", *DECOMP_COLS)
    path = write_csv(rep, shared_path(spark, "reporter_csv"))
    return read_csv_header(spark, path, DECOMP_SCHEMA)


@register("sink_parquet_roundtrip")
def q_sink_parquet_roundtrip(spark, d):
    """K2: result written as Parquet and read back."""
    path = write_parquet(crime.growth_panel(_prepared(spark, d), CP), shared_path(spark, "crime_final"))
    return spark.read.parquet(path)


@register("scan_dta")
def q_scan_dta(spark, d):
    """Stata files read with value labels and missing codes, one file by several tasks.

    The nation is stored as a labelled number; a balance below zero is the missing code ``.a``, one
    of exactly the segment MACHINERY ``.b``. A nation table beyond the bound on labels of the
    format (65,536) would be an error.
    """
    nations = scan_table(spark, d, "nation", ["n_nationkey", "n_name"]).limit(65_537).collect()
    if len(nations) > 65_536:
        raise ValueError("more nations than the format has labels")
    c = scan_table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    why = F.when(F.col("c_acctbal") < 0, ".a").when(F.col("c_mktsegment") == "MACHINERY", ".b")
    c = c.select("c_custkey", F.col("c_nationkey").alias("nation"), "c_mktsegment", why.alias("why"),
                 F.when(why.isNull(), F.col("c_acctbal").cast("double")).alias("balance"))
    path = write_dta(c, shared_path(spark, "customers_dta"), missing_codes={"balance": "why"},
                     labels={"nation": {r.n_nationkey: r.n_name for r in nations}})
    found = read_dta(spark, path, value_labels=True, missing_codes=True, split_bytes=4 << 20)
    return round_doubles(found.select(F.col("c_custkey").cast("long").alias("c_custkey"), "nation", "c_mktsegment",
                                      "balance", "balance_missing"))


@register("sink_dta_roundtrip")
def q_sink_dta_roundtrip(spark, d):
    """K2: the final panel written as Stata files and read back, column types restored."""
    out = crime.growth_panel(_prepared(spark, d), CP)
    back = read_dta(spark, write_dta(out, shared_path(spark, "crime_dta")))
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in out.schema])


def _staged_revenue(spark, d, store):
    o = scan_table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    per_customer = store.stage("customer_years", o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents")))
    c = scan_table(spark, d, "customer", ["c_custkey", "c_nationkey"])
    return store.stage("nation_years", per_customer.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("nation"), "year").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents")))


@register("stage_resume")
def q_stage_resume(spark, d):
    """K3: two stages written by a first run; a second run finds both unchanged and reads them back."""
    folder = shared_path(spark, "stages")
    _staged_revenue(spark, d, StageStore(spark, folder))
    again = StageStore(spark, folder)
    out = _staged_revenue(spark, d, again)
    if again.reused != {"customer_years", "nation_years"}:
        raise RuntimeError(f"only {sorted(again.reused)} of two unchanged stages were read back")
    return out


LOW_FIRST = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@register("factor_union")
def q_factor_union(spark, d):
    """Priorities of finished orders (three lower levels) and of the others (three upper ones) in
    one factor, written and read back; a priority that is no level of its side is missing."""
    o = scan_table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    done = F.col("o_orderstatus") == "F"
    o = o.select("o_orderkey", done.alias("done"), F.col("o_orderpriority").alias("priority"))
    both = fa.factor_union(fa.as_factor(o.where("done"), "priority", LOW_FIRST[:3]),
                           fa.as_factor(o.where("not done"), "priority", LOW_FIRST[2:]))
    back = materialize(both, "priorities")
    counts = back.groupBy("done", "priority").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("level", fa.level_number(counts, "priority"))


@register("factor_sort")
def q_factor_sort(spark, d):
    """Orders by customer and priority, in the order of the levels; ``latest`` is the highest level
    each customer has used."""
    o = scan_table(spark, d, "orders", ["o_custkey", "o_orderpriority"]).select(
        "o_custkey", F.col("o_orderpriority").alias("priority"))
    o = fa.as_factor(o, "priority", LOW_FIRST)
    counts = o.groupBy("o_custkey", "priority").agg(F.count(F.lit(1)).alias("n"))
    per = counts.withColumn("level", fa.level_number(counts, "priority")).groupBy("o_custkey").agg(
        F.max_by("priority", "level").alias("priority"), F.max("level").alias("level"), F.sum("n").alias("n"))
    return fa.factor_sort(fa.with_levels(per, "priority", LOW_FIRST), "priority", "o_custkey")


_NESTED: dict = {}


def _nested_path(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _NESTED:
        _NESTED[key] = write_series(fx.nested_series_rows(spark, d), shared_path(spark, "series"))
    return _NESTED[key]


@register("nested_series_scan")
def q_nested_series_scan(spark, d):
    """Nested series of one frequency and a list of areas (both filters reach the scan), with
    the observations of a range of days."""
    s = nested_series_scan(spark, _nested_path(spark, d), freq="click", areas=range(100),
                           start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 20))
    return s.select("freq", "ref_area", F.size("obs").alias("n_obs"))


@register("unnest_obs")
def q_unnest_obs(spark, d):
    """U4: one row per nested observation of every series."""
    return unnest_obs(nested_series_scan(spark, _nested_path(spark, d)))
