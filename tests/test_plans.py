"""Plan-shape checks: the physical plans keep the properties the design relies on."""

import re

from paths import SF_SMALL
from panelspark.registry import QUERIES


def _plan(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_log_differences_share_one_window_node(spark):
    plan = _plan(spark, "panel_dlog_many")
    assert len(re.findall(r"\bWindow \[", plan)) == 1


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = _plan(spark, "topk_ties")
    assert plan.count("WindowGroupLimit") == 2   # partial (map side) and final


def test_filters_reach_the_scans(spark):
    assert "EqualTo(type_emp,62)" in _plan(spark, "asg_employment")
    assert "EqualTo(freq,click)" in _plan(spark, "nested_series_scan")
    assert re.search(r"PushedFilters: \[In\(lang", _plan(spark, "corpus_scan"))


def test_scans_read_only_needed_columns(spark):
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", _plan(spark, "scalar_math"))
    cols = {re.sub(r"#\d+L?$", "", c) for c in scans[0].split(",")}
    assert cols == {"l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"}



def _threshold(spark, value):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)


def test_totals_and_ranks_do_not_shuffle_on_the_hot_group(spark):
    """With a small broadcast threshold, nothing is dealt by the group alone."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    _threshold(spark, "64k")
    try:
        for key in ("word_totals", "tf_idf", "zipf_rank"):
            df = QUERIES[key](spark, SF_SMALL)
            df.write.format("noop").mode("overwrite").save()
            plan = df._jdf.queryExecution().toString()
            # joins on the group are dealt by the group and a salt; numbered rows meet a small table
            assert not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[author#\d+\]", plan), key
            assert not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[_pid", plan), key
    finally:
        _threshold(spark, before)


def test_facts_are_reduced_before_the_sample_join(spark):
    plan = _plan(spark, "sample_restrict")
    assert "LeftSemi" in plan


def test_orders_and_customers_are_read_once_for_the_trade_panel(spark, monkeypatch):
    from panelspark.plans import fixtures as fx

    read = []
    scan = fx.scan_table
    monkeypatch.setattr(fx, "scan_table", lambda s, d, name, columns=None: read.append(name) or scan(s, d, name, columns))
    QUERIES["trade_panel"](spark, SF_SMALL)
    assert read.count("orders") == read.count("customer") == read.count("lineitem") == 1


def test_projection_and_filters_reach_the_scan(spark):
    assert "EqualTo(o_orderstatus,P)" in _plan(spark, "filter_eq")
    assert "Not(EqualTo(o_orderstatus,F))" in _plan(spark, "filter_ne")
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", _plan(spark, "proj_select"))
    assert {re.sub(r"#\d+L?$", "", c) for c in scans[0].split(",")} == {"o_orderkey", "o_orderdate", "o_totalprice"}


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from panelspark.session import checkpoint_folder

    assert checkpoint_folder("hdfs://x/ckpt", "yarn") == "hdfs://x/ckpt"
    assert checkpoint_folder(None, "local[4]")
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]", "k8s://h"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_folder(None, master)
