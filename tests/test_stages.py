import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from panelspark.stages import StageStore


@pytest.fixture()
def source(spark, tmp_dir):
    spark.range(1000).select("id", (F.col("id") % 7).alias("g")).write.parquet(f"{tmp_dir}/in")
    return f"{tmp_dir}/in"


def files(folder):
    return sorted(os.path.join(at, n) for at, _, names in os.walk(folder) for n in names if n.endswith(".parquet"))


def run(spark, folder, source, least=0, version=""):
    store = StageStore(spark, folder)
    a = store.stage("big", spark.read.parquet(source).where(F.col("id") >= least), version)
    b = store.stage("sums", a.groupBy("g").agg(F.sum("id").alias("s")), version)
    return store, {r.g: r.s for r in b.collect()}


def test_an_unchanged_run_is_read_back(spark, tmp_dir, source):
    folder = f"{tmp_dir}/store"
    one, want = run(spark, folder, source)
    assert one.reused == set() and sum(want.values()) == 499500
    before = files(folder)
    two, got = run(spark, folder, source)
    assert two.reused == {"big", "sums"} and got == want and files(folder) == before


def test_a_changed_plan_version_or_input_runs_anew(spark, tmp_dir, source):
    folder = f"{tmp_dir}/store"
    run(spark, folder, source)
    two, got = run(spark, folder, source, least=900)
    assert two.reused == set() and sum(got.values()) == sum(range(900, 1000))
    assert run(spark, folder, source, least=900, version="b")[0].reused == set()
    spark.range(1000, 1001).select("id", (F.col("id") % 7).alias("g")).write.mode("append").parquet(source)
    four, got = run(spark, folder, source, least=900, version="b")
    assert four.reused == set() and sum(got.values()) == sum(range(900, 1001))
    assert len(os.listdir(f"{folder}/big")) == 1     # outputs that were replaced are removed


def test_literals_and_long_plans_are_told_apart(spark, tmp_dir, source):
    store = StageStore(spark, f"{tmp_dir}/store")
    wide = [[F.lit(i if i < 59 else last).alias(f"c{i}") for i in range(60)] for last in (59, 60)]
    rows = spark.read.parquet(source)
    assert store.fingerprint(rows.select(*wide[0])) != store.fingerprint(rows.select(*wide[1]))
    assert store.fingerprint(rows.select(*wide[0])) == store.fingerprint(spark.read.parquet(source).select(*wide[0]))


def test_a_killed_run_resumes_after_its_last_whole_stage(spark, tmp_dir, source):
    """The first run is another process that ends without notice while its second stage is written."""
    folder, root = f"{tmp_dir}/store", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from panelspark.session import local_session
from panelspark.stages import StageStore
spark = local_session(2, 2, driver_memory="1g")
store = StageStore(spark, {folder!r})
a = store.stage("big", spark.read.parquet({source!r}).where(F.col("id") >= 0))
a.groupBy("g").agg(F.sum("id").alias("s")).write.parquet({folder!r} + "/sums/half")
os.kill(os.getpid(), 9)
"""
    assert subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=240).returncode == -9
    store, got = run(spark, folder, source)
    assert store.reused == {"big"} and sum(got.values()) == 499500
    assert store.prune() == ["sums/half"]
    assert run(spark, folder, source)[0].reused == {"big", "sums"}


def test_a_damaged_output_is_not_read_back(spark, tmp_dir, source):
    folder = f"{tmp_dir}/store"
    run(spark, folder, source)
    os.remove(next(f for f in files(f"{folder}/big")))
    store, got = run(spark, folder, source)
    assert "big" not in store.reused and sum(got.values()) == 499500


def test_prune_and_clean(spark, tmp_dir, source):
    folder = f"{tmp_dir}/store"
    run(spark, folder, source)
    store = StageStore(spark, folder)
    store.stage("big", spark.read.parquet(source).where(F.col("id") >= 0))
    assert store.prune()[0] == "sums.json" and sorted(os.listdir(folder)) == ["_stage_store", "big", "big.json"]
    store.clean()
    assert os.listdir(folder) == []


def test_what_a_plan_does_not_show_needs_a_version(spark, tmp_dir, source):
    store = StageStore(spark, f"{tmp_dir}/store")
    spark.read.parquet(source).write.csv(f"{tmp_dir}/text")
    for hidden in (spark.createDataFrame([(1,)], "x int"), spark.read.schema("id long, g long").csv(f"{tmp_dir}/text"),
                   spark.read.parquet(source).mapInArrow(lambda batches: batches, "id long, g long")):
        with pytest.raises(ValueError, match="name a version"):
            store.stage("x", hidden)
    assert store.stage("x", spark.createDataFrame([(1,)], "x int"), version="1").count() == 1
    with pytest.raises(ValueError, match="there already"):
        store.stage("x", spark.range(1))
    with pytest.raises(ValueError, match="not a name"):
        store.stage("../x", spark.range(1))
    with pytest.raises(ValueError, match="not a stage store's"):
        StageStore(spark, tmp_dir)
