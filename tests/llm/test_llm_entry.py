"""The pipeline, the SQL of the queries, and the entry point."""

import brute
import duckdb
import pytest
from llm_paths import SF

import corpus_pipeline
from panelspark.llm.oracle import ORACLE
from panelspark.llm.queries import QUERIES


def same(a, b):
    fix = lambda x: tuple(round(v, 6) if isinstance(v, float) else v for v in x)
    return sorted(map(repr, map(fix, a))) == sorted(map(repr, map(fix, b)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert same([tuple(r[c] for c in columns) for r in found.collect()], want.fetchall())


def test_pipeline_stages(spark):
    """Each stage's decisions on its own input, then the whole run."""
    docs = corpus_pipeline.table(spark, SF, "documents").cache()
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, SF).cache()
        assert docs.columns == columns
        kept[name] = [r.asDict() for r in docs.collect()]
        rows = [r.asDict() for r in before.collect()]
        if name == "near-dedup":
            want = {d for d, _, c in brute.near_components(rows, 5) if d == c}
            assert {r["doc_id"] for r in kept[name]} == want and len(kept[name]) == len(want)
        if name == "benchmark decontamination":
            items = [r.asDict() for r in corpus_pipeline.table(spark, SF, "benchmark").collect()]
            assert {r["doc_id"] for r in kept[name]} == {w[0] for w in brute.passages(rows, items) if not w[2]}
        if name == "source mix":
            want = brute.mix(rows)
            target = {r["source"]: w[2] for r, w in zip(rows, want)}
            for s, t in target.items():
                assert abs(sum(len(brute.words(r["text"])) for r in kept[name] if r["source"] == s) - t) <= 1
            assert all(r["n_chars"] == len(r["text"]) for r in kept[name])
    last = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(r["doc_id"] for r in kept["source mix"])
    at = 0
    for r in sorted(last, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_classifier_stage_keeps_clean_documents(spark):
    sf = SF.replace("0.001", "0.01")
    docs = corpus_pipeline.table(spark, sf, "documents")
    labels = {r.doc_id: (r.quality, r.toxic) for r in corpus_pipeline.table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, sf).collect()}
    clean = [d in kept for d, k in labels.items() if k == (1, 0)]
    bad = [d in kept for d, k in labels.items() if k != (1, 0)]
    assert sum(clean) >= 0.98 * len(clean) and sum(bad) <= 0.1 * len(bad)


def test_entry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {*QUERIES, "pipeline"} <= set(names) and set(ORACLE) <= set(entry.oracle_sql())
