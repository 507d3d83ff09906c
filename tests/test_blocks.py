"""Blocks of a document-term matrix against plain sums over the entries."""

import random
import re

import numpy as np
import pytest
from paths import SF_SMALL as SF

from panelspark.operators import blocks as bl
from panelspark.plans import corpus

SHAPE = bl.BlockShape(4, 8)


@pytest.fixture(scope="module")
def entries(spark):
    r = random.Random(5)
    cells = {(r.randrange(30), r.randrange(50)): float(r.randrange(1, 9)) for _ in range(300)}
    cells.update({(7, c): 1.0 for c in range(50)})      # a document that holds every term
    cells.update({(d, 11): 2.0 for d in range(30)})     # a term that is in every document
    cells.update({(10**10, 10**10): 3.0})               # indices beyond 32 bits
    df = spark.createDataFrame([(d, c, v) for (d, c), v in cells.items()], "doc_index long, term_index long, n double")
    return cells, df


def test_round_trip_and_bounds(spark, entries):
    cells, df = entries
    blocks = bl.to_blocks(df.repartition(5), SHAPE)
    assert {(r.doc_index, r.term_index): r.n for r in bl.from_blocks(blocks, SHAPE).collect()} == cells
    for b in blocks.collect():
        assert len(b.rows) <= SHAPE.rows and len(b.vals) == len(b.cols) <= SHAPE.rows * SHAPE.cols
        assert b.starts[0] == 0 and b.starts[-1] == len(b.vals) and len(b.starts) == len(b.rows) + 1
        assert b.rows == sorted(set(b.rows)) and all(0 <= c < SHAPE.cols for c in b.cols)


def test_entries_are_exchanged_once(entries):
    plan = bl.to_blocks(entries[1], SHAPE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_margins(entries):
    cells, df = entries
    blocks = bl.to_blocks(df, SHAPE)
    rows, cols = {}, {}
    for (d, c), v in cells.items():
        rows[d] = rows.get(d, 0) + v
        cols[c] = cols.get(c, 0) + v
    assert {r.doc_index: r.total for r in bl.row_sums(blocks, SHAPE).collect()} == rows
    assert {r.term_index: r.total for r in bl.col_sums(blocks, SHAPE).collect()} == cols
    assert sum(r.nnz for r in bl.block_stats(blocks).collect()) == len(cells)


def test_products(spark, entries):
    cells, df = entries
    blocks = bl.to_blocks(df, SHAPE)
    w = {c: [c / 4 - 3, float(c % 3)] for c in range(0, 50, 2)}   # every other term has no weight
    got = bl.multiply(blocks, spark.createDataFrame(list(w.items()), "term_index long, w array<double>"), 2, SHAPE)
    want = {}
    for (d, c), v in cells.items():
        if c < 50:
            y = want.setdefault(d, [0.0, 0.0])
            for j in range(2):
                y[j] += v * w.get(c, [0.0, 0.0])[j]
    assert {r.doc_index: r.y for r in got.collect()} == want
    u = {d: [float(d % 5)] for d in range(30)}
    got = bl.multiply_transposed(blocks, spark.createDataFrame(list(u.items()), "doc_index long, w array<double>"), 1, SHAPE)
    want = {}
    for (d, c), v in cells.items():
        if d < 30:
            want[c] = want.get(c, 0.0) + v * u[d][0]
    assert {r.term_index: r.y[0] for r in got.collect()} == want


def test_empty_missing_and_repeated(spark):
    kind = "doc_index long, term_index long, n double"
    none = bl.to_blocks(spark.createDataFrame([], kind), SHAPE)
    assert none.collect() == [] and bl.row_sums(none, SHAPE).collect() == []
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (None, 1, 1.0), (1, None, 1.0), (1, 1, None)], kind)
    assert [tuple(r) for r in bl.from_blocks(bl.to_blocks(df, SHAPE), SHAPE).collect()] == [(0, 0, 3.0)]
    with pytest.raises(ValueError):
        bl.BlockShape(0, 5)


def test_blocks_are_packed_from_a_sorted_stream(spark, entries):
    """No list is collected a line or a block, and dense arrays are not copied for every block that meets them."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    blocks = bl.to_blocks(entries[1], SHAPE)
    assert "collect_list" not in plan(blocks)
    got = bl.multiply(blocks, spark.createDataFrame([(1, [1.0])], "term_index long, w array<double>"), 1, SHAPE)
    assert "explode" not in plan(got) and "collect_list" not in plan(got)
    with pytest.raises(Exception, match="occurs twice"):
        bl.multiply(blocks, spark.createDataFrame([(1, [1.0]), (1, [2.0])], "term_index long, w array<double>"), 1, SHAPE).collect()


def test_counts_in_stretches_are_those_of_the_tokens(spark):
    """Words counted in stretches and numbered once a stretch, a document in many of them, a missing one and words of it alone."""
    r = random.Random(3)
    rows = [(r.choice([None, -4, 2, 3, 10**12]), r.choice(["a", "é", "z", "日本", "𝔸", "b's", "￿"])) for _ in range(300)]
    rows += [(None, "alone"), (5, "of five")]
    tokens = spark.createDataFrame(rows, "doc_id long, word string").repartition(7)
    counts = bl.packed_counts(tokens).cache()
    docs = sorted({d for d, _ in rows}, key=lambda d: (d is not None, d))
    words = sorted({w for _, w in rows}, key=str.encode)
    number = lambda x, name, kind: spark.createDataFrame([(v, i) for i, v in enumerate(x)], f"{name} {kind}, {number_of[name]} long")
    number_of = {"doc_id": "doc_index", "word": "term_index"}
    found = bl.counted_entries(counts, number(docs, "doc_id", "long"), number(words, "word", "string"))
    want = {}
    for d, w in rows:
        if d is not None:
            key = docs.index(d), words.index(w)
            want[key] = want.get(key, 0) + 1
    assert len(counts.collect()) > 1
    blocks = bl.to_blocks(found, bl.BlockShape(2, 3))
    got = bl.from_blocks(blocks, bl.BlockShape(2, 3)).collect()
    assert {(x.doc_index, x.term_index): x.n for x in got} == want and len(got) == len(want)
    only = bl.packed_counts(spark.createDataFrame([(None, "x"), (None, "y")], "doc_id long, word string"))
    assert bl.counted_entries(only, number([None], "doc_id", "long"), number(["x", "y"], "word", "string")).collect() == []
    assert {t for x in only.collect() for t in x.terms} == {"x", "y"}


def test_squeezed_numbers_come_back():
    columns = [np.array([5, 0, -3, 1 << 62]), np.array([0.5, -0.0, float("inf"), 1e-300]), np.zeros(4, np.int64)]
    kinds = (np.int64, np.float64, np.int64)
    for n in (4, 1, 0):
        data = bl.squeezed(*[c[:n] for c in columns])
        assert [x.tobytes() for x in bl.loosened(data, *kinds)] == [c[:n].tobytes() for c in columns]


def test_tokens_and_entries_are_not_exchanged_as_rows(spark):
    """Stopwords are broadcast, words counted where they are read, and entries and blocks sent as compressed values."""
    exchanged = lambda df: set(re.findall(r"hashpartitioning\(([^)]*?), \d+\)", df._jdf.queryExecution().executedPlan().toString()))
    docs = corpus.CorpusParams()
    assert exchanged(corpus.kept_tokens(spark, SF, docs)) == set()
    matrix = corpus.document_matrix(spark, SF, docs)
    blocks = bl.to_blocks(matrix.entries, SHAPE)
    by = {re.sub(r"#\w+", "", x) for x in exchanged(blocks)}
    assert by <= {"bucket", "stretch", "word", "doc_id"}
    asked = sum(len(r.terms) for r in bl.packed_counts(corpus.kept_tokens(spark, SF, docs)).select("terms").collect())
    assert asked < matrix.entries.count() / 2
