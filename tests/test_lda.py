"""The variational topic fit against a plain version, and its bound."""

import math
import os

import pytest

from panelspark.operators import lda
from panelspark.operators import topics as tp
from panelspark.operators.lda import VariationalFit, digamma, ln_gamma
from panelspark.registry import QUERIES
from panelspark.session import checkpoint_root
from paths import SF_SMALL

COUNTS = [("A", f"w{i}", 1 + i % 3) for i in range(30)] + [("B", f"v{i}", 2) for i in range(20)] + [("B", "w1", 4)]


def plain_psi(x):
    return (math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5


def plain_fit(start, k, steps, inner, alpha):
    """Word weights after ``steps`` rounds from the word weights ``start``."""
    docs = {d for d, _, _ in COUNTS}
    w = start
    g = {d: [alpha + sum(n for x, _, n in COUNTS if x == d) / k] * k for d in docs}
    psi = lambda x: plain_psi(x + 50) - sum(1 / (x + i) for i in range(50))
    for _ in range(steps):
        for last in [False] * inner + [True]:
            t = {d: [math.exp(psi(x) - psi(sum(v))) for x in v] for d, v in g.items()}
            new_g, new_w = {d: [alpha] * k for d in docs}, {word: [0.0] * k for word in w}
            for d, word, n in COUNTS:
                p = [a * b for a, b in zip(w[word], t[d])]
                for i in range(k):
                    new_g[d][i] += n * p[i] / sum(p)
                    new_w[word][i] += n * p[i] / sum(p)
            if not last:
                g = new_g
        total = [sum(v[i] for v in new_w.values()) for i in range(k)]
        w = {word: [v[i] / total[i] for i in range(k)] for word, v in new_w.items()}
    return w


def test_special_functions(spark):
    rows = spark.createDataFrame([(x,) for x in (0.01, 0.5, 1.0, 3.7, 250.0, 1e7)], "x double")
    for r in rows.selectExpr("x", f"{digamma('x')} AS d", f"{ln_gamma('x')} AS g").collect():
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11)
    psi = {r.x: r.d for r in rows.selectExpr("x", f"{digamma('x')} AS d").collect()}
    assert psi[1.0] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert psi[0.5] == pytest.approx(-1.9635100260214235, abs=1e-12)


def test_variational_steps(spark):
    counts = spark.createDataFrame(COUNTS, "author string, word string, n int")
    start = {r["word"]: [r["w1"], r["w2"], r["w3"]] for r in VariationalFit(counts, 3).words.collect()}
    got = {(r["topic"], r["term"]): r["beta"] for r in VariationalFit(counts, 3, alpha=0.7).run(3).beta().collect()}
    want = plain_fit(start, 3, 3, 2, 0.7)
    assert all(got[i + 1, w] == pytest.approx(v[i], rel=1e-5, abs=1e-12) for w, v in want.items() for i in range(3))


@pytest.mark.parametrize("estimate", [False, True])
def test_the_bound_never_falls(spark, estimate):
    counts = spark.createDataFrame(COUNTS, "author string, word string, n int")
    fit = VariationalFit(counts, 3, alpha=1.0, estimate_alpha=estimate).run(8)
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(fit.bounds, fit.bounds[1:]))
    assert (fit.alpha != 1.0) == estimate
    sums = {r["topic"]: r["beta_sum"] for r in tp.topic_summary(fit.beta()).collect()}
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    per_doc = fit.gamma().groupBy("author").sum("gamma").collect()
    assert len(per_doc) == 2 and all(abs(r[1] - 1) < 1e-9 for r in per_doc)


def test_held_words_are_the_joined_ones(spark, monkeypatch):
    """Few documents: as with joins, with a missing document (and a word of it alone) and a word twice. No step writes
    a row a word, but for a write of the weights every few steps."""
    monkeypatch.setattr(lda, "KEPT_STEPS", 2)
    more = [(None, "w1", 3), (None, "lost", 1), ("A", "w2", 5), ("B", None, 2)]
    counts = spark.createDataFrame([*COUNTS, *more], "author string, word string, n int")
    folder = checkpoint_root(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    held = VariationalFit(counts, 2).run(3)
    new = [f.rsplit("-", 1)[0] for f in set(os.listdir(folder)) - before]
    assert new == ["lda-held"] * 2
    monkeypatch.setattr(lda, "FEW", 0)
    joined = VariationalFit(counts, 2).run(3)
    assert held.held and not joined.held
    assert held.bounds == pytest.approx(joined.bounds, rel=1e-12)
    for name, key in (("beta", ("topic", "term")), ("gamma", ("author", "topic"))):
        a, b = ({tuple(r[c] for c in key): r[name] for r in getattr(f, name)().collect()} for f in (held, joined))
        assert a.keys() == b.keys() and sum(v is None for v in a.values()) == 2
        assert all(a[x] == (b[x] if b[x] is None else pytest.approx(b[x], rel=1e-9)) for x in a)


def test_the_fit_settles_or_fails(spark):
    counts = spark.createDataFrame(COUNTS, "author string, word string, n int")
    fit = VariationalFit(counts, 2).until(1e-3, 100)
    assert abs(fit.bounds[-1] - fit.bounds[-2]) <= 1e-3 * abs(fit.bounds[-2])
    with pytest.raises(RuntimeError, match="no convergence"):
        VariationalFit(counts, 2).until(1e-15, 2)


def test_every_language_is_in_the_corpus_keys(spark):
    langs = {r[0] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("lang").distinct().collect()}
    assert len(langs) == 4
    for key in ("tokenize_words", "word_counts", "tf_idf", "tfidf_top_terms", "topic_word_counts", "dtm_stats", "topic_gamma"):
        assert {r[0] for r in QUERIES[key](spark, SF_SMALL).select("author").distinct().collect()} == langs
