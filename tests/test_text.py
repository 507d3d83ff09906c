import math

import pytest


from panelspark.functions.text import token_array
from panelspark.operators import text as tx
from panelspark.operators import topics as tp
from panelspark.sources.stopwords import SPARK_ENGLISH_STOPWORDS, builtin_stopwords, custom_stopwords


def test_token_pattern_keeps_compound_tokens(spark):
    s = "The 10,000_l. of 4_I; don't _on_ U.S.A. 3.5x well-being foo,bar l’impôt ..a... e.g. 8vo"
    df = spark.createDataFrame([(s,)], "text string")
    got = df.select(token_array("text")).first()[0]
    assert got == ["the", "10,000_l", "of", "4_i", "don't", "_on_", "u.s.a", "3.5x", "well", "being",
                   "foo", "bar", "l’impôt", "a", "e.g", "8vo"]


def _corpus(spark):
    rows = [(1, "A", "a a b"), (2, "A", "c"), (3, "B", "a d d")]
    return spark.createDataFrame(rows, "doc_id int, author string, text string")


def test_counts_totals_zipf(spark):
    counts = tx.word_counts(tx.tokenize(_corpus(spark)))
    z = {(r["author"], r["word"]): r for r in tx.zipf_table(tx.with_totals(counts)).collect()}
    assert z[("A", "a")]["rank"] == 1 and z[("A", "b")]["rank"] == 2 and z[("A", "c")]["rank"] == 3
    assert z[("B", "d")]["rank"] == 1 and z[("A", "a")]["total"] == 4
    tf = {}
    for (a, _), r in z.items():
        tf[a] = tf.get(a, 0.0) + r["term_frequency"]
    assert all(math.isclose(v, 1.0) for v in tf.values())


def test_tf_idf_formula(spark):
    counts = tx.word_counts(tx.tokenize(_corpus(spark)))
    t = {(r["author"], r["word"]): r for r in tx.tf_idf(counts).collect()}
    assert t[("A", "a")]["idf"] == 0.0 and t[("A", "a")]["tf_idf"] == 0.0   # in every document
    assert math.isclose(t[("B", "d")]["idf"], math.log(2.0))
    assert math.isclose(t[("B", "d")]["tf_idf"], (2 / 3) * math.log(2.0))


def test_stopword_lists(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert SPARK_ENGLISH_STOPWORDS == StopWordsRemover.loadDefaultStopWords("english")
    assert builtin_stopwords(spark).count() == len(set(SPARK_ENGLISH_STOPWORDS))
    words = {r[0] for r in custom_stopwords(spark).collect()}
    assert "4_i" in words and "4_I" not in words and "10,000_l" in words


def test_remove_words_and_top_terms(spark):
    df = spark.createDataFrame([("A", "the", 5.0), ("A", "x", 3.0), ("A", "y", 3.0), ("A", "z", 1.0)],
                               "author string, word string, tf_idf double")
    sw = spark.createDataFrame([("the",)], "word string")
    kept = tx.remove_words(df, sw)
    assert kept.count() == 3
    assert tx.top_terms(kept, 1).count() == 2   # tie at first place


def test_token_stats(spark):
    df = spark.createDataFrame([(1, "A", "ab ab c")], "doc_id int, author string, text string")
    r = tx.token_stats(df).first()
    assert (r["n_tokens"], r["n_types"], r["token_chars"]) == (3, 2, 5)


def test_hot_group_totals(spark):
    rows = [("A", f"w{i}", 1) for i in range(500)] + [("B", "x", 7), (None, "y", 2)]
    counts = spark.createDataFrame(rows, "author string, word string, n int")
    got = {(r["author"], r["word"]): r["total"] for r in tx.with_totals(counts).collect()}
    assert len(got) == len(rows) and got["A", "w3"] == 500 and got["B", "x"] == 7


def test_order_within_facets(spark):
    df = spark.createDataFrame([("f", "a", 2.0), ("f", "b", 1.0), ("f", "c", 2.0), ("g", "a", 5.0)],
                               "facet string, term string, v double")
    got = {r["label"]: r["label_place"] for r in tx.order_within(df, "term", "facet", "v", "label").collect()}
    assert got == {"b___f": 1, "a___f": 2, "c___f": 3, "a___g": 1}


def _plain_em(counts, k, steps, alpha=0.1, eta=0.01):
    import hashlib
    words = sorted({w for _, w, _ in counts})
    docs = sorted({d for d, _, _ in counts})
    phi = [{w: int(hashlib.md5(f"{w}#{i}".encode()).hexdigest()[:8], 16) for w in words} for i in range(1, k + 1)]
    phi = [{w: x / sum(p.values()) for w, x in p.items()} for p in phi]
    theta = {d: [1 / k] * k for d in docs}
    for _ in range(steps):
        nw, nd = [dict.fromkeys(words, eta) for _ in range(k)], {d: [alpha] * k for d in docs}
        for d, w, n in counts:
            p = [phi[i][w] * theta[d][i] for i in range(k)]
            for i in range(k):
                nw[i][w] += n * p[i] / sum(p)
                nd[d][i] += n * p[i] / sum(p)
        phi = [{w: x / sum(p.values()) for w, x in p.items()} for p in nw]
        theta = {d: [x / sum(t) for x in t] for d, t in nd.items()}
    return {(i + 1, w): x for i, p in enumerate(phi) for w, x in p.items()}


COUNTS = [("A", f"w{i}", 1 + i % 3) for i in range(30)] + [("B", f"v{i}", 2) for i in range(20)] + [("B", "w1", 4)]


def test_topic_steps(spark):
    counts = spark.createDataFrame(COUNTS, "author string, word string, n int")
    for steps in (1, 4):
        got = {(r["topic"], r["term"]): r["beta"] for r in tp.TopicFit(counts, 3).run(steps).beta().collect()}
        want = _plain_em(COUNTS, 3, steps)
        assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], rel_tol=1e-9) for x in want)


def test_topic_fit_settles_or_fails(spark):
    counts = spark.createDataFrame(COUNTS, "author string, word string, n int")
    fit = tp.TopicFit(counts, 2).until(1e-2, 100)
    sums = {r["topic"]: r for r in tp.topic_summary(fit.beta()).collect()}
    assert all(abs(r["beta_sum"] - 1) < 1e-9 and r["n_terms"] == 50 for r in sums.values())
    with pytest.raises(RuntimeError, match="no convergence"):
        tp.TopicFit(counts, 2).until(1e-12, 3)


def test_top_topic_terms_with_a_small_vocabulary(spark):
    counts = spark.createDataFrame(COUNTS[:3], "author string, word string, n int")
    top = tp.top_topic_terms(tp.TopicFit(counts, 2).run(2).beta(), 5).collect()
    assert len(top) == 6   # three words in each of two topics
    assert [r["topic"] for r in top] == [1, 1, 1, 2, 2, 2]
    assert all(a["beta"] >= b["beta"] for a, b in zip(top, top[1:]) if a["topic"] == b["topic"])
