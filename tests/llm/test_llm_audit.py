"""Filter audit, language identification and whitening against plain versions, on awkward rows too."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from llm_paths import SF
from pyspark.sql import functions as F

from panelspark.llm import filteraudit, langid, whitening

# ---------------------------------------------------------------- filter audit


def plain_audit(rows, labels):
    first = {}
    for r in rows:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            first[t] = min(first.get(t, r["doc_id"]), r["doc_id"])
    good = {x["doc_id"] for x in labels if x["quality"] == 1 and x["doc_id"] is not None}
    toxic = {x["doc_id"] for x in labels if x["toxic"] == 1 and x["doc_id"] is not None}
    docs = defaultdict(list)
    for r in rows:
        t, i = r["text"] or "", r["doc_id"]
        w = brute.words(t)
        fails = {f for f, bad in (
            ("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)),
            ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))),
            ("E", t in first and (i is None or first[t] < i))) if bad}
        docs[r["lang"] or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, own in docs.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in own)
                shapley[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in own),
                    sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit(spark, awkward, rows, none, sf_rows):
    kind = "doc_id long, quality int, toxic int, lang string"
    some = [(6, 1, 0), (6, 0, 1), (0, None, 1), (None, 1, 1), (1000, 1, 0), (2003, 0, 1), (77777, 1, 1), (7, 1, None)]
    labels = spark.createDataFrame([(*x, "no") for x in some], kind)
    said = [r.asDict() for r in labels.collect()]
    key = lambda r: (r.part, r.filter_order, r.step)
    found = filteraudit.audit(awkward, labels).collect()
    assert len({key(r) for r in found}) == len(found)
    assert {key(r): [r[c] for c in filteraudit.COUNTS] for r in found} == plain_audit(rows, said)
    assert filteraudit.audit(awkward, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
    assert filteraudit.audit(none, labels).collect() == []
    true = spark.read.parquet(f"{SF}/labels.parquet")
    found = filteraudit.audit(spark.read.parquet(f"{SF}/documents.parquet"), true).collect()
    assert {key(r): [r[c] for c in filteraudit.COUNTS] for r in found} == plain_audit(
        sf_rows, [r.asDict() for r in true.collect()])


def test_contraction_of_other_filters(spark):
    rows = [("p", i, 1 + i % 3, i % 2, 0) for i in range(8)]
    found = filteraudit.contract(spark.createDataFrame(rows, "part string, fails int, n long, good long, toxic long"), "XYZ")
    for r in found.collect():
        bits = [4 >> "XYZ".index(f) for f in r.filter_order]
        before, own = sum(bits[:r.step - 1]), bits[r.step - 1]
        assert r.removed == sum(n for _, f, n, _, _ in rows if not f & before and f & own)
        assert r.redundant == sum(n for _, f, n, _, _ in rows if f & before and f & own)
    assert found.count() == 18


# ---------------------------------------------------------------- language identification


def plain_posteriors(scores, start, move):
    total, k = defaultdict(float), len(start)
    for path in itertools.product(range(k), repeat=len(scores)):
        w = start[path[0]] + sum(s[j] for s, j in zip(scores, path)) + sum(move[a][b] for a, b in zip(path, path[1:]))
        for t, j in enumerate(path):
            total[t, j] += math.exp(w)
        for t, ab in enumerate(zip(path, path[1:])):
            total[("pair", *ab)] += math.exp(w)
        total["z"] += math.exp(w)
    return total


def test_forward_backward():
    rng = np.random.default_rng(5)
    sizes, k = [1, 4, 6, 2, 5], 3
    scores, start, move = rng.normal(size=(sum(sizes), k)), rng.normal(size=k), rng.normal(size=(k, k))
    starts = np.cumsum(sizes) - np.array(sizes)
    found = langid.posteriors(scores, starts, start, move)
    for a, n in zip(starts, sizes):
        want = plain_posteriors(scores[a:a + n].tolist(), start.tolist(), move.tolist())
        assert np.allclose(found[a:a + n], [[want[t, j] / want["z"] for j in range(k)] for t in range(n)])
    one = rng.normal(size=(2, 5, k))
    labels, pairs, z = langid.expectations(one, start, move)
    want = [plain_posteriors(c.tolist(), start.tolist(), move.tolist()) for c in one]
    assert np.allclose(labels[1], [[want[1][t, j] / want[1]["z"] for j in range(k)] for t in range(5)])
    assert np.allclose(pairs, [[sum(w["pair", a, b] / w["z"] for w in want) for b in range(k)] for a in range(k)])
    assert abs(z - sum(math.log(w["z"]) for w in want)) < 1e-9


def test_forward_backward_over_blocks():
    """Chains longer than a block, and many chains: the same as one recursion over each chain."""
    rng = np.random.default_rng(6)
    sizes, k = [700, 1, 300, 129, 128], 4
    scores, start, move = 3 * rng.normal(size=(sum(sizes), k)), rng.normal(size=k), rng.normal(size=(k, k))
    starts = np.cumsum(sizes) - np.array(sizes)
    found = langid.posteriors(scores, starts, start, move)
    for a, n in zip(starts, sizes):
        want = langid.expectations(scores[None, a:a + n], start, move)[0][0]
        assert np.allclose(found[a:a + n], want / want.sum(axis=1, keepdims=True))


def test_features_of_a_word():
    who, what = langid.features(["abcde", "é"])
    # 5 + 4 + 3 n-grams and 4 affixes at each end; 1 n-gram and 2 affixes
    assert Counter(who.tolist()) == {0: 20, 1: 3}
    again = langid.features(["é", "abcde"])
    assert sorted(what[who == 0]) == sorted(again[1][again[0] == 1])


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    return langid.learn(docs.where(~langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()))


def test_held_out_languages(spark, model):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").where(langid.held_out(F.col("doc_id")))
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 200 and sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    per = Counter(r.lang for r in found)
    assert len(per) == 4


def test_words_of_a_text_that_changes_language(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 2000")
    texts = {r.lang: langid.words_of(r.text)[40:80] for r in docs.collect()}
    words = texts["en"] + texts["de"] + texts["fr"]
    row = langid.identify(spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string"), model,
                          with_spans=True).first()
    said = [s.lang for s in row.spans for _ in range(s.start, s.stop)]
    assert row.spans[0].start == 0 and row.spans[-1].stop == len(words)
    assert sum(a == b for a, b in zip(said, ["en"] * 40 + ["de"] * 40 + ["fr"] * 40)) >= 105
    assert (np.diag(model.move) > model.move.mean(axis=1)).all()


def test_languages_of_awkward_rows(spark, awkward, rows, none, model):
    found = langid.identify(awkward, model).collect()
    assert Counter(r.doc_id for r in found) == Counter(r["doc_id"] for r in rows)
    by_id = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] not in (6, None)}
    for r in found:
        if r.doc_id in by_id:
            letters = any(map(str.isalpha, by_id[r.doc_id] or ""))
            assert (r.lang_pred == "und") == (not letters) and (r.score > 0) == letters
    assert langid.identify(none, model).collect() == []
    assert langid.learn(none) is None and langid.learn(awkward.where("lang IS NULL")) is None
    assert {(r.lang_pred, r.score) for r in langid.identify(awkward, None).collect()} == {("und", 0.0)}
    own = langid.learn(awkward)
    assert own.langs == ["de", "en"]
    again = langid.learn(awkward.repartition(3))
    assert all(np.array_equal(a, b) for a, b in zip(own.weights(), again.weights()))
    one = langid.learn(awkward.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(awkward, one).collect()} == {"en", "und"}


def test_language_of_a_very_long_text(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'es' AND length(text) > 500")
    text = " ".join([r.text for r in docs.collect()] * 400)[:5_000_000]
    row = langid.identify(spark.createDataFrame([(1, text)], "doc_id int, text string"), model).first()
    assert row.lang_pred == "es" and row.score > 0.9


# ---------------------------------------------------------------- whitening


def plain_whitening(rows, k=4):
    """{row number: (deviation, whitened values)}, n, explained shares; rows are (id, vector)."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, (_, v) in enumerate(rows)
            if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max(Counter(len(x) for _, x in good).items(), key=lambda kv: (kv[1], kv[0]))[0]
    good = [(i, x) for i, x in good if len(x) == d]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {i: (sum((n * c - s) ** 2 for c, s in zip(x, sums)),
               ((np.array(x) - np.array(sums) / n) @ u / np.sqrt(np.maximum(e, 1e-300)))) for i, x in good}
    return out, n, e / np.trace(centred.T @ centred / n), e


def check_whitening(found, rows, k=4):
    want, n, share, e = plain_whitening(rows, k)
    kept = [j for j in range(len(e)) if e[j] > 1e-12 * e[0]]
    assert len(found) == len(want) * len(kept)
    got = defaultdict(dict)
    for r in found:
        assert r.n == n and abs(r.explained - share[r.component - 1]) <= 1e-9 and r.identity_error <= 1e-9
        got[r.vec_id][r.component] = r
    for j in kept:
        a = np.array([got[rows[i][0]][j + 1].whitened for i in want])
        b = np.array([w[1][j] for w in want.values()])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) <= 1e-8
    assert all(got[rows[i][0]][1].deviation == w[0] for i, w in want.items())


def test_whitening(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    check_whitening(whitening.whiten(table).collect(), [(r.vec_id, r.embedding) for r in table.collect()])


def test_whitening_of_awkward_vectors(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1 + j) for j in range(7)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0] * 6 + [None]), (103, [1.0] * 6 + [float("nan")]),
             (104, [float("inf")] + [0.0] * 6), (105, [1.0, 2.0]), (106, [-0.0] * 7)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, x string, n int")
    check_whitening(whitening.whiten(df.repartition(5)).collect(), rows)
    again = whitening.whiten(df.repartition(2)).where("component = 1").collect()
    assert {r.vec_id for r in again} == {i for i, _ in rows} - {100, 101, 102, 103, 104, 105}
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id = 3 OR vec_id >= 200")).collect() == []        # one vector: no variance
    two = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (3, [2.0, 4.0, 6.0])]
    found = whitening.whiten(spark.createDataFrame(two, "vec_id int, embedding array<float>")).collect()
    assert [r.component for r in found] == [1] * 4 and {r.n for r in found} == {3}
    assert Counter(r.vec_id for r in found) == Counter([1, 2, 3, None])
    far = spark.createDataFrame([(1, [3e9, 0.0]), (2, [-3e9, 1.0]), (3, [1e30, 0.0])], "vec_id int, embedding array<double>")
    found = whitening.whiten(far).collect()
    assert {r.vec_id for r in found} == {1, 2} and all(r.deviation is None for r in found if r.component == 1)


def test_subspace_iteration_without_gaps():
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(90, 90)))[0]
    values = np.concatenate([[50.0, 10.0, 10.0 - 1e-3, 9.9], np.linspace(9.8, 5, 86)])
    v = (basis * values) @ basis.T
    found = whitening.principal_components(lambda q: v @ q, 90, 4)
    assert np.allclose(found.values, values[:4], atol=1e-11) and found.residual < 1e-13
    assert np.allclose(np.abs((basis[:, :4] * found.vectors).sum(axis=0)), 1, atol=1e-12)
