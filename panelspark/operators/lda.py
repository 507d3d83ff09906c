"""Latent Dirichlet allocation by variational expectation maximisation on DataFrames.

The posterior of a document's topic weights is a Dirichlet distribution with parameters gamma, that
of a word's topic is proportional to beta_i(word) exp(E ln theta_i), E ln theta_i = psi(gamma_i) -
psi(sum gamma). A step

1. joins the counts (document, word, n) with the topics' word weights;
2. ``inner`` times splits every count over the topics and adds the parts up by document, which
   gives new gammas (the fixed point of a document, approached for all documents at once);
3. adds the parts up by word, which gives the next word weights.

Where there are at most ``FEW`` documents (books, languages, sources), counts and weights of a word are held
in one row (:class:`HeldWords`): documents' weights come to the rows, so a step shuffles sums by document
only. A word's weights follow from its counts and the documents' weights of earlier steps, so they are
worked out on reading and written every ``KEPT_STEPS`` steps only. Where there are more documents, counts are
joined with both tables in every step, and written once for the step.

Each of the updates raises the evidence bound, so the bound never falls and its relative change
ends the fit. Digamma and log gamma are SQL expressions (recurrence by ten, then the asymptotic
series). Sums by document or word are combined map-side; a document's rows are
dealt over salted copies of its gammas, so a document that holds most of the words is no hot key.
The driver gets one row a step: topic totals, the bound's sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.text import join_totals
from panelspark.operators.topics import start_columns, start_weights
from panelspark.session import materialize

SHIFT = 10
#: Documents up to which words are held with their counts, and steps between two writes of their weights.
FEW, KEPT_STEPS = 1000, 4


def digamma(x: str) -> str:
    """SQL text of psi(x) for x > 0, to about 1e-14."""
    y = f"({x} + {SHIFT})"
    r = f"(1D / ({y} * {y}))"
    tail = f"{r} * (1D/12 - {r} * (1D/120 - {r} * (1D/252 - {r} * (1D/240 - {r} / 132D))))"
    return f"(ln({y}) - 0.5D / {y} - {tail} - (" + " + ".join(f"1D / ({x} + {i})" for i in range(SHIFT)) + "))"


def ln_gamma(x: str) -> str:
    """SQL text of ln Gamma(x) for 0 < x < 1e30."""
    y = f"({x} + {SHIFT})"
    r = f"(1D / ({y} * {y}))"
    tail = f"(1D/12 - {r} * (1D/360 - {r} * (1D/1260 - {r} / 1680D))) / {y}"
    product = " * ".join(f"({x} + {i})" for i in range(SHIFT))
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + {tail} - ln({product}))"


def psi(x: np.ndarray) -> np.ndarray:
    """As :func:`digamma`, of numbers."""
    y = x + SHIFT
    r = 1 / (y * y)
    tail = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return np.log(y) - 0.5 / y - tail - sum(1 / (x + i) for i in range(SHIFT))


def better_alpha(alpha: float, docs: int, k: int, log_weights: float) -> float:
    """The alpha that maximises docs (lnGamma(k a) - k lnGamma(a)) + a * log_weights, by bisection of
    the derivative, which falls in a; the old one where the search cannot improve on it."""
    def psi(x: float) -> float:
        r = (x + SHIFT) ** -2
        return (math.log(x + SHIFT) - 0.5 / (x + SHIFT) - r * (1 / 12 - r * (1 / 120 - r / 252))
                - sum(1 / (x + i) for i in range(SHIFT)))

    value = lambda a: docs * (math.lgamma(k * a) - k * math.lgamma(a)) + a * log_weights
    lo, hi = 1e-6, 1e6
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if docs * k * (psi(k * mid) - psi(mid)) + log_weights > 0 else (lo, mid)
    found = math.sqrt(lo * hi)
    return found if value(found) > value(alpha) else alpha


def split_counts(w: np.ndarray, own: np.ndarray, doc: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares of every count by topic, sum of their weights): counts ``n`` of words ``own`` in documents ``doc``."""
    p = w[own] * t[doc]
    s = p.sum(axis=1)
    with np.errstate(divide="raise", invalid="raise"):
        return p * (n / s)[:, None], s


def carried(batch: pa.RecordBatch, k: int, later: list) -> tuple[np.ndarray, ...]:
    """(weights, word, document, n) of a batch of held words, the weights carried over the later steps."""
    docs, ns = batch.column("docs"), batch.column("ns")
    off = docs.offsets.to_numpy()
    own = np.repeat(np.arange(batch.num_rows), np.diff(off))
    doc, n = docs.flatten().to_numpy(), ns.flatten().to_numpy(zero_copy_only=False)
    own, doc, n = own[doc >= 0], doc[doc >= 0], n[doc >= 0]
    uncounted = np.bincount(own, minlength=batch.num_rows) == 0
    w = np.stack([batch.column(f"w{i + 1}").to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
    for t, total in later:
        if t is not None:
            shares, _ = split_counts(w, own, doc, n, t)
            w = np.stack([np.bincount(own, x, batch.num_rows) for x in shares.T], axis=1)
            w[uncounted] = np.nan
        w = w / total
    return w, own, doc, n


class HeldWords:
    """Written rows (term, w1..wk, docs, ns): a word's weights at the last write and its counts by place of the
    document in ``docs`` (-1, and not counted, where it is missing). ``later`` has the documents' weights and topic totals of the steps since."""

    def __init__(self, counts: DataFrame, docs: list, k: int, doc: str, term: str, n: str):
        self.docs, self.k, self.term, self.later = docs, k, term, []
        topics = range(1, k + 1)
        kind = counts.select(F.col(doc).alias("_doc")).schema
        places = counts.sparkSession.createDataFrame([(d, i) for i, d in enumerate(docs)], kind.add("_at", "integer"))
        own = counts.where(F.col(term).isNotNull()).join(F.broadcast(places), F.col(doc) == F.col("_doc"), "left")
        own = own.withColumn("_at", F.when(F.col(n).isNull() | F.col("_at").isNull(), F.lit(-1)).otherwise(F.col("_at")))
        rows = own.groupBy(term).agg(F.collect_list(F.struct("_at", F.col(n).cast("double").alias("n"))).alias("c"))
        self.rows = materialize(rows.select(term, *start_columns(term, topics), F.col("c._at").alias("docs"), F.col("c.n").alias("ns"))
                                .withColumnsRenamed({f"a{i}": f"w{i}" for i in topics}), "lda-held")

    def sums(self, t: np.ndarray) -> tuple[np.ndarray, float]:
        """(sums by document and topic, log-likelihood) of the counts split by the documents' weights ``t``."""
        k, later, size = self.k, list(self.later), len(self.docs)

        def run(batches):
            out, ll = np.zeros((size, k)), np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    w, own, doc, n = carried(batch, k, later)
                    shares, s = split_counts(w, own, doc, n, t)
                    for i in range(k):
                        out[:, i] += np.bincount(doc, shares[:, i], size)
                    ll += np.bincount(doc, n * np.log(s), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *map(pa.array, out.T), pa.array(ll)],
                                             ["at", *[f"a{i + 1}" for i in range(k)], "ll"])

        cols = [f"a{i + 1}" for i in range(k)] + ["ll"]
        parts = self.rows.drop(self.term).mapInArrow(run, "at int, " + ", ".join(f"{c} double" for c in cols))
        found = np.zeros((size, k + 1))
        for r in parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in cols]).collect():
            found[r["at"]] = [r[c] for c in cols]
        return found[:, :k], float(found[:, k].sum())

    def step(self, t: np.ndarray | None, total: np.ndarray) -> None:
        """The next weights: the words' shares by ``t`` (or the weights as they are) over the topics' totals."""
        self.later.append((t, total))
        if len(self.later) > KEPT_STEPS:
            self.rows, self.later = materialize(self._now(True), "lda-held"), []

    def _now(self, counts: bool) -> DataFrame:
        k, later, term = self.k, list(self.later), self.term
        names = [f"w{i + 1}" for i in range(k)]
        kept = ["docs", "ns"] if counts else []

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    w = carried(batch, k, later)[0]
                    yield pa.RecordBatch.from_arrays([batch.column(term), *[pa.array(np.ascontiguousarray(x), from_pandas=True) for x in w.T],
                                                      *[batch.column(c) for c in kept]], [term, *names, *kept])

        schema = self.rows.select(term, *names, *kept).schema
        return self.rows.mapInArrow(run, schema)

    def words(self) -> DataFrame:
        """(term, w1..wk) after the steps so far."""
        return self._now(False)


class VariationalFit:
    """A topic model in the course of its fit; ``bounds`` has the evidence bound of every step."""

    def __init__(self, counts: DataFrame, k: int, doc: str = "author", term: str = "word", n: str = "n",
                 alpha: float | None = None, inner: int = 2, estimate_alpha: bool = False):
        """Start: word weights by hash as in :class:`~panelspark.operators.topics.TopicFit`; gammas as if
        every word were of all topics in equal parts; alpha 50 / k unless given."""
        self.k, self.doc, self.term, self.n, self.counts = k, doc, term, n, counts
        self.alpha = 50.0 / k if alpha is None else float(alpha)
        self.inner, self.estimate_alpha = inner, estimate_alpha
        self.bounds: list[float] = []
        docs = [r[0] for r in counts.where(F.col(term).isNotNull()).select(doc).distinct().limit(FEW + 1).collect()]
        self.missing = [None] if None in docs else []   # a missing document has no weights, as in a join
        docs = [x for x in docs if x is not None]
        self.held = HeldWords(counts, docs, k, doc, term, n) if 0 < len(docs) <= FEW else None
        if self.held:
            first = self.held.rows.agg(*[F.sum(f"w{i}") for i in self.topics]).first()
            self.held.step(None, np.array(first, float))
            self.words = self.held.words()
            size = dict(counts.groupBy(doc).agg(F.sum(n)).collect())
            self._set_gammas(self.alpha + np.array([[float(size[d]) / k] * k for d in docs]))
        else:
            start = start_weights(counts, term, self.topics)
            self._set_words(start, start.agg(*[F.sum(f"a{i}").alias(f"a{i}") for i in self.topics]).first())
            self._set_docs(counts.groupBy(doc).agg(*[(F.sum(n) / k).alias(f"a{i}") for i in self.topics]))

    @property
    def topics(self) -> range:
        return range(1, self.k + 1)

    def _set_words(self, sums: DataFrame, total) -> None:
        self.words = sums.select(self.term, *[(F.col(f"a{i}") / F.lit(total[f"a{i}"])).alias(f"w{i}") for i in self.topics])

    def _each(self, text: str, sep: str = " + ") -> str:
        return sep.join(text.format(i=i) for i in self.topics)

    def _set_docs(self, sums: DataFrame) -> None:
        """Written table (document, g1..gk, l1..lk, norm): gammas, E ln theta, and the log of the
        gammas' normaliser."""
        g = sums.select(self.doc, *[(F.lit(self.alpha) + F.col(f"a{i}")).alias(f"g{i}") for i in self.topics])
        g = g.selectExpr("*", f"{self._each('g{i}')} AS _g")
        held = g.selectExpr(f"`{self.doc}`", *[f"g{i}" for i in self.topics], f"{digamma('_g')} AS _whole",
                            *[f"{digamma(f'g{i}')} AS _d{i}" for i in self.topics],
                            " + ".join(ln_gamma(f"g{i}") for i in self.topics) + f" - {ln_gamma('_g')} AS norm")
        self.docs = materialize(held.selectExpr(f"`{self.doc}`", "norm", *[f"g{i}" for i in self.topics],
                                                *[f"_d{i} - _whole AS l{i}" for i in self.topics]), "lda-docs")

    def _parts(self, wide: DataFrame) -> DataFrame:
        """(document, term, n, s, p1..pk): every count's share of each topic before division by s."""
        weights = self.docs.selectExpr(f"`{self.doc}`", *[f"exp(l{i}) AS t{i}" for i in self.topics])
        j = join_totals(wide, weights, (self.doc,), self.term)
        j = j.selectExpr(f"`{self.doc}`", f"`{self.term}`", f"`{self.n}` AS _n", *[f"w{i} * t{i} AS p{i}" for i in self.topics])
        return j.selectExpr("*", f"{self._each('p{i}')} AS s")

    def _sums(self) -> list[Column]:
        return [F.expr(f"sum(_n * p{i} / s) AS a{i}") for i in self.topics]

    def _set_gammas(self, g: np.ndarray) -> None:
        """As :meth:`_set_docs`, of few documents."""
        logs = psi(g) - psi(g.sum(axis=1))[:, None]
        norm = [sum(map(math.lgamma, x)) - math.lgamma(sum(x)) for x in g.tolist()]
        self.gammas, self.logs, self.weights = g, logs, np.exp(logs)
        kind = self.counts.select(self.doc).schema
        for c in ["norm", *[f"g{i}" for i in self.topics], *[f"l{i}" for i in self.topics]]:
            kind = kind.add(c, "double")
        rows = [(d, x, *a, *b) for d, x, a, b in zip(self.held.docs, norm, g.tolist(), logs.tolist())]
        rows += [(d, *[None] * (2 * self.k + 1)) for d in self.missing]
        self.of = {"norm": sum(norm), "prior": float(((self.alpha - g) * logs).sum()), "logs": float(logs.sum()), "docs": len(rows)}
        self.docs = self.counts.sparkSession.createDataFrame(rows, kind)

    def _held_step(self) -> tuple[dict, dict]:
        """The words' next weights by the rows that hold them; the log-likelihood and the documents' sums."""
        for _ in range(self.inner):
            self._set_gammas(self.alpha + self.held.sums(self.weights)[0])
        sums, ll = self.held.sums(self.weights)
        self.held.step(self.weights, sums.sum(axis=0))
        self.words = self.held.words()
        return {"ll": ll}, self.of

    def _joined_step(self) -> tuple:
        """The words' next weights by joins of the counts with both tables; totals, the log-likelihood and the
        documents' sums."""
        wide = materialize(self.counts.join(self.words, self.term), "lda-counts")
        for _ in range(self.inner):
            self._set_docs(self._parts(wide).groupBy(self.doc).agg(*self._sums()))
        words = materialize(self._parts(wide).groupBy(self.term).agg(*self._sums(), F.expr("sum(_n * ln(s)) AS ll")),
                            "lda-words")
        total = words.agg(F.sum("ll").alias("ll"), *[F.sum(f"a{i}").alias(f"a{i}") for i in self.topics]).first()
        of = self.docs.selectExpr("norm", f"{self._each(f'({self.alpha!r}D - g{{i}}) * l{{i}}')} AS prior",
                                  f"{self._each('l{i}')} AS logs").agg(
            F.sum("norm").alias("norm"), F.sum("prior").alias("prior"), F.sum("logs").alias("logs"),
            F.count(F.lit(1)).alias("docs")).first()
        self._set_words(words, total)
        return total, of

    def step(self) -> "VariationalFit":
        total, of = self._held_step() if self.held else self._joined_step()
        constant = of["docs"] * (math.lgamma(self.k * self.alpha) - self.k * math.lgamma(self.alpha))
        self.bounds.append(constant + of["norm"] + of["prior"] + total["ll"])
        if self.estimate_alpha:
            self.alpha = better_alpha(self.alpha, of["docs"], self.k, of["logs"])
        return self

    def run(self, steps: int) -> "VariationalFit":
        for _ in range(steps):
            self.step()
        return self

    def until(self, tolerance: float, limit: int) -> "VariationalFit":
        """Steps until the bound changes by at most ``tolerance``, relatively; it is an error if
        ``limit`` steps are not enough."""
        while True:
            self.step()
            if len(self.bounds) > 1 and abs(self.bounds[-1] - self.bounds[-2]) <= tolerance * abs(self.bounds[-2]):
                return self
            if len(self.bounds) >= limit:
                raise RuntimeError(f"no convergence to {tolerance} in {limit} steps")

    def beta(self) -> DataFrame:
        """Long topic-term table (topic 1..k, term, beta); beta sums to 1 per topic."""
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("topic"), F.col(f"w{i}").alias("beta")) for i in self.topics]))
        return self.words.select(F.col(self.term).alias("term"), pairs.alias("p")).select(
            F.col("p.topic").alias("topic"), "term", F.col("p.beta").alias("beta"))

    def gamma(self) -> DataFrame:
        """Long document-topic table (document, topic 1..k, gamma): mean topic weights."""
        whole = F.expr(self._each("g{i}"))
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("topic"), (F.col(f"g{i}") / whole).alias("gamma"))
                                    for i in self.topics]))
        return self.docs.select(self.doc, pairs.alias("p")).select(
            self.doc, F.col("p.topic").alias("topic"), F.col("p.gamma").alias("gamma"))
