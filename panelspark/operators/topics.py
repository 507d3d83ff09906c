"""Document-term matrix and topics by expectation maximisation on DataFrames.

The matrix stays in coordinate form: (document, word, n). A topic model is two tables, word
weights (word, w1..wk), which sum to 1 over the words of a topic, and document weights
(document, t1..tk), which sum to 1 over the topics of a document. A step joins the counts with
both, splits every count over the topics in proportion to w_i * t_i, and adds the parts up by
word and by document in one aggregate over two grouping sets, which is written once. Only the k
topic totals and the log-likelihood reach the driver.

This is the EM fit of topic mixtures with a pseudo-count for every word (``eta``) and topic
(``alpha``), i.e. the posterior mode of latent Dirichlet allocation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.relational import sequence_number, top_k_ties
from panelspark.operators.text import join_totals
from panelspark.session import materialize

ALPHA, ETA = 0.1, 0.01


def vocabulary(counts: DataFrame, term: str = "word") -> DataFrame:
    """(term, term_index) with 0-based indices in term order."""
    words = counts.select(term).distinct()
    return sequence_number(words, [F.asc(term)], "term_index").withColumn(
        "term_index", F.col("term_index") - 1)


def dtm_entries(counts: DataFrame, vocab: DataFrame, doc: str = "author", term: str = "word",
                n: str = "n") -> DataFrame:
    """Coordinate form of the document-term matrix: (doc, term_index, n)."""
    return counts.join(vocab, term).select(doc, "term_index", F.col(n).cast("double").alias("n"))


def dtm_stats(entries: DataFrame, doc: str = "author") -> DataFrame:
    """Per document: non-zero entries, row sum, and the vocabulary size (columns)."""
    n_terms = entries.agg(F.countDistinct("term_index")).scalar()  # scalar subquery
    return entries.groupBy(doc).agg(
        F.count(F.lit(1)).alias("nnz"),
        F.sum("n").alias("row_sum"),
    ).withColumn("n_terms", n_terms)


def start_columns(term: str, topics: range) -> list[Column]:
    """a1..ak: a word's start weight in a topic is the hash (first eight hex digits of the MD5) of
    "word#topic", as a share of 2^32."""
    def weight(i: int):
        text = F.concat(F.col(term), F.lit(f"#{i}"))
        return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))).alias(f"a{i}")

    return [weight(i) for i in topics]


def start_weights(counts: DataFrame, term: str, topics: range) -> DataFrame:
    """(term, a1..ak), written: the start weights of all words."""
    return materialize(counts.select(term).distinct().select(term, *start_columns(term, topics)), "topic-start")


class TopicFit:
    """A topic model in the course of its fit."""

    def __init__(self, counts: DataFrame, k: int, doc: str = "author", term: str = "word", n: str = "n"):
        """Start: word weights by hash (:func:`start_weights`) over the topic's total; a document has
        all topics in equal parts."""
        self.k, self.doc, self.term, self.n = k, doc, term, n
        self.counts = counts
        self.steps, self.likelihood = 0, None
        self._set_words(start_weights(counts, term, self.topics), 0.0)
        self.docs = counts.select(doc).distinct().select(doc, *[F.lit(1.0 / k).alias(f"t{i}") for i in self.topics])

    @property
    def topics(self) -> range:
        return range(1, self.k + 1)

    def _set_words(self, sums: DataFrame, eta: float) -> None:
        total = sums.agg(*[F.sum(F.col(f"a{i}") + eta).alias(f"a{i}") for i in self.topics]).first()
        self.words = sums.select(self.term, *[((F.col(f"a{i}") + eta) / F.lit(total[f"a{i}"])).alias(f"w{i}")
                                              for i in self.topics])

    def step(self) -> "TopicFit":
        """One round: every count split over the topics, parts added up by word and by document."""
        j = join_totals(self.counts.join(self.words, self.term), self.docs, (self.doc,), self.term)
        part = {i: F.col(f"w{i}") * F.col(f"t{i}") for i in self.topics}
        j = j.withColumns({f"p{i}": p for i, p in part.items()})
        j = j.withColumn("s", sum((F.col(f"p{i}") for i in list(self.topics)[1:]), F.col("p1")))
        sums = [F.sum(F.col(self.n) * F.col(f"p{i}") / F.col("s")).alias(f"a{i}") for i in self.topics]
        both = j.groupingSets([[self.term], [self.doc]], self.term, self.doc).agg(
            *sums, F.sum(F.col(self.n) * F.ln("s")).alias("ll"), F.grouping(self.term).alias("of_doc"))
        both = materialize(both, "topic-step")
        words, docs = both.where("of_doc = 0"), both.where("of_doc = 1")
        self.likelihood = docs.agg(F.sum("ll")).first()[0]
        self._set_words(words, ETA)
        whole = sum((F.col(f"a{i}") for i in list(self.topics)[1:]), F.col("a1")) + F.lit(self.k * ALPHA)
        self.docs = docs.select(self.doc, *[((F.col(f"a{i}") + ALPHA) / whole).alias(f"t{i}") for i in self.topics])
        self.steps += 1
        return self

    def run(self, steps: int) -> "TopicFit":
        for _ in range(steps):
            self.step()
        return self

    def until(self, tolerance: float, limit: int) -> "TopicFit":
        """Steps until the log-likelihood changes by less than ``tolerance``, relatively; it is an
        error if ``limit`` steps are not enough."""
        while True:
            before = self.likelihood
            self.step()
            if before is not None and abs(self.likelihood - before) <= tolerance * abs(before):
                return self
            if self.steps >= limit:
                raise RuntimeError(f"no convergence to {tolerance} in {limit} steps")

    def beta(self) -> DataFrame:
        """Long topic-term table (topic 1..k, term, beta); beta sums to 1 per topic."""
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("topic"), F.col(f"w{i}").alias("beta")) for i in self.topics]))
        return self.words.select(F.col(self.term).alias("term"), pairs.alias("p")).select(
            F.col("p.topic").alias("topic"), "term", F.col("p.beta").alias("beta"))


def top_topic_terms(beta: DataFrame, k: int = 5) -> DataFrame:
    """Top k terms per topic by beta (ties kept; all terms where there are fewer), ordered by
    topic, then beta descending."""
    return top_k_ties(beta, ["topic"], "beta", k).orderBy("topic", F.desc("beta"), "term")


def topic_summary(beta: DataFrame) -> DataFrame:
    """Per topic: number of terms and total weight."""
    return beta.groupBy("topic").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("beta").alias("beta_sum"))
