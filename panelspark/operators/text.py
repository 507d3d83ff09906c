"""Corpus statistics: token counts, totals, Zipf table, tf-idf, stopwords, top terms.

A "document" here is whatever the ``author`` column groups (a book, a language, a source).
Tokens are produced by a JVM regex and counted with a partial + final hash aggregate, so a
frequent word is combined map-side and never ships its raw occurrences. Per-document and
per-word totals are separate aggregates joined back (not windows over a document, which
would put a whole document's vocabulary in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.semantics import rln, rlog10
from panelspark.functions.text import TOKEN_PATTERN, token_array
from panelspark.operators.relational import natural_join, sequence_number, top_k_ties


def tokenize(corpus: DataFrame, text: str = "text", keep=("doc_id", "author"),
             pattern: str = TOKEN_PATTERN) -> DataFrame:
    """One row per word token: (keep..., word)."""
    return corpus.select(*keep, F.explode(token_array(text, pattern)).alias("word"))


def token_stats(corpus: DataFrame, text: str = "text", keys=("doc_id", "author")) -> DataFrame:
    """Per document: number of tokens, distinct words, and total token characters."""
    toks = token_array(text)
    return corpus.select(
        *keys,
        F.size(toks).cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct(toks)).cast("bigint").alias("n_types"),
        F.aggregate(toks, F.lit(0).cast("bigint"), lambda acc, w: acc + F.length(w)).alias("token_chars"),
    )


def word_counts(tokens: DataFrame, by=("author",), sort: bool = False) -> DataFrame:
    """(by..., word, n): occurrences per group and word; optionally sorted by n desc, with the
    row's ``position`` in that order."""
    out = tokens.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    if not sort:
        return out
    return sequence_number(out, [F.desc("n"), *by, "word"], "position").orderBy("position")


#: Copies of a table of totals that a hot group's rows are dealt over.
SALTS = 16


def join_totals(counts: DataFrame, totals: DataFrame, by=("author",), term: str = "word") -> DataFrame:
    """Left-join one row per group to many rows per group.

    A group (a language) may hold most of the rows, so the rows are dealt over ``SALTS``
    copies of its total by a hash of the word: no task gets a whole group. The copies are
    few rows; where they are small the planner broadcasts them.
    """
    copies = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = counts.withColumn("_salt", F.pmod(F.hash(term), F.lit(SALTS)))
    return natural_join(dealt, copies, "left").drop("_salt")


def with_totals(counts: DataFrame, by=("author",), term: str = "word") -> DataFrame:
    """Add ``total`` = sum of n over the group (an aggregate joined back on the group)."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return join_totals(counts, totals, by, term)


def zipf_table(counts_with_totals: DataFrame, by=("author",)) -> DataFrame:
    """Rank (1 = most frequent, ties by word) and term frequency n / total within each group."""
    ranked = sequence_number(counts_with_totals, [F.desc("n"), F.asc("word")], "rank", group=list(by))
    return ranked.withColumn("term_frequency", F.col("n") / F.col("total"))


def zipf_loglog(zipf: DataFrame) -> DataFrame:
    """The Zipf plot table: log10 rank against log10 term frequency."""
    return zipf.select("author", "word", "rank",
                       rlog10("rank").alias("log_rank"),
                       rlog10("term_frequency").alias("log_tf"))


def tf_idf(counts: DataFrame, doc: str = "author", term: str = "word", n: str = "n") -> DataFrame:
    """tf = n / document total; idf = ln(documents / documents containing the term).

    Note the plain ln(N / df) (no smoothing), unlike ``pyspark.ml.feature.IDF``.
    """
    totals = counts.groupBy(doc).agg(F.sum(n).alias("_total"))
    dfreq = counts.groupBy(term).agg(F.count(F.lit(1)).alias("_df"))
    # number of documents: a scalar subquery (one distributed count, used as a constant)
    n_docs = counts.agg(F.countDistinct(doc)).scalar()
    j = join_totals(counts, totals, (doc,), term).join(dfreq, term)
    return j.select(
        doc, term, n,
        (F.col(n) / F.col("_total")).alias("tf"),
        rln(n_docs / F.col("_df")).alias("idf"),
    ).withColumn("tf_idf", F.col("tf") * F.col("idf"))


def remove_words(df: DataFrame, words: DataFrame, on: str = "word") -> DataFrame:
    """Anti-join against a word table (the planner broadcasts it where it is small)."""
    return df.join(words, on, "left_anti")


def top_terms(df: DataFrame, k: int, by=("author",), order: str = "tf_idf") -> DataFrame:
    """Top k rows per group by ``order`` descending, ties at the k-th place kept."""
    return top_k_ties(df, list(by), order, k)


def reorder_levels(df: DataFrame, label: str, value: str, out: str) -> DataFrame:
    """Ordinal level of each label by the mean of ``value`` over its rows (then by label)."""
    means = df.groupBy(label).agg(F.avg(value).alias(f"{out}_mean"))
    levels = sequence_number(means, [F.asc(f"{out}_mean"), F.asc(label)], out)
    return df.join(levels, label, "left")


def reorder_within(term: str, within: str, sep: str = "___"):
    """Composite facet label term___group (so a term can rank differently per facet)."""
    return F.concat_ws(sep, F.col(term), F.col(within).cast("string"))


def order_within(df: DataFrame, term: str, within: str, value: str, out: str) -> DataFrame:
    """The label of :func:`reorder_within` and the place of each label in its facet, by ascending
    ``value`` and then by term (the order in which a facet's bars are drawn)."""
    placed = sequence_number(df, [F.asc_nulls_last(value), F.asc(term)], f"{out}_place", group=[within])
    return placed.withColumn(out, reorder_within(term, within))
