"""Corpus statistics and topics as plans over the test corpus.

The raw text is tokenised and counted exactly once per plan: the (document, word, n)
counts are written to the shared checkpoint folder and every later step (totals, document
frequencies, ranks, tf-idf, the document-term matrix) reads that much smaller table.
Without this, each branch of a plan that reuses the counts would tokenise the corpus
again, because the optimizer gives each branch different inferred filters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import blocks as bl
from panelspark.operators import text as tx
from panelspark.operators.relational import sequence_number
from panelspark.session import materialize
from panelspark.sources.corpus import corpus_scan
from panelspark.sources.stopwords import builtin_stopwords, custom_stopwords


@dataclass(frozen=True)
class CorpusParams:
    group_col: str = "lang"                      # what plays the "author" (document) column
    groups: tuple | None = None                  # IN-list on it; all groups if there is none
    own_stopwords: tuple = ("the", "der", "les", "und", "que")   # removed with the custom list
    tie_rank: int = 200                          # a place where counts are tied
    top_terms: int = 15
    topics: int = 4
    topic_terms: int = 5
    topic_tolerance: float = 1e-4                # relative change of the bound that ends a fit
    topic_limit: int = 200                       # steps after which a fit has failed


def corpus(spark: SparkSession, base_dir: str, p: CorpusParams = CorpusParams()) -> DataFrame:
    meta = [c for c in ("source",) if c != p.group_col]
    return corpus_scan(spark, base_dir, p.group_col, None if p.groups is None else list(p.groups), meta)


def counts(spark: SparkSession, base_dir: str, p: CorpusParams = CorpusParams()) -> DataFrame:
    """(author, word, n), materialised once."""
    return materialize(tx.word_counts(tx.tokenize(corpus(spark, base_dir, p))), "word_counts")


def tfidf(spark: SparkSession, base_dir: str, p: CorpusParams = CorpusParams()) -> DataFrame:
    return tx.tf_idf(counts(spark, base_dir, p))


def cleaned(spark: SparkSession, base_dir: str, p: CorpusParams = CorpusParams()) -> DataFrame:
    """tf-idf computed with every word, then the custom stopwords removed."""
    return tx.remove_words(tfidf(spark, base_dir, p), custom_stopwords(spark, p.own_stopwords))


def kept_tokens(spark: SparkSession, base_dir: str, p: CorpusParams = CorpusParams()) -> DataFrame:
    """Tokens with the built-in English stopwords removed (before counting)."""
    return tx.remove_words(tx.tokenize(corpus(spark, base_dir, p)), builtin_stopwords(spark, "english"))


def topic_counts(spark: SparkSession, base_dir: str, p: CorpusParams = CorpusParams()) -> DataFrame:
    return materialize(tx.word_counts(kept_tokens(spark, base_dir, p)), "topic_counts")


@dataclass(frozen=True)
class DocumentMatrix:
    """Entries (doc_index, term_index, n) of a document-term matrix and the written tables of both axes."""
    entries: DataFrame
    docs: DataFrame     # (doc_id, doc_index)
    words: DataFrame    # (word, term_index)


def document_matrix(spark: SparkSession, base_dir: str, p: CorpusParams = CorpusParams()) -> DocumentMatrix:
    """The kept tokens of every document, counted once in stretches and written; indices count from 0 in the order of
    ids and words. The entries are not written: they are read once, by what cuts them into blocks."""
    own = materialize(bl.packed_counts(kept_tokens(spark, base_dir, p)), "document_counts")
    docs = sequence_number(own.select(F.explode("docs").alias("doc_id")).distinct(), [F.asc("doc_id")], "doc_index").select(
        "doc_id", (F.col("doc_index") - 1).alias("doc_index"))
    words = sequence_number(own.select(F.explode("terms").alias("word")).distinct(), [F.asc("word")], "term_index").select(
        "word", (F.col("term_index") - 1).alias("term_index"))
    return DocumentMatrix(bl.counted_entries(own, docs, words), docs, words)
