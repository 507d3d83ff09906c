"""A training corpus from the documents table, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontam, mixing, neardup, quality, tokenbin
from panelspark.session import materialize, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither poor nor toxic by the classifier."""
    return quality.classify(docs, table(spark, sf_dir, "labels"), carry=True).where("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (five-word shingles, similarity 0.8); documents
    whose words make no shingle stay."""
    return neardup.keep_one(docs, words_per_shingle=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weights 5, 2, 1: one row per copy that it takes."""
    mixed = mixing.emit_mix(mixing.mix_sources(docs))
    return mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the corpus, written and read back: place, length and checksum per document."""
    path = shared_path(spark, "corpus-tokens")
    tokenbin.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenbin.read_checksums(spark, path).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
    ("token output", token_output),
]

#: The classifier and MinHash are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
