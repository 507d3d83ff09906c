"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import (chat, decontam, filteraudit, langid, linededup, lmscore, mixing, neardup, quality, rules,
                            suffixdedup, tokenbin, whitening)
from panelspark.llm.common import documents
from panelspark.session import shared_path


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    mixed = mixing.mix_sources(docs, keep_text=False)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_corpus(documents(spark, sf_dir, "doc_id", "text"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), words_per_shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.dedup_substrings(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    tokenbin.write_tokens(documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenbin.read_checksums(spark, path).withColumnRenamed("id", "doc_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.classify(documents(spark, sf_dir, "doc_id", "text", "source", "lang"), labels)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    judged = rules.judged_stats(docs)
    failed = rules.base_rules({k: F.col(k) for k in rules.STATS})
    base = failed["few_words"] | failed["repeats"]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base.alias("base_failed"), (~base & F.col("failed_rule").isNull()).alias("kept"))


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["stop"]))
    return chat.perspectives(turns).withColumn("mask", F.array_join(spans, ","))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontam.find_passages(documents(spark, sf_dir, "doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return filteraudit.audit(documents(spark, sf_dir, "doc_id", "text", "lang"), labels)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    train = docs.where(~langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(train))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (
    op1_mix, op2_line_dedup, op3_lm_scoring, op4_near_duplicates, op5_suffix_dedup, op6_token_binary,
    op7_quality_classifier, op8_quality_rules,
    op9_chat_perspectives, op10_decontaminate, op11_filter_audit, op12_language_id, op13_whitening)}
