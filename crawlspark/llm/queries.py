"""Registered queries of the operators: thin callers that derive the required columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from crawlspark.llm import (
    chat, decontaminate, language_id, merkle, packing, pu_quality, quality_rules, sentence_spans, simhash, spelling, suffix_buckets,
    url_filter, warc_derive,
)
from crawlspark.llm.common import read_table
from crawlspark.llm.oracles import ORACLES  # noqa: F401  registered with the queries


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op1_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", *[f"counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op3_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality").filter(~held_out() & F.col("doc_id").isNotNull())
    by_doc = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    learn = docs.select("doc_id").filter(~held_out() & F.col("doc_id").isNotNull())
    scored = pu_quality.classify(
        docs, by_doc.filter("quality = 1"), learn, learn.join(by_doc, "doc_id", "left_anti"))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= pu_quality.DECISION).cast("int").alias("predicted"), F.col("prior").alias("class_prior"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derive.derive(warc_derive.responses(read_table(spark, sf_dir, "pages", "page_id", "url", "html")))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return sentence_spans.remove_repeats(docs).select("doc_id", "text", "dedup.n_removed", "dedup.n_spans")


def op6_pigeonhole_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.contaminations(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), docs.filter(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op9_chat_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op10_url_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages", "page_id", "url"))


def op11_incremental_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    return merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def op12_variable_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_buckets.digests(read_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_bm25_packing, op2_weak_supervision, op3_positive_unlabelled, op4_warc_derivatives, op5_sentence_spans,
    op6_pigeonhole_edits, op7_simhash_pivots, op8_compression, op9_chat_assembly, op10_url_ngrams,
    op11_incremental_witnesses, op12_variable_grams, op13_bucket_pointers,
)}
