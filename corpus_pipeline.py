"""The corpus pipeline: documents through quality rules, near-dedup, substring dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspark.llm import decontaminate, packing, quality_rules, sentence_spans, simhash
from crawlspark.llm.common import folders_made, folders_since, prepare, read_table, remove_folders, scratch_path

TOKENIZER = "word_bpe_49k.json"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []  # folders the stage before left behind


def _stage(f: Stage) -> Stage:
    """A stage's rows are written before the next stage is called, which then removes what the first left."""
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_folders(prepare(spark), _left)
        mark = folders_made()
        out = f(spark, docs, sf_dir)
        _left[:] = folders_since(mark)
        return out

    return run_stage


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or are bad by the posterior of all rules, go."""
    return quality_rules.keep_good(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (four-word shingles, four or fewer differing bits) stays."""
    return simhash.drop_near_duplicates(docs, words=simhash.WORDS, limit=simhash.MAX_BITS)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentences are cut from the texts; documents of which nothing is left go.

    `n_chars` becomes the length of the text that is left.
    """
    cut = sentence_spans.remove_repeats(docs)
    left = cut.filter((F.col("dedup.n_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a few edits, go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces of sequences instead of documents."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

# estimation, fingerprints and approximate matching have no SQL form; tests/llm/test_pipeline.py holds a brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each written as Parquet in the shared folder and read again."""
    prepare(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        remove_folders(spark, before)
        docs, before = spark.read.parquet(path), [path]
    remove_folders(spark, _left)
    _left.clear()
    return docs
