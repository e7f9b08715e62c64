"""From raw documents to packed training sequences, in five stages; each is stored and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return
the columns of ``documents``. What a stage rejects is gone for good, and what it changes stays changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm import language, line_dedup, ngram_join, packing, quality
from answerloom.llm.texts import free_name
from answerloom.session import stage

MIN_LANGUAGE_SCORE = 0.5
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language stays open, go. The model learns from the ``lang`` of these documents."""
    return language.confident(docs, language.fit(docs), MIN_LANGUAGE_SCORE)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the word rules or consist of lines all over their host go; from the others such lines are
    taken out, and ``n_chars`` follows the text where it changes."""
    before = free_name(docs, "_before")
    left = quality.filter_quality(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    size = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", size).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays. ``n_chars`` follows the text; documents left without a word go, as all
    they held stands elsewhere."""
    left = line_dedup.dedup_lines(docs).where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id. Near are texts whose
    shingles of five words have a Jaccard index of 0.8 or more; three words and 0.9 are the contract of op9 alone."""
    return ngram_join.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(stage(packing.pieces(docs), "pieces"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each),
    ("best_fit_packing", pack_sequences),
]

# Learned weights, edit distances and packing have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
