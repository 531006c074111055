"""A corpus pipeline of the operators in textloom.llm: from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import mixing, neardup, packing, quality, suffix
from textloom.llm.shared import Scratch

#: Four fifths of the tokens that reach the mixing stage, at most two epochs of any source.
MIX = mixing.Mix(weights=mixing.PRODUCTION.weights, share=(4, 5), max_epochs=2, seed=17)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects."""
    return quality.filter_documents(docs, quality.V1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked at similarity 0.8 or more over five-word shingles."""
    return neardup.drop_near_duplicates(docs, shingle=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more are cut wherever they occurred before."""
    return suffix.cut_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its budget, once for each epoch."""
    return mixing.mix_documents(docs, mixing.document_levels(), MIX)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, placed in sequences of at most 2048."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("packing", packed),
]

#: Packing needs a tokenizer, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each stage's rows are written and read again, so that no stage is computed twice."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
