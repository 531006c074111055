"""Collection statistics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Analyzer
from ..functions.text import raw_tokens
from .index import Index, build_index


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def occurrence_statistics(index: Index) -> DataFrame:
    """One row: averages of document length and of term length over occurrences, vocabulary, documents, terms."""
    terms = index.postings.agg(
        F.coalesce(F.sum(F.length("term") * F.col("tf")), F.lit(0)).alias("chars"),
        F.coalesce(F.sum("tf"), F.lit(0)).alias("n"),
        F.count_distinct("term").alias("vocabulary_size"),
    )
    scalars = index.scalars
    return scalars.join(F.broadcast(terms)).select(
        F.col("avg_doc_length").alias("avg_document_length"),
        _ratio(F.col("chars"), F.col("n")).alias("avg_term_length"),
        "vocabulary_size",
        F.col("doc_count").alias("total_documents"),
        F.col("total_terms").alias("total_tokens"),
    )


def vocabulary_statistics(docs: DataFrame, index: Index, indexing_time: float | None = None) -> DataFrame:
    """One row: raw tokens (case kept) and terms, with average lengths over distinct ones."""
    tokens = docs.select(F.explode(raw_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    tokens = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"), F.count("*").alias("distinct_tokens"), F.coalesce(F.sum(F.length("token")), F.lit(0)).alias("token_chars"))
    terms = index.postings.select("term").distinct().agg(F.count("*").alias("distinct_terms"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("term_chars"))
    row = index.scalars.join(F.broadcast(tokens)).join(F.broadcast(terms))  # tables of one row
    row = row.select(
        "total_tokens",
        "distinct_tokens",
        _ratio(F.col("token_chars"), F.col("distinct_tokens")).alias("avg_token_length"),
        "total_terms",
        "distinct_terms",
        "avg_doc_length",
        _ratio(F.col("term_chars"), F.col("distinct_terms")).alias("avg_term_length"),
    )
    return row if indexing_time is None else row.withColumn("indexing_time", F.lit(float(indexing_time)))


def experiment(files: dict[str, DataFrame], config: Analyzer, use_all_files: bool = True) -> list[dict]:
    """For each file (or the last one): name, file, total_tokens, time_seconds and statistics. No files give no results."""
    chosen = list(files.items()) if use_all_files else list(files.items())[-1:]
    results = []
    for name, docs in chosen:
        began = time.perf_counter()
        row = occurrence_statistics(build_index(docs, config)).first()
        results.append({"name": config.name, "file": name, "total_tokens": row["total_tokens"], "time_seconds": time.perf_counter() - began, "statistics": row.asDict()})
    return results


def synthesis(spark: SparkSession, results: dict[str, list[dict]]) -> DataFrame:
    """config, file, avg_document_length, avg_term_length, vocabulary_size, time_seconds: the last file of each configuration that has results."""
    last = [(config, rows[-1]) for config, rows in results.items() if rows]
    names = ("avg_document_length", "avg_term_length", "vocabulary_size")
    rows = [(config, r["file"], *(r["statistics"][n] for n in names), r["time_seconds"]) for config, r in last]
    return spark.createDataFrame(rows, "config string, file string, avg_document_length double, avg_term_length double, vocabulary_size long, time_seconds double")


def experiment_matrix(docs: DataFrame, file: str, configs: list[Analyzer]) -> DataFrame:
    """config, file, and the statistics: all files in one job for each configuration; file names a column of docs."""
    rows = None
    for config in configs:
        from .index import document_lengths, term_frequencies

        names = docs.select("doc_id", F.col(file).alias("file"))
        lengths = names.join(document_lengths(docs, config), "doc_id").groupBy("file").agg(F.count("*").alias("total_documents"), F.sum("dl").alias("total_tokens"))
        terms = term_frequencies(docs, config).join(names, "doc_id").groupBy("file").agg(F.count_distinct("term").alias("vocabulary_size"), F.sum(F.length("term") * F.col("tf")).alias("chars"))
        one = lengths.join(terms, "file", "left").select(
            F.lit(config.name).alias("config"),
            "file",
            "total_documents",
            "total_tokens",
            F.coalesce("vocabulary_size", F.lit(0)).alias("vocabulary_size"),
            _ratio(F.col("total_tokens"), F.col("total_documents")).alias("avg_document_length"),
            _ratio(F.coalesce("chars", F.lit(0)), F.col("total_tokens")).alias("avg_term_length"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows
