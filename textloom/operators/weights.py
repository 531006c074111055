"""Term weights: SMART ltn and ltc, and BM25."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BM25
from .index import Index

SCHEMES = ("ltn", "ltc", "bm25")


def ltn(tf: Column, df: Column, n: Column) -> Column:
    idf = F.when(n > df, F.log10(n / df)).otherwise(F.lit(0.0))
    return (1 + F.log10(tf)) * idf


def bm25(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column, p: BM25 = BM25()) -> Column:
    """The idf is negative for terms that more than half of the documents have."""
    idf = F.log10((n - df + 0.5) / (df + 0.5))
    return idf * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * dl / avgdl))


def with_statistics(postings: DataFrame, index: Index) -> DataFrame:
    """postings (all those of their terms) with df, if they don't have it, and the collection's scalars."""
    if "df" not in postings.columns:
        postings = postings.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term")
    return index.with_scalars(postings)


def document_norms(index: Index) -> DataFrame:
    """doc_id, norm: the length of each document's ltn vector over all its terms, 1 for a zero vector."""
    rows = index.postings if "df" in index.postings.columns else index.postings.join(index.terms, "term")
    weighted = index.with_scalars(rows).select("doc_id", ltn(F.col("tf"), F.col("df"), F.col("doc_count")).alias("w"))
    sums = weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return index.docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1.0)).alias("norm"))


def _selected(index: Index, terms: list[str] | DataFrame | None) -> DataFrame:
    """The postings of the given terms. This filter comes first: df depends on a term's own postings only."""
    if terms is None:
        return index.postings
    if isinstance(terms, list):
        return index.postings_for(terms)
    return index.postings.join(terms.select("term").distinct(), "term", "left_semi")


def weights_by_scheme(index: Index, schemes=SCHEMES, terms: list[str] | DataFrame | None = None, p: BM25 = BM25(), norms: DataFrame | None = None) -> DataFrame:
    """scheme, term, doc_id, weight for every posting of the given terms: all schemes from one pass over the postings.

    Norms are over the whole index, whatever the terms.
    """
    rows = with_statistics(_selected(index, terms), index)
    tf, df, n = F.col("tf"), F.col("df"), F.col("doc_count")
    plain = ltn(tf, df, n)
    if "bm25" in schemes and "dl" not in rows.columns:
        rows = rows.join(index.docs, "doc_id")
    if "ltc" in schemes:
        rows = rows.join(document_norms(index) if norms is None else norms, "doc_id")
    each = {"ltn": lambda: plain, "ltc": lambda: plain / F.col("norm"), "bm25": lambda: bm25(tf, df, n, F.col("dl"), F.col("avg_doc_length"), p)}
    listed = F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), each[s]().alias("weight")) for s in schemes]))
    return rows.select("term", "doc_id", listed.alias("w")).select("w.scheme", "term", "doc_id", "w.weight")


def weights(index: Index, scheme: str, terms: list[str] | DataFrame | None = None, p: BM25 = BM25(), norms: DataFrame | None = None) -> DataFrame:
    """term, doc_id, weight for every posting, or for those of the given terms; an unknown scheme is read as ltn, with a warning."""
    if scheme not in SCHEMES:
        logging.getLogger(__name__).warning("unknown scheme %s, ltn is used", scheme)
        scheme = "ltn"
    return weights_by_scheme(index, (scheme,), terms, p, norms).select("term", "doc_id", "weight")


def term_weight(index: Index, term: str, doc_id, scheme: str) -> DataFrame:
    """One row, weight: 0 if the term, the document or the scheme is unknown."""
    if scheme not in SCHEMES:
        return index.docs.sparkSession.createDataFrame([(0.0,)], "weight double")
    return weights(index, scheme, [term]).where(F.col("doc_id") == doc_id).agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"))


def rsv(index: Index, vector: dict[str, float], scheme: str) -> DataFrame:
    """doc_id, score: the dot product of every document that has a term with a query vector."""
    rows = weights(index, scheme, list(vector))
    q = F.create_map(*[x for t, w in vector.items() for x in (F.lit(t), F.lit(float(w)))])
    return rows.groupBy("doc_id").agg(F.sum(F.col("weight") * q[F.col("term")]).alias("score"))
