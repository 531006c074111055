"""Documents that arrive as a stream, counted into postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Analyzer
from ..operators.index import occurrences


def stream_postings(docs: DataFrame, config: Analyzer = Analyzer()) -> DataFrame:
    """term, doc_id, tf of a streaming DataFrame (doc_id, text), kept up to date; for output modes update and complete."""
    if config.stem:
        raise ValueError("stems are taken over distinct terms, which a stream doesn't have; stem the postings of each batch")
    return occurrences(docs, config).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
