"""Token counts: the exact length histogram.

Documents are counted by encoded length, first within each batch, then in Spark. Suffix sums over
the histogram answer totals, quantiles and truncated totals for every context limit without
another look at the documents: the histogram is written first, a row for each length that occurs.
They are formed in two levels (blocks of lengths, then lengths within a block), so that no task has to
order all lengths; a single task orders the blocks, of which there are as many as the longest text has
multiples of 256 ids.

Texts are encoded whole, also very long ones. Null text and text without words have length 0. Documents
of equal length share a row. Repeated rows count each time. An empty table
gives an empty histogram. Only the text column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, bound_batches
from .tokens import CHUNK, default_tokenizer, encoder
from .words import text_chunks

BLOCK = 256


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """length, n_docs."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            sizes = [tool.counts(buf, offsets) for _, _, buf, offsets in text_chunks(batch.column(0), CHUNK)]
            if sizes:
                length, n = np.unique(np.concatenate(sizes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(n, pa.int64())], ["length", "n_docs"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds, for each length L: docs and tokens of documents of L ids or more, and all tokens if each document is cut to L."""
    rows = hist.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"), F.sum("t").over(every).alias("tokens_total"))
    within = Window.partitionBy("block").orderBy(F.desc("length"))
    return rows.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("tokens_above")).alias("tokens_at_least"),
        "tokens_total",
    ).withColumn("tokens_cut_to_length", F.col("tokens_total") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_over, tokens_kept: documents longer than the limit, and all tokens once each is cut to it."""
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    total = sums.agg(F.coalesce(F.max("tokens_total"), F.lit(0)).alias("total"))
    # The least length over the limit answers it: below that, docs_at_least and tokens_at_least don't change.
    least = F.broadcast(asked).join(sums, F.col("length") > F.col("context_limit")).groupBy("context_limit").agg(F.max("docs_at_least").alias("docs_over"), F.max("tokens_at_least").alias("over"))
    return asked.join(least, "context_limit", "left").join(total).select("context_limit", F.coalesce("docs_over", F.lit(0)).alias("docs_over"), (F.col("total") - F.coalesce("over", F.lit(0)) + F.col("context_limit") * F.coalesce("docs_over", F.lit(0))).alias("tokens_kept"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length L for which at least that share of the documents has L ids or fewer."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    n = sums.agg(F.max("docs_at_least").alias("n"))
    upto = sums.join(n).select("length", (F.col("n") - F.col("docs_at_least") + F.col("n_docs")).alias("upto"), "n")
    return F.broadcast(asked).join(upto, F.col("upto") >= F.col("share") * F.col("n")).groupBy("share").agg(F.min("length").alias("length"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    return suffix_sums(Scratch(spark).write(counted, "histogram"))
