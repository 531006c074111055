"""Sharding by weighted rendezvous hashing.

A record goes to the shard with the greatest score ``-weight / ln(u)``, where u is a hash of the
record's key and the shard's name, uniform in (0, 1). A shard that is added, with any weight,
takes records only into itself, and a shard that goes gives its records to all others.

slot numbers a shard's records from 0 without gaps, in the order of their key's digest. Records are
counted by ranges of that digest, the counts are summed up over the ranges, and only within a range
are records ordered, so that no task has to order a whole shard and the number of ranges, which
follows the number of records, doesn't show in the result.

A null key counts as the empty string. Null text has no bytes, hence size 8 and CRC 0. Repeated
rows share a shard and have a slot each. An empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, whole_text

SHARDS = 24
RANGE_ROWS = 4096


def score(key: Column, shard: int, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The number of the key's shard; shards without weight get nothing."""
    scores = [F.struct(score(key, k, w).alias("s"), F.lit(-k).alias("k")) for k, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("no shard has a weight")
    return -(F.greatest(*scores) if len(scores) > 1 else scores[0])["k"]


def with_slots(rows: DataFrame, key: Column, ties: list[str], ranges: int) -> DataFrame:
    """rows with a column shard get slot, a number from 0 within the shard, in the order of the key's digest."""
    dealt = rows.withColumn("digest_", F.md5(key)).withColumn("range_", F.floor(F.conv(F.substring("digest_", 1, 8), 16, 10).cast("double") * ranges / float(1 << 32)))
    sums = dealt.groupBy("shard", "range_").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "range_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_"))
    within = Window.partitionBy("shard", "range_").orderBy("digest_", *ties)
    return dealt.join(sums, ["shard", "range_"]).withColumn("slot", F.col("before_") + F.row_number().over(within) - 1).drop("digest_", "range_", "before_")


def shard_documents(docs: DataFrame, weights: list[float], grown: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more, of weight grown)."""
    doc_id = F.col("doc_id").cast("long")
    text = whole_text(F.col("text").cast("string"))
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("key_"))
    rows = rows.withColumn("shard", rendezvous(F.col("key_"), weights).cast("int"))
    # One more shard takes a record exactly if its score is greater than that of the record's shard.
    held = F.lit(None)
    for k, w in reversed([(k, w) for k, w in enumerate(weights) if w > 0]):
        held = F.when(F.col("shard") == k, score(F.col("key_"), k, w)).otherwise(held)
    rows = rows.withColumn("grown_shard", F.when(score(F.col("key_"), len(weights), grown) > held, F.lit(len(weights))).otherwise(F.col("shard")).cast("int"))
    rows = Scratch(docs.sparkSession).write(rows, "sharded")
    ranges = max(1, math.ceil(rows.count() / len(weights) / RANGE_ROWS))
    numbered = with_slots(rows, F.col("key_"), ["text_crc32", "size"], ranges)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * SHARDS)


#: Equal weights, for which the greatest score is that of the greatest u. The CRC is taken byte by byte from its table.
ORACLE = rf"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
b AS (SELECT r, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
c AS (SELECT r, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM b CROSS JOIN t),
u AS (SELECT r, k, CAST('0x' || substr(md5(key || ':' || k), 1, 12) AS BIGINT) AS u FROM d CROSS JOIN range(0, {SHARDS + 1}) s(k)),
s AS (SELECT r, arg_max(k, u) FILTER (k < {SHARDS}) AS shard, arg_max(k, u) AS grown FROM u GROUP BY r)
SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(key), crc, strlen(text)) - 1 AS BIGINT) AS slot, CAST(grown AS INT) AS grown_shard
FROM d JOIN c USING (r) JOIN s USING (r)
"""
