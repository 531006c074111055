"""Packing examples into sequences by vector bin packing.

An example has three demands: tokens, one segment, and loss-bearing tokens; a sequence limits all
three. Sequences are filled one at a time: of the examples that still fit, the one whose demand
vector has the greatest dot product with the sequence's remaining capacity goes in (Panigrahy et
al., "Heuristics for Vector Bin Packing", 2011). Examples of equal demands are interchangeable, so
a step scans the distinct demands, not the examples.

Examples are dealt by hash into groups of about equal size, and each group is packed alone; padding
arises only at a group's end. The hash takes in the row's place in the written table, so that equal
rows are dealt as evenly as others. A document longer than a sequence is cut into whole sequences and
one rest, and only the rest competes for space.

All ids of a plain document bear loss, so there only tokens and segments limit. In instruction data
(pack_conversations) only the ids of the assistant's turns do, and the third limit binds.

Texts are encoded whole, also very long ones. Null text is an empty text, whose only id is the end id.
A null doc_id is carried through. Ties go to the greater token count, then the order of doc_id and
start. Repeated rows are packed each time. An empty table gives an empty result. Other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch
from .tokens import CHUNK, default_tokenizer, encoder
from .words import text_chunks

LENGTH = 2048
SEGMENTS = 128
GROUP = 16_384
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(tokens: np.ndarray, loss: np.ndarray, length: int, segments: int, loss_limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin of each example and its offset there, and the number of bins. Every example must fit alone."""
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if tokens.max() > length or loss.max() > loss_limit or segments < 1:
        raise ValueError("an example exceeds the limits of a sequence")
    kinds, back = np.unique(np.stack([-tokens, -loss], 1), axis=0, return_inverse=True)
    back = back.reshape(-1)
    order = np.argsort(back, kind="stable")
    left = np.bincount(back)
    taken = np.concatenate([[0], np.cumsum(left)[:-1]])
    t, l = -kinds[:, 0], -kinds[:, 1]
    # Each dimension counts by its capacity and by how scarce it is over all examples.
    scarce = np.array([tokens.sum() / length, len(tokens) / segments, loss.sum() / loss_limit])
    scarce = scarce / scarce.sum()
    weight_t, weight_l = scarce[0] / length**2 * t, scarce[2] / loss_limit**2 * l
    weight_s = scarce[1] / segments**2
    where, offset = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    rest, b = len(tokens), -1
    while rest:
        b += 1
        room_t, room_s, room_l = length, segments, loss_limit
        live = np.flatnonzero(left)
        while room_s and len(live):
            live = live[(t[live] <= room_t) & (l[live] <= room_l) & (left[live] > 0)]
            if not len(live):
                break
            k = live[np.argmax(weight_t[live] * room_t + weight_l[live] * room_l + weight_s * room_s)]
            i = order[taken[k]]
            where[i], offset[i] = b, length - room_t
            taken[k] += 1
            left[k] -= 1
            rest -= 1
            room_t, room_s, room_l = room_t - t[k], room_s - 1, room_l - l[k]
    return where, offset, b + 1


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 1) -> DataFrame:
    """The documents' ids, each closed by the end id, cut at multiples of the length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            for lo, hi, buf, offsets in text_chunks(batch.column(1), CHUNK):
                ids, first = tool.ids(buf, offsets)
                ids = ids.astype("<u4", copy=False)
                sizes = np.diff(first) + 1
                n = -(-sizes // length)
                doc = np.repeat(np.arange(hi - lo), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
                stop = np.minimum(start + length, sizes[doc])
                crc = np.empty(len(doc), np.int64)
                for k, (a, b, last) in enumerate(zip(first[doc] + start, first[doc] + stop, stop == sizes[doc], strict=True)):
                    crc[k] = zlib.crc32(end, zlib.crc32(ids[a : b - 1])) if last else zlib.crc32(ids[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, stop - start, crc, sizes[doc]))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def pack_pieces(rows: DataFrame, length: int = LENGTH, segments: int = SEGMENTS, loss_limit: int | None = None, loss: str = "length", group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset. rows are read twice and should be a written table; loss names the column of loss-bearing tokens."""
    groups = max(1, -(-rows.count() // group))
    columns = rows.columns
    limit = loss_limit or length

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([c for c in ("doc_id", "conv_id", "start", "ids_crc32") if c in part], kind="stable").reset_index(drop=True)
        where, offset, _ = pack(part["length"].to_numpy(), part[loss].to_numpy(), length, segments, limit)
        return part[columns].assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    dealt = rows.withColumn("group_", F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group_").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, group: int = GROUP) -> DataFrame:
    cut = Scratch(docs.sparkSession).write(pieces(docs, tokenizer or default_tokenizer()), "pieces")
    return pack_pieces(cut, group=group)


def turn_tokens(turns: DataFrame, tokenizer: str, role: str = "assistant") -> DataFrame:
    """conv_id, turn, tokens (with an end id) and loss_tokens (those of the given role) of each turn."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            sizes = [tool.counts(buf, offsets) for _, _, buf, offsets in text_chunks(batch.column(3), CHUNK)]
            tokens = (np.concatenate(sizes) if sizes else np.zeros(0, np.int64)) + 1
            own = np.array(batch.column(2).fill_null(False).to_pylist(), bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens), pa.array(np.where(own, tokens, 0))], ["conv_id", "turn", "tokens", "loss_tokens"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), (F.col("role") == role).alias("own"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "conv_id long, turn long, tokens long, loss_tokens long")


def conversation_pieces(turns: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """conv_id, start, length, loss_tokens: conversations, their turns in order, cut at multiples of the length.

    Turns are only counted, and running sums place them, so no conversation's text is gathered. Equal
    turn numbers follow their counts; a null conv_id is one conversation.
    """
    counted = Scratch(turns.sparkSession).write(turn_tokens(turns, tokenizer), "turns")
    order = Window.partitionBy("conv_id").orderBy("turn", "tokens", "loss_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("at", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    last = F.floor((F.col("at") + F.col("tokens") - 1) / length)
    parts = placed.withColumn("piece", F.explode(F.sequence(F.floor(F.col("at") / length), last)))
    inside = F.least(F.col("at") + F.col("tokens"), (F.col("piece") + 1) * length) - F.greatest(F.col("at"), F.col("piece") * length)
    summed = parts.groupBy("conv_id", "piece").agg(F.sum(inside).alias("length"), F.sum(F.when(F.col("loss_tokens") > 0, inside).otherwise(F.lit(0))).alias("loss_tokens"))
    return summed.select("conv_id", (F.col("piece") * length).cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.col("loss_tokens").cast("long").alias("loss_tokens"))


def pack_conversations(turns: DataFrame, tokenizer: str | None = None, length: int = LENGTH, segments: int = 16, loss_limit: int = LENGTH * 3 // 4, group: int = GROUP) -> DataFrame:
    """Pieces of conversations in sequences, each with at most so many ids, segments and ids of the assistant.

    A piece that has more loss-bearing ids than the limit stands alone, its surplus without loss: its
    loss_tokens are cut to the limit.
    """
    rows = conversation_pieces(turns, tokenizer or default_tokenizer(), length)
    rows = rows.withColumn("loss_tokens", F.least("loss_tokens", F.lit(loss_limit)))
    return pack_pieces(Scratch(turns.sparkSession).write(rows, "pieces"), length, segments, loss_limit, "loss_tokens", group)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
