"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit of the codewords a binary classifier over hashed byte
n-grams (1 to 4 bytes of the lower-cased letters) predicts that bit. Its weights are smoothed
log-odds between the languages with the bit and those without, each language counting alike, and
its margin is their mean over the n-grams of a text. Decoding is loss-weighted (Escalera, Pujol and
Radeva, "On the Decoding Process in Ternary Error-Correcting Output Codes", 2010): the codeword
with the least weighted loss wins, where a bit counts for a language as much as it separates that
language in the training counts. The loss gap to the other codewords gives the score: a softmax whose
sharpness is fitted, by likelihood, on short pieces of training texts, where errors do occur, so that
scores of whole texts err on the low side. Equal losses go to the language that comes first.

Training reads all labelled rows: counts of n-grams by language are summed up in Spark, and what
reaches the driver is bounded by 2**BUCKET_BITS rows for each language. Whole texts are read both
in training and in prediction; a text larger than a chunk is a chunk of its own. The pieces for the
sharpness are one of PIECE characters from each of at most SAMPLE training texts.

Null text and text without a letter are ``und`` with score 0. Null labels are not learned from.
Repeated rows are predicted alike. Without labelled rows everything is ``und``; with one language
everything with a letter is that language, score 1. Other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches
from .words import LOWER, text_chunks

BUCKET_BITS = 16
ORDERS = (1, 2, 3, 4)
AMBIGUOUS = 0.6
#: For the sharpness of the score: training texts, and characters of the piece taken from each.
SAMPLE, PIECE = 2000, 24

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def ngrams(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the texts and the buckets of their n-grams, in the texts' order. Whatever lies between letters is one space."""
    x = _LETTER[buf]
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    keep = x != 32
    keep[1:] |= (x[:-1] != 32) & (doc[1:] == doc[:-1])
    x, doc = x[keep], doc[keep]
    y, d = x.astype(np.uint32), doc
    for order in ORDERS:
        m = len(y) - order + 1
        if m <= 0:
            continue
        same = d[:m] == d[order - 1 :]
        code = np.full(m, order, np.uint32)
        for k in range(order):
            code = code * np.uint32(0x01000193) ^ y[k : k + m]
        code *= np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        yield d[:m][same], (code >> np.uint32(32 - BUCKET_BITS))[same]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BUCKET_BITS, np.int64))
    for batch in batches:
        for lo, hi, buf, offsets in text_chunks(batch.column(0)):
            names, index = np.unique(np.array(batch.column(1).slice(lo, hi - lo).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for doc, bucket in ngrams(buf, offsets):
                flat = (index.reshape(-1)[doc].astype(np.int64) << BUCKET_BITS) | bucket
                table = np.bincount(flat, minlength=len(names) << BUCKET_BITS).reshape(len(names), -1)
                for k, name in enumerate(names):
                    sums[name] += table[k]
    for name, table in sums.items():
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(table[some], pa.int64())], ["lang", "bucket", "n"])


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all splits of up to five languages, else 31 splits that keep the rows far apart."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 5:
        splits = np.arange(1, 1 << (k - 1))
        return np.where((splits[None, :] << 1 >> np.arange(k)[:, None]) & 1, 1.0, -1.0)
    best, apart = None, -1
    for seed in range(200):
        code = np.where(np.random.default_rng(seed).random((k, max(31, 4 * k.bit_length()))) < 0.5, -1.0, 1.0)
        if (np.abs(code.sum(0)) < k).all() and (d := min((code[i] != code[j]).sum() for i in range(k) for j in range(i))) > apart:
            best, apart = code, d
    return best


@dataclass
class Model:
    """weights: bucket x bit; code: language x bit; share: how much a bit counts for a language, rows sum to 1."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    share: np.ndarray
    sharp: float = 1.0

    def margins(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        sums, seen = np.zeros((n, self.weights.shape[1])), np.zeros(n)
        for doc, bucket in ngrams(buf, offsets):
            seen += np.bincount(doc, minlength=n)
            if len(doc):
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                for bit in range(self.weights.shape[1]):
                    sums[doc[first], bit] += np.add.reduceat(self.weights[bucket, bit], first)
        return sums / np.maximum(seen, 1)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        return np.stack([(self.share[i] * np.logaddexp(0, -4 * self.code[i] * margins)).sum(1) for i in range(len(self.code))], 1)

    def sharpen(self, texts: list[str], langs: list[str]) -> None:
        """Sets the sharpness under which these texts' languages are likeliest; a tenth of a right and a wrong text each keep it finite."""
        if len(self.languages) < 2 or not texts:
            return
        raw = [t.encode() for t in texts]
        loss = self.losses(self.margins(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
        gap = loss - loss[np.arange(len(raw)), np.searchsorted(self.languages, langs)][:, None]

        def cost(sharp: float) -> float:
            return np.logaddexp.reduce(-sharp * gap, 1).sum() + 0.1 * np.logaddexp(0, sharp * np.abs(gap).max())

        self.sharp = float(min(np.geomspace(0.5, 200, 60), key=cost))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language number of each row of margins, and a score between 0 and 1."""
        loss = self.losses(margins)
        best = loss.argmin(1)
        near = np.exp(-self.sharp * (loss - loss.min(1, keepdims=True)))
        return best, (1 / near.sum(1)).clip(0, 1)


def fit(labelled: DataFrame) -> Model:
    """labelled: text, lang. All of its rows with both count."""
    bound_batches(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    share = np.zeros((len(languages), 1 << BUCKET_BITS))
    if not languages:
        return Model([], np.ones((0, 0)), np.zeros((1 << BUCKET_BITS, 0), np.float32), np.ones((0, 0)))
    np.add.at(share, (np.searchsorted(languages, sums["lang"].to_numpy(str)), sums["bucket"].to_numpy()), sums["n"].to_numpy())
    share = (share + 0.5) / (share + 0.5).sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((1 << BUCKET_BITS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        on = code[:, bit] > 0
        weights[:, bit] = np.log(share[on].mean(0) / share[~on].mean(0))
    expected = share @ weights * code
    expected = np.maximum(expected, 1e-3)
    model = Model(languages, code, weights, expected / expected.sum(1, keepdims=True) if code.shape[1] else np.ones((len(languages), 0)))
    order = F.xxhash64("text", "lang")
    at = (F.pmod(order, F.greatest(F.length("text") - PIECE, F.lit(1)).cast("long")) + 1).cast("int")
    some = rows.select(F.substring(F.col("text"), at, F.lit(PIECE)).alias("piece"), "lang", order.alias("order")).orderBy("order", "piece", "lang").limit(SAMPLE).collect()
    some = [x for x in some if any(map(str.isalpha, x.piece))]
    model.sharpen([x.piece for x in some], [x.lang for x in some])
    return model


def predict(docs: DataFrame, model: Model, keep: list[Column] | None = None) -> DataFrame:
    """The columns of keep (doc_id by default), then lang_pred, score and ambiguous."""
    bound_batches(docs.sparkSession)
    kept = docs.select(*(keep or [F.col("doc_id")]), F.col("text").cast("string").alias("text_"))
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names))
            for lo, hi, buf, offsets in text_chunks(column):
                if len(model.languages) > 1:
                    best, score = model.decode(model.margins(buf, offsets))
                else:
                    best, score = np.zeros(hi - lo, np.int64), np.ones(hi - lo)
                raw = buf.tobytes()
                ascii_letters = LOWER[buf]
                has = np.diff(np.concatenate([[0], np.cumsum((ascii_letters >= 97) & (ascii_letters <= 122))])[offsets]) > 0
                for i in np.flatnonzero(~has):  # perhaps letters of another alphabet
                    has[i] = any(map(str.isalpha, raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")))
                if not model.languages:
                    has[:] = False
                pred = [model.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                score = np.where(has, score, 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", lang_pred string, score double"
    return kept.mapInArrow(run, schema).withColumn("ambiguous", F.col("score") < AMBIGUOUS)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2
    model = fit(docs.where(~held))
    return predict(docs, model, [F.col("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out")])
