"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger holds the measurements and a long of failure bits for
each document; policies are versioned masks over those bits, so that changing a policy or asking
what a rule costs (an ablation) is a bitwise filter or aggregation over the ledger, without a
second look at any text.

Texts are measured whole; a text larger than a chunk is a chunk of its own. Words, windows and lines
are told apart by their bytes. Null text counts as text without words. Rows are never merged or
dropped: repeated rows give repeated ledger rows, an empty table gives an empty ledger, columns of
other names are ignored, also if they have the names of measurements.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import bound_batches, free_name
from .words import SPACE, Words, numbered, per_text, split_words, text_chunks

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower"]
_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

#: Bit number, name and failure test of every rule; a new rule takes the next bit, and bits are never reused.
RULES: list[tuple[int, str, Column]] = []


def _rules() -> list[tuple[int, str, Column]]:
    if not RULES:
        c = F.col
        RULES.extend(
            [
                (0, "too_few_words", c("n_words") < 50),
                (1, "repeated_words", 100 * c("n_repeat_words") > 50 * c("n_words")),
                (2, "symbols", 100 * c("n_symbols") > 30 * c("n_words")),
                (3, "repeated_lines", 100 * c("n_dup_lines") > 50 * c("n_lines")),
                (4, "short_words", c("word_chars") < 2 * c("n_words")),
                (5, "long_words", c("word_chars") > 20 * c("n_words")),
                (6, "shouting", c("n_upper") > c("n_lower")),
            ]
        )
    return RULES


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: bit for bit, name, _ in _rules()}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_words"))
V1 = Policy("v1", ("too_few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "shouting"))


def _repeated(words: Words) -> np.ndarray:
    """How many words of each text lie in a window of three that the text holds twice or more."""
    at = words.grams(3)
    if not len(at):
        return np.zeros(len(words.first) - 1, np.int64)
    number, distinct = words.numbers()
    # Two words in one number, then three: exact as long as the distinct words are fewer than 2**31.
    pair, many = number[:-1] * len(distinct) + number[1:], len(distinct) ** 2
    if many * len(distinct) >= 1 << 62:
        _, pair = np.unique(pair, return_inverse=True)
    gram = pair[at] * len(distinct) + number[at + 2]
    order = np.lexsort((gram, words.doc[at]))
    doc, gram = words.doc[at][order], gram[order]
    same = (doc[1:] == doc[:-1]) & (gram[1:] == gram[:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    covered = np.zeros(len(words.start), bool)
    for k in range(3):
        covered[hit + k] = True
    return per_text(covered, words.first)


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of the text."""
    buf, offsets = words.buf, words.offsets
    breaks = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(buf)]
    n = len(offsets) - 1
    if not len(start):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    end = np.append(start[1:], len(buf))
    doc = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(end, offsets[doc + 1])
    end = end - (buf[end - 1] == 10)
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[has], end[has], doc[has]
    number, _ = numbered(buf, start, end)
    order = np.lexsort((number, doc))
    doc, key = doc[order], number[order]
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1])
    return np.bincount(doc, minlength=n), np.bincount(doc[again], minlength=n)


def measure_chunk(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    words = split_words(buf, offsets)
    points = ~SPACE[buf] & ((buf & 0xC0) != 0x80)
    lines, dup_lines = _lines(words)
    return [
        words.counts,
        per_text(points, offsets),
        per_text(SYMBOLS[buf], offsets),
        dup_lines,
        _repeated(words),
        lines,
        per_text((buf >= 65) & (buf <= 90), offsets),
        per_text((buf >= 97) & (buf <= 122), offsets),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in text_chunks(batch.column(1)):
            columns = [batch.column(0).slice(lo, hi - lo)] + [pa.array(x, pa.int64()) for x in measure_chunk(buf, offsets)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *MEASURES])


def fail_bits() -> Column:
    """A bit for each rule that the measurements in scope fail."""
    bits = F.lit(0).cast("long")
    for bit, _, test in _rules():
        bits = bits.bitwiseOR(F.when(test, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, the measurements and fail_bits."""
    bound_batches(docs.sparkSession)
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, _SCHEMA)
    return measured.withColumn("fail_bits", fail_bits())


def apply_policy(rows: DataFrame, policy: Policy = V1) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    failed = lambda p: F.col("fail_bits").bitwiseAND(F.lit(p.mask)) != 0
    return rows.withColumns({"base_failed": failed(BASE), "kept": ~(failed(BASE) | failed(policy)), "policy": F.lit(policy.version)})


def ablation(rows: DataFrame, policy: Policy = V1) -> DataFrame:
    """For each rule of the policy: documents that fail it, those that fail nothing else, and how many stay without it."""
    masked = rows.select(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    parts = []
    for bit, name, _ in _rules():
        if policy.mask >> bit & 1:
            one, rest = F.lit(1 << bit), F.lit(policy.mask & ~(1 << bit))
            total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
            parts.append(F.struct(F.lit(name).alias("rule"), total(F.col("bits").bitwiseAND(one) != 0).alias("n_failed"), total(F.col("bits") == one).alias("n_only"), total(F.col("bits").bitwiseAND(rest) == 0).alias("n_kept_without")))
    return masked.agg(F.array(*parts).alias("rules")).select(F.inline("rules"))


def filter_documents(docs: DataFrame, policy: Policy = V1) -> DataFrame:
    """The documents that the policy keeps, with their columns as they were; repeated rows stay repeated.

    The bits are those of the ledger, and the policy's mask is applied to them. The measurements
    travel beside the row through Python, so no join and no shuffle is needed.
    """
    bound_batches(docs.sparkSession)
    names = docs.columns
    extra = free_name("measures", names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for lo, hi, buf, offsets in text_chunks(batch.column(at)):
                measures = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in measure_chunk(buf, offsets)], MEASURES)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, measures], [*names, extra])

    measured = StructType([StructField(m, LongType()) for m in MEASURES])
    judged = docs.mapInArrow(judge, StructType([*docs.schema.fields, StructField(extra, measured)]))
    rows = judged.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col(f"{extra}.*"))
    return rows.where(fail_bits().bitwiseAND(F.lit(policy.mask | BASE.mask)) == 0).select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_policy(ledger(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "n_lower", "fail_bits", "policy")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup
       FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(ln.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(ln.n, 0) AS BIGINT) AS n_lines,
        CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
        CAST(length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS BIGINT) AS n_lower
      FROM w LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
        + 4 * (100 * n_symbols > 30 * n_words)::INT + 8 * (100 * n_dup_lines > 50 * n_lines)::INT
        + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
        + 64 * (n_upper > n_lower)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, n_lines, n_upper, n_lower, fail_bits, 'v1' AS policy FROM b
"""
