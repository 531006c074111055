"""Repeated passages by a sparse suffix array.

A passage is repeated if it has 50 words or more and occurs at two places of the corpus. Of each
text, only the suffixes at minimiser positions are retained: a position is selected if the name of
the 8 words there is the least in some run of 32 such positions, which depends on the words alone.
Any window of 50 words therefore begins at most 31 words before a selected suffix whose first 19
words lie in the window, and equal windows select the same one.

1. Suffixes are sorted over the whole corpus: by their first 19 words, then by all words that a
   window using them can have (up to 31 to the left, 50 to the right), then by doc_id and position.
   Words are ordered by their names, which is as good an order as any for finding what is equal.
2. Neighbours are compared. Those that agree on all these words match over every window that uses
   the suffix; the match is extended to the left and to the right as far as such windows reach, and
   is kept as one span. All but the first of such a group occurred earlier.
3. Neighbours that share the first 19 words, but not all, may match over some windows only. The first
   of each group of equals is extended word by word, to the left by 0 to 31 words and to the right
   until 50 are reached, and each extension is looked up among those of the others. So passages that
   end within those words, or were edited there, are cut where their match ends.
4. The spans of a text are merged into maximal ones.

Sorting is by ranges of all sort columns, so that a passage that a third of all documents share is
dealt to as many tasks as it needs. Neighbours are compared within Arrow batches of a sorted
partition; suffixes at the edge of a batch are treated as in step 3, which decides exactly. Names
are 64 bits for the first 19 words and another 64 for what lies around them.

Texts are read whole. Null text has no words. Rows of one doc_id with the same text are one
occurrence and share their spans; copies under another doc_id repeat from end to end. A null doc_id
orders after all others. Words are ``[^\\x20\\x09-\\x0D]+``, compared by byte. Empty tables and
texts under 50 words give no spans; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .shared import Scratch, free_name, sized
from .words import Ranges, U, Words, joined, split_words, text_chunks

LEAST = 50
GRAM, RUN = 8, 32
HEAD = LEAST - RUN + 1

REPEATED, EARLIER, OPEN = 1, 2, 4
_SUFFIX = "head long, around long, doc long, key long, pos int, left int, near int"
_MET = "head long, doc long, key long, pos int, left int, near int, kind int"
_SPANS = "doc long, key long, repeats array<struct<lo:bigint,hi:bigint>>, cuts array<struct<lo:bigint,hi:bigint>>"
_WINDOW = "head long, name long, doc long, key long, start int"


def run_minima(words: Words, ranges: Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected positions, with the first and the last window start that selects each; at equal names the leftmost counts."""
    n = len(words.start)
    start = words.grams(LEAST)
    if not len(start):
        return start, start, start
    gram = ranges(np.arange(n - GRAM + 1), GRAM)
    # The least of each run, by doubling: the leftmost of equal minima wins.
    best, width = np.arange(len(gram)), 1
    while width < RUN:
        a, b = best[:-width], best[width:]
        best = np.where(gram[b] < gram[a], b, a)
        width *= 2
    choice = best[start]
    turn = np.flatnonzero(np.diff(choice)) + 1
    lows = np.concatenate([[0], turn])
    return choice[lows], start[lows], start[np.concatenate([turn - 1, [len(start) - 1]])]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in text_chunks(batch.column("text")):
            words = split_words(buf, offsets)
            first, second = words.values()
            ranges = Ranges(first)
            at, low, high = run_minima(words, ranges)
            doc = words.doc[at]
            before, after = np.minimum(RUN - 1, at - words.first[doc]), np.minimum(LEAST, words.first[doc + 1] - at)
            around = joined(Ranges(second)(at - before, before + after), before.astype(U))
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ranges(at, HEAD).view(np.int64)),
                    pa.array(around.view(np.int64)),
                    batch.column("doc").slice(lo, hi - lo).take(take),
                    batch.column("key").slice(lo, hi - lo).take(take),
                    *(pa.array(x, pa.int32()) for x in (at - words.first[doc], at - low, at - high)),
                ],
                ["head", "around", "doc", "key", "pos", "left", "near"],
            )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes; those with a neighbour of the same head, and what is known of them."""

    def changes(*columns: np.ndarray) -> np.ndarray:
        """Whether each row differs from the one before."""
        out = np.ones(len(columns[0]), bool)
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return out

    for batch in batches:
        columns = {name: batch.column(name).fill_null(0).to_numpy() for name in ("head", "around", "doc", "key", "pos")}
        own = np.flatnonzero(changes(*columns.values(), np.asarray(batch.column("doc").is_null())))  # repeated rows of one document are one occurrence
        if not len(own):
            continue
        head, around = columns["head"][own], columns["around"][own]
        first = changes(head, around)
        last = np.append(first[1:], True)
        group = np.cumsum(changes(head)) - 1
        blocks = np.bincount(group, first)
        kind = np.where(first & last, 0, REPEATED) | np.where(first, 0, EARLIER)
        kind |= np.where(first & ((blocks[group] > 1) | (group == 0) | (group == group[-1])), OPEN, 0)
        some = np.flatnonzero(kind)
        rows = batch.take(pa.array(own[some])).select(["head", "doc", "key", "pos", "left", "near"])
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(kind[some], pa.int32())], [*rows.schema.names, "kind"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text, the windows of the suffixes in ``open``."""
    for batch in batches:
        for lo, hi, buf, offsets in text_chunks(batch.column("text")):
            words = split_words(buf, offsets)
            lists = batch.column("open").slice(lo, hi - lo)
            text = lists.value_parent_indices().to_numpy()
            head, pos, left, near = (f.to_numpy() for f in lists.flatten().flatten())
            sizes = left - near + 1
            row = np.repeat(np.arange(len(pos)), sizes)
            start = np.repeat(pos - left, sizes) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            name = Ranges(words.values()[1])(words.first[text[row]] + start, LEAST) if len(row) else np.zeros(0, U)
            take = pa.array(text[row])
            yield pa.RecordBatch.from_arrays([pa.array(head[row]), pa.array(name.view(np.int64)), *(batch.column(c).slice(lo, hi - lo).take(take) for c in ("doc", "key")), pa.array(start, pa.int32())], ["head", "name", "doc", "key", "start"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text, maximal spans in words of the windows that begin in its ranges (lo to hi), and of those among them that are cuts."""

    def lists(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> pa.Array:
        order = np.lexsort((lo, text))
        text, lo, hi = text[order], lo[order].astype(np.int64), hi[order].astype(np.int64) + LEAST
        # Ends so far, in one running maximum over all texts: each text's are lifted over those of the texts before it.
        lift = text * (int(hi.max(initial=0)) + 1)
        reach = np.maximum.accumulate(hi + lift) - lift
        begins = np.ones(len(lo), bool)
        begins[1:] = (text[1:] != text[:-1]) | (lo[1:] > reach[:-1])
        at = np.flatnonzero(begins)
        last = np.append(at[1:], len(lo)) - 1 if len(at) else at
        spans = pa.StructArray.from_arrays([pa.array(lo[at]), pa.array(reach[last])], ["lo", "hi"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[at], np.arange(n + 1)), pa.int32()), spans)

    for batch in batches:
        ranges = batch.column("ranges")
        text = ranges.value_parent_indices().to_numpy()
        lo, hi, cut = (f.to_numpy(zero_copy_only=False) for f in ranges.flatten().flatten())
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), lists(text, lo, hi, n), lists(text[cut], lo[cut], hi[cut], n)], ["doc", "key", "repeats", "cuts"])


def _identified(docs: DataFrame) -> DataFrame:
    """doc, key, text: two columns that name a document and its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, key, repeats, cuts of each text with a repeated passage: its maximal repeated spans and those that occurred earlier, as arrays of (lo, hi) in words."""
    scratch = Scratch(docs.sparkSession)
    named = _identified(docs)
    suffixes = scratch.write(named.select("doc", "key", "text").mapInArrow(_suffixes, _SUFFIX), "suffixes")
    order = ["head", "around", F.col("doc").asc_nulls_last(), "key", "pos"]
    met = scratch.write(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compared, _MET), "met")
    scratch.drop("suffixes")

    open_ = met.where(F.col("kind").bitwiseAND(F.lit(OPEN)) != 0).groupBy("doc", "key").agg(F.collect_list(F.struct("head", "pos", "left", "near")).alias("open"))
    open_ = scratch.write(open_.withColumnsRenamed({"doc": "d", "key": "k"}), "open")
    same = (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d"))
    texts = named.join(sized(open_.select("d", "k"), 72), same, "left_semi")
    asked = texts.join(sized(open_, 72 + 32 * F.size("open")), same).select("doc", "key", "text", "open")
    windows = scratch.write(asked.mapInArrow(_windows, _WINDOW), "windows")
    place = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("key").alias("key"), F.col("start").alias("start"))
    # Written, so that the join has an exchange on either side, of which adaptive execution can split a crowded window.
    first = windows.groupBy("head", "name").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("head", "name", "first")
    found = windows.join(scratch.write(first, "first"), ["head", "name"])

    some = found.select("doc", "key", F.col("start").alias("lo"), F.col("start").alias("hi"), (place != F.col("first")).alias("cut"))
    whole = met.where(F.col("kind").bitwiseAND(F.lit(REPEATED)) != 0).select("doc", "key", (F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") - F.col("near")).alias("hi"), (F.col("kind").bitwiseAND(F.lit(EARLIER)) != 0).alias("cut"))
    lists = some.unionAll(whole).groupBy("doc", "key").agg(F.collect_set(F.struct("lo", "hi", "cut")).alias("ranges"))
    return scratch.keep(lists.mapInArrow(_merged, _SPANS), "spans")


def document_spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start_word, end_word: maximal repeated spans (kind repeat) and their parts that occurred earlier (kind cut)."""
    def listed(column: str, kind: str) -> Column:
        return F.transform(column, lambda s: F.struct(F.lit(kind).alias("kind"), s["lo"].alias("lo"), s["hi"].alias("hi")))

    rows = repeated_spans(docs).select(F.col("doc").alias("doc_id"), F.explode(F.concat(listed("repeats", "repeat"), listed("cuts", "cut"))).alias("s"))
    return rows.select("doc_id", "s.kind", F.col("s.lo").alias("start_word"), F.col("s.hi").alias("end_word")).distinct()


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without those words and the white space that follows each."""
    raw = text.encode()
    words = split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
    out, at = [], 0
    for lo, hi in spans:
        out.append(raw[at : words.start[lo]])
        at = words.start[hi] if hi < len(words.start) else len(raw)
    return b"".join([*out, raw[at:]]).decode()


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents without passages that occurred earlier; columns as they were, n_chars brought up to date.

    A document of which no word is left goes. Rows with null text stay.
    """
    spans = repeated_spans(docs).where(F.size("cuts") > 0)
    fields = docs.schema.fields
    names = docs.columns
    extra = free_name("spans", names)
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[: len(names)])
            lists = batch.column(len(names)).to_pylist()
            short = [i for i, v in enumerate(lists) if v]
            keep = np.ones(batch.num_rows, bool)
            if short:
                old = columns[text_at].to_pylist()
                for i in short:
                    old[i] = _cut(old[i], [(s["lo"], s["hi"]) for s in lists[i]])
                    keep[i] = bool(old[i].split())
                columns[text_at] = pa.array(old, columns[text_at].type)
                if chars_at is not None:
                    count = columns[chars_at].to_pylist()
                    for i in short:
                        count[i] = len(old[i])
                    columns[chars_at] = pa.array(count, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    row = F.struct(*[F.col(f"`{n}`") for n in names])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("key"))
    cuts = sized(spans.select(F.col("doc").alias("d"), F.col("key").alias("k"), "cuts"), 72 + 32 * F.size("cuts"))
    rows = marked.join(cuts, (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d")), "left")
    span = ArrayType(StructType([StructField("lo", LongType()), StructField("hi", LongType())]))
    rows = rows.select(*[F.col("row")[n].alias(n) for n in names], F.col("cuts").cast(span).alias(extra))
    return rows.mapInArrow(cut, StructType(fields))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g),
e AS (SELECT 'repeat' AS kind, doc_id, i FROM n WHERE n > 1 UNION ALL SELECT 'cut', doc_id, i FROM n WHERE k > 1),
b AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY kind, doc_id ORDER BY i) > 50, true) AS new FROM e),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY kind, doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT doc_id, kind, CAST(min(i) AS BIGINT) AS start_word, CAST(max(i) + 50 AS BIGINT) AS end_word FROM s GROUP BY doc_id, kind, s
"""
