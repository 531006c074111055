"""Near-duplicate documents by b-bit MinHash.

A text's set holds 64-bit names of its distinct word shingles. Texts with equal sets form a class,
known by the least ``at`` of its rows, and only classes are compared. Minima of 180 hash functions
are cut into 36 bands of 5 for candidates (a pair of similarity 0.8 is missed with probability below
1e-6); of each minimum the lowest 2 bits are retained and packed into six longs. For a candidate,
the share of equal 2-bit slots, corrected for the 1/4 that collide by chance, estimates the
similarity, and pairs more than six standard errors below the threshold are discarded. What is left
is confirmed on the full sets.

Links inside a large bucket are not listed pair by pair. Each member is first compared with a few
leaders of its bucket, which are the same in all buckets of a crowd. When the confirmed links have
been joined into components, members outside their bucket's main component are compared by a prefix
join over their sets: items are ordered rarest first; of two sets that are similar enough, the
larger holds a common item among its first ``n - ceil(0.8 n) + 1`` and the smaller one among its
first ``n - ceil(8/9 n) + 1``. Texts that fill the slots of one template, but are less similar than
the threshold, have so many items of their own that the shorter prefix holds nothing common, so no
pair of them is formed. Texts just below the threshold that each differ from their crowd at other
places do share common items there; such pairs are compared, as no exact bound separates them.
Whatever is not compared is already connected or cannot be linked, and components come out as
if all candidate pairs had been confirmed. Buckets, pairs and components stay in Spark tables;
nothing is capped or collected.

Texts are read whole. Null text and text without words give an empty set, linked with nothing. doc_id
identifies a document: repeated rows of one doc_id are the same document and share its verdict, and
if their texts differ, the one with the greatest digest stands for it. A null doc_id never becomes a component_id unless its whole component has none; such rows are kept.
Other columns are not looked at, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, free_name, sized
from .words import LOWER, Ranges, U, mix, split_words, text_chunks

BANDS, ROWS, BITS = 36, 5, 2
SLOTS = BANDS * ROWS
LONGS = -(-SLOTS * BITS // 64)
SMALL_BUCKET = 6
LEADERS = 2

_seeds = mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_MULTIPLY, _ADD = (_seeds[:SLOTS] | U(1)).astype(np.uint64), _seeds[SLOTS:]
_LOW = 0x5555555555555555


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, and where each text's begin."""
    words = split_words(LOWER[buf], offsets)
    ranges = Ranges(words.values()[0])
    at = words.grams(n)
    doc, gram = words.doc[at], ranges(at, n)
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(few):
        doc = np.concatenate([doc, few])
        gram = np.concatenate([gram, ranges(words.first[few], words.counts[few])])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    doc, gram = doc[new], gram[new]
    return gram, np.searchsorted(doc, np.arange(len(offsets)))


def set_digests(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits for each non-empty set, as two columns of unsigned longs."""
    out = np.zeros((len(first) - 1, 2), U)
    some = np.diff(first) > 0
    if some.any():
        for k, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
            out[some, k] = mix(np.add.reduceat(mix(gram ^ U(salt)), first[:-1][some]) + np.diff(first)[some].astype(U))
    return out


def minima(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SLOTS minima of each non-empty set."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), SLOTS), np.uint32)
    step = 1 << 15
    lo = 0
    while lo < len(starts):  # pieces that stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + step)))
        end = starts[hi] if hi < len(starts) else len(gram)
        x, at = gram[starts[lo] : end], starts[lo:hi] - starts[lo]
        y, z = np.empty_like(x), np.empty(len(x), np.uint32)
        high = z.view(np.uint32)
        for k in range(SLOTS):
            np.multiply(x, _MULTIPLY[k], out=y)
            np.add(y, _ADD[k], out=y)
            high[:] = y.view(np.uint32)[1::2]
            out[lo:hi, k] = np.minimum.reduceat(high, at)
        lo = hi
    return out


def bands(slots: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(slots), BANDS), U)
    for r in range(ROWS):
        keys = mix(keys ^ slots[:, r::ROWS].astype(U)) + U(r + 1)
    return mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * U(0xA0761D6478BD642F))


def packed(slots: np.ndarray) -> np.ndarray:
    """The BITS lowest bits of every minimum."""
    low = mix(slots.astype(U)) & U((1 << BITS) - 1)
    out = np.zeros((len(slots), LONGS), U)
    for k in range(SLOTS):
        out[:, k * BITS // 64] |= low[:, k] << U(k * BITS % 64)
    return out


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1).view(np.int64)))


def _digest_array(digests: np.ndarray, empty: np.ndarray) -> pa.Array:
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(np.ascontiguousarray(digests).tobytes())])
    return pa.array([None if e else v for e, v in zip(empty.tolist(), flat.to_pylist(), strict=True)], pa.binary())


def _signer(shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_chunks(batch.column("text")):
                gram, first = shingle_sets(buf, offsets, shingle)
                sizes = np.diff(first)
                empty = sizes == 0
                slots = minima(gram, first)
                filled = np.flatnonzero(~empty)
                keys, bits = np.zeros((hi - lo, BANDS), U), np.zeros((hi - lo, LONGS), U)
                keys[filled], bits[filled] = bands(slots), packed(slots)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("at").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes, pa.int64()), _digest_array(set_digests(gram, first), empty), _lists(keys), _lists(bits)],
                    ["at", "doc_id", "n", "cid", "keys", "bits"],
                )

    return sign


def _setter(shingle: int):
    """Each text's digest and sorted set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_chunks(batch.column("text")):
                gram, first = shingle_sets(buf, offsets, shingle)
                cid = _digest_array(set_digests(gram, first), np.diff(first) == 0)
                yield pa.RecordBatch.from_arrays([batch.column("at").slice(lo, hi - lo), cid, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(gram.view(np.int64)))], ["at", "cid", "items"])

    return sets


def _prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text, and at: a long by which a text can be found again, also without a doc_id."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(doc, F.xxhash64(text)).alias("at"), doc.alias("doc_id"), text.alias("text"))


def estimate(x: Column, y: Column) -> Column:
    """Collision-corrected similarity of two packed signatures."""
    off = F.lit(0)
    for k in range(LONGS):
        z = x[k].bitwiseXOR(y[k])
        off = off + F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(_LOW)))
    return 1 - off / SLOTS / (1 - 2.0**-BITS)


def _classes(signed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of repeated ``at``, the set that stands for each (at, own); of equal sets, the least ``at`` (cid, least); and the classes (at, cid, n, bits, keys)."""
    repeated = scratch.write(signed.groupBy("at").agg(F.count("*").alias("rows")).where("rows > 1").select("at"), "repeated")
    some = sized(repeated, 48)
    filled = signed.where("cid is not null").select("at", "cid", "n", "bits", "keys")
    one = filled.join(some, "at", "left_semi").groupBy("at").agg(F.max("cid").alias("own"))
    own = scratch.write(one, "own")
    merged = filled.join(sized(own, 80), "at").where("cid = own").groupBy("at", "cid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    sets = filled.join(some, "at", "left_anti").unionAll(merged)
    least = scratch.write(sets.groupBy("cid").agg(F.min("at").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "least")
    of_several = sets.join(sized(least, 80), "cid", "left").where("least is null or least = at")
    return own, least, scratch.write(of_several.select("at", "cid", "n", "bits", "keys"), "classes")


def link_classes(prepared: DataFrame, own: DataFrame, classes: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, root) for every class linked with another, by their ``at``."""
    lowest = percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / SLOTS + 0.25 * 0.75 / SLOTS) / (1 - 2.0**-BITS)
    rows = classes.select("at", F.explode("keys").alias("key"))
    # Aggregates that are joined back are written first: the join then has an exchange on either side, and a crowded key can be split.
    shared = scratch.write(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    entries = scratch.write(rows.join(sized(shared, 64), "key").select("key", "size", "at"), "entries")
    small, large = entries.where(F.col("size") <= SMALL_BUCKET), entries.where(F.col("size") > SMALL_BUCKET)
    signatures = classes.select("at", "n", "bits")

    def likely(met: DataFrame) -> DataFrame:
        """met: a, b. Of the distinct pairs, with the lesser class first, those whose sizes and packed signatures allow the similarity: a, b, na, nb."""
        pairs = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        one = signatures.withColumnsRenamed({"at": "a", "n": "na", "bits": "x"})
        two = signatures.withColumnsRenamed({"at": "b", "n": "nb", "bits": "y"})
        near = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate(F.col("x"), F.col("y")) >= lowest)
        return pairs.join(one, "a").join(two, "b").where(near).select("a", "b", "na", "nb")

    def led(members: DataFrame, leaders: DataFrame, salts: range) -> DataFrame:
        """Each member with the leaders of its bucket: those with the least salted hash."""
        heads = leaders.groupBy("key").agg(F.array(*[F.min_by("at", F.xxhash64("at", F.lit(s))) for s in salts]).alias("heads"))
        heads = scratch.write(heads, f"heads-{salts.start}")
        return members.join(sized(heads, 120), "key").select(F.col("at").alias("a"), F.explode("heads").alias("b"))

    listed = small.select("key", F.col("at").alias("a")).join(small.select("key", F.col("at").alias("b")), "key").where("a < b").select("a", "b")
    first = scratch.write(likely(listed.unionAll(led(large, large, range(LEADERS)))), "likely")
    wanted = scratch.write(first.select(F.explode(F.array("a", "b")).alias("at")).unionAll(large.select("at")).distinct(), "wanted")
    texts = prepared.select("at", "text").join(sized(wanted, 48), "at", "left_semi")
    sets = texts.mapInArrow(_setter(shingle), "at long, cid binary, items array<long>")
    repeated = sized(own.select("at"), 48)
    # Only the rows of repeated documents move.
    again = sets.join(repeated, "at", "left_semi").join(sized(own, 80), "at").where("cid = own").groupBy("at").agg(F.first("items").alias("items"))
    sets = scratch.write(sets.join(repeated, "at", "left_anti").select("at", "items").unionAll(again), "sets")

    def confirmed(some: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("at").alias("a"), F.col("items").alias("x")), sets.select(F.col("at").alias("b"), F.col("items").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return some.join(one, "a").join(two, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")

    links = scratch.write(confirmed(first), "links-0")
    scratch.drop("likely", "wanted", "shared")
    roots = scratch.write(components(links, scratch, "cc0"), "roots-0")
    k, before = 0, large.count()
    while True:
        named = scratch.write(large.join(roots.withColumnRenamed("node", "at"), "at", "left").select("key", "at", F.coalesce("root", "at").alias("root")), f"named-{k}")
        heads = named.groupBy("key", "root").agg(F.count("*").alias("in_root")).groupBy("key").agg(F.max_by("root", F.struct("in_root", "root")).alias("main"), F.max("in_root").alias("most"), F.sum("in_root").alias("size"))
        open_ = scratch.write(heads.where("most < size").select("key", "main"), f"open-{k}")
        rest = scratch.write(named.join(sized(open_, 72), "key"), f"rest-{k}")
        scratch.drop(f"named-{k}", f"open-{k}")
        apart, within = rest.agg(F.count(F.when(F.col("root") != F.col("main"), 1)), F.count(F.when(F.col("root") == F.col("main"), 1))).first()
        if not apart:
            break
        # Further leaders are worth a round while most members of crowds are still apart, and the last round brought some together.
        last = k >= 3 or apart <= within or apart > 0.9 * before
        before = apart
        some = _apart_pairs(rest, sets, signatures, percent, lowest, scratch) if last else likely(led(rest.where("root <> main"), rest.where("root = main"), range(LEADERS * (k + 1), LEADERS * (k + 2))))
        new = scratch.write(confirmed(scratch.write(some, f"likely-{k + 1}")), f"links-{k + 1}")
        links = links.unionAll(new)
        k += 1
        roots = scratch.write(components(links, scratch, f"cc{k}"), f"roots-{k}")
        scratch.drop(f"rest-{k - 1}", f"likely-{k}")
        if last:
            break
    return roots


def _apart_pairs(rest: DataFrame, sets: DataFrame, signatures: DataFrame, percent: int, lowest: float, scratch: Scratch) -> DataFrame:
    """a, b, na, nb: every pair of two components, one outside its bucket's main one, that the sets allow.

    With the items of all sets in one order, rarest first, the first item that two sets share stands
    at some place of each; what follows there bounds the intersection. So pairs are found by that item,
    where it lies in the short prefix of the smaller set and the long prefix of the larger.
    """
    mine = rest.groupBy("at").agg(F.max("root").alias("root"), F.max((F.col("root") != F.col("main")).cast("int")).alias("outside"))
    mine = scratch.write(mine.join(signatures, "at"), "mine")
    items = sets.join(mine.select("at"), "at", "left_semi").select("at", F.explode("items").alias("item"))
    often = scratch.write(items.groupBy("item").agg(F.count("*").alias("often")).where("often > 1"), "often")
    ordered = items.join(often, "item", "left").groupBy("at").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "item"))).alias("items"))
    # At place i, counted from 0, at most n - i items can be shared. A set that is similar enough shares percent/100 * n
    # of them at least, and with one that is no smaller, 2 * percent / (100 + percent) * n.
    long_, short = F.ceil(F.col("n") * percent / 100).cast("int"), F.ceil(F.col("n") * (2 * percent) / (100 + percent)).cast("int")
    n = F.col("n").cast("int")
    placed = mine.join(ordered, "at").select("at", "n", "bits", "root", "outside", F.posexplode(F.slice("items", F.lit(1), n - long_ + 1)).alias("i", "x"), (n - short).alias("last_"))
    placed = scratch.write(placed.where("x.often > 1").select("at", "n", "bits", "root", "outside", "i", F.col("x.item").alias("item"), (F.col("i") <= F.col("last_")).alias("early")), "placed")
    carried = ("at", "n", "bits", "root", "outside", "i")
    one = placed.where("early").select("item", *[F.col(c).alias(f"p_{c}") for c in carried])
    two = placed.select("item", *[F.col(c).alias(f"q_{c}") for c in carried])
    most = F.least(F.col("p_n") - F.col("p_i"), F.col("q_n") - F.col("q_i"))
    ordered_ = (F.col("p_n") < F.col("q_n")) | ((F.col("p_n") == F.col("q_n")) & (F.col("p_at") < F.col("q_at")))
    test = ordered_ & (F.col("p_root") != F.col("q_root")) & (F.col("p_outside") + F.col("q_outside") > 0) & ((100 + percent) * most >= percent * (F.col("p_n") + F.col("q_n")))
    met = one.join(two, "item").where(test & (estimate(F.col("p_bits"), F.col("q_bits")) >= lowest))
    low = F.col("p_at") < F.col("q_at")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    return met.select(pick("p_at", "q_at").alias("a"), pick("q_at", "p_at").alias("b"), pick("p_n", "q_n").alias("na"), pick("q_n", "p_n").alias("nb")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; documents are linked if 100 * intersection >= percent * union."""
    scratch = Scratch(docs.sparkSession)
    prepared = _prepared(docs)
    signed = scratch.write(prepared.mapInArrow(_signer(shingle), "at long, doc_id long, n long, cid binary, keys array<long>, bits array<long>"), "signed")
    own, least, classes = _classes(signed, scratch)
    roots = link_classes(prepared, own, classes, shingle, percent, scratch)
    rows = signed.select("at", "doc_id", "n", "cid").join(sized(own, 80), "at", "left").withColumn("cid", F.coalesce("own", "cid"))
    rows = rows.join(sized(least, 80), "cid", "left").withColumn("node", F.when(F.col("cid").isNotNull(), F.coalesce("least", "at")))
    rows = scratch.write(rows.join(sized(roots, 64), "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("group")), "rows")
    # A written aggregate, so that the join has an exchange on either side and a large component's rows can be split. A group of one row needs no join.
    firsts = scratch.write(rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).where("size > 1").drop("size"), "firsts")
    told = rows.join(sized(firsts, 64), "group", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("first", "doc_id").alias("component_id"),
    )
    told = told.withColumn("kept", F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
    return scratch.keep(told, "verdicts")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the least doc_id of their component, columns as they were.

    Rows without a doc_id stay, and repeated rows of one doc_id, being one document, stay or go together.
    """
    scratch = Scratch(docs.sparkSession)
    gone = F.col("doc_id").alias("gone")
    gone = scratch.keep(near_duplicates(docs, shingle, percent).where("not kept and doc_id is not null").select(gone).distinct(), "gone")
    key = free_name("key", docs.columns)
    marked = docs.withColumn(key, F.col("doc_id").cast("long"))
    return marked.join(sized(gone.withColumnRenamed("gone", key), 48), key, "left_anti").drop(key).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2, percent=80)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i+1] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) >= 2)
      UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(d, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.d = w.doc_id
"""
