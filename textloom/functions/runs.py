"""Terms of whole texts counted within each document, over Arrow batches of bytes.

A document's term frequencies depend on its own text only, so they are counted where the text is
read; nothing is shuffled. Terms are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 20


def _chunks(column: pa.Array, limit: int = _CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi with their bytes and offsets; a chunk has about ``limit`` bytes or one text."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def letter_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each run of ASCII letters: its text and its number among the distinct lower-cased runs; and those."""
    inside = _LETTER[buf]
    begins, ends = inside.copy(), inside.copy()
    cut = offsets[(offsets > 0) & (offsets < len(buf))]
    begins[1:] &= ~inside[:-1]
    begins[cut] = inside[cut]
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    spans = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=spans[1:])
    coded = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(spans), pa.py_buffer(_LOWER[buf[inside]])]).dictionary_encode()
    return np.searchsorted(offsets, start, side="right") - 1, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _kept(distinct: pa.Array, stops: pa.Array) -> np.ndarray:
    return ~np.asarray(pa.compute.is_in(distinct, value_set=stops))


def counter(stops: list[str]) -> Callable:
    """Of batches (doc_id, text): a row (term, doc_id, tf) for each term of each document that is no stop word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        words = pa.array(stops, pa.large_string())
        for batch in batches:
            for lo, hi, buf, offsets in _chunks(batch.column(1)):
                doc, number, distinct = letter_runs(buf, offsets)
                if stops:
                    keep = _kept(distinct, words)[number]
                    doc, number = doc[keep], number[keep]
                both, tf = np.unique(doc * max(len(distinct), 1) + number, return_counts=True)
                doc, number = np.divmod(both, max(len(distinct), 1))
                yield pa.RecordBatch.from_arrays([distinct.take(pa.array(number)).cast(pa.string()), batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(tf, pa.int64())], ["term", "doc_id", "tf"])

    return count


def measurer(stops: list[str]) -> Callable:
    """Of batches (doc_id, text): a row (doc_id, dl) for each document, dl without stop words."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        words = pa.array(stops, pa.large_string())
        for batch in batches:
            for lo, hi, buf, offsets in _chunks(batch.column(1)):
                doc, number, distinct = letter_runs(buf, offsets)
                if stops:
                    doc = doc[_kept(distinct, words)[number]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.bincount(doc, minlength=hi - lo), pa.int64())], ["doc_id", "dl"])

    return measure


#: Bytes of text whose terms are counted together where only their numbers are needed.
_WIDE = 1 << 22


def _counts(buf: np.ndarray, offsets: np.ndarray, stops: list[list[str]], stems: list[bool]) -> tuple[list[np.ndarray], list[tuple]]:
    """Of some texts under several configurations: each one's lengths; and for words, then stems, if asked for: (stemmed, terms, text, term, tf of each configuration)."""
    from .stem import stem

    doc, number, distinct = letter_runs(buf, offsets)
    width = max(len(distinct), 1)
    keep = [_kept(distinct, pa.array(s, pa.large_string())) if s else np.ones(len(distinct), bool) for s in stops]
    both, tf = np.unique(doc * width + number, return_counts=True)
    doc, number = np.divmod(both, width)
    lengths = [np.bincount(doc, tf * k[number], len(offsets) - 1).astype(np.int64) for k in keep]
    out = []
    if not all(stems):
        out.append((False, distinct, doc, number, [None if x else tf * k[number] for x, k in zip(stems, keep, strict=True)]))
    if any(stems):
        coded = pa.array([stem(w) for w in distinct.to_pylist()], pa.large_string()).dictionary_encode()
        of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        width = max(len(coded.dictionary), 1)
        one, place = np.unique(doc * width + of[number], return_inverse=True)
        sums = [np.bincount(place, tf * k[number], len(one)).astype(np.int64) if x else None for x, k in zip(stems, keep, strict=True)]
        out.append((True, coded.dictionary, *np.divmod(one, width), sums))
    return lengths, out


def vocabulary_counter(stops: list[list[str]], stems: list[bool]) -> Callable:
    """Of batches (doc_id, text): rows stemmed, term, n0, n1, ... with the numbers of documents under each configuration; null for the term counts documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        names = ["stemmed", "term", *(f"n{k}" for k in range(len(stops)))]
        for batch in batches:
            for lo, hi, buf, offsets in _chunks(batch.column(1), _WIDE):
                yield pa.RecordBatch.from_arrays([pa.array([False]), pa.array([None], pa.string()), *(pa.array([hi - lo], pa.int64()) for _ in stops)], names)
                for stemmed, terms, _, term, tfs in _counts(buf, offsets, stops, stems)[1]:
                    n = [np.zeros(len(terms), np.int64) if tf is None else np.bincount(term[tf > 0], minlength=len(terms)) for tf in tfs]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), stemmed)), terms.cast(pa.string()), *(pa.array(x, pa.int64()) for x in n)], names)

    return count


def profiler(stops: list[list[str]], stems: list[bool], often, n_docs: int, wanted: list[list[str]]) -> Callable:
    """Of batches (doc_id, text): for each document a row with its length dl0, ..., the squared ltn weights sq0, ... of the terms
    that ``often`` (a broadcast table stemmed, term, n0, ...) has, and ``hits``, its wanted terms under each configuration; and for
    each of its other terms a row stemmed, term, tf0, ..."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        every = range(len(stops))
        table = often.value
        held = {s: table.filter(pa.compute.equal(table["stemmed"], s)) for s in (False, True)}
        place = {s: {w: k for k, w in enumerate(t["term"].to_pylist())} for s, t in held.items()}
        df = {s: [np.append(t[f"n{k}"].to_numpy(), 0) for k in every] for s, t in held.items()}
        idf = {s: [np.where((x > 0) & (x < n_docs), np.log10(max(n_docs, 1) / np.maximum(x, 1)), 0.0) for x in of] for s, of in df.items()}
        find = [set(w) for w in wanted]
        for batch in batches:
            for lo, hi, buf, offsets in _chunks(batch.column(1), _WIDE):
                lengths, parts = _counts(buf, offsets, stops, stems)
                ids, n = batch.column(0).slice(lo, hi - lo), hi - lo
                squares, hits = [np.zeros(n) for _ in every], []
                for stemmed, terms, doc, term, tfs in parts:
                    words = terms.to_pylist()
                    at = np.fromiter((place[stemmed].get(w, -1) for w in words), np.int64, len(words))[term]
                    for k, tf in enumerate(tfs):
                        if tf is None:
                            continue
                        has = np.flatnonzero(tf > 0)
                        w = (1 + np.log10(tf[has])) * idf[stemmed][k][at[has]]
                        squares[k] += np.bincount(doc[has], w * w, n)
                        asked = np.array([w in find[k] for w in words], bool)[term[has]]
                        one = has[asked]
                        hits.append((doc[one], np.full(len(one), k), terms.take(pa.array(term[one])), tf[one]))
                    rare = np.flatnonzero(at < 0)
                    none = pa.nulls(len(rare), pa.int64())
                    tfs = [none if tf is None else pa.array(tf[rare], pa.int64()) for tf in tfs]
                    yield _profile_row(ids.take(pa.array(doc[rare])), pa.array(np.full(len(rare), stemmed)), terms.take(pa.array(term[rare])).cast(pa.string()), tfs, [none] * len(stops), [pa.nulls(len(rare), pa.float64())] * len(stops), None)
                doc = np.concatenate([h[0] for h in hits])
                order = np.argsort(doc, kind="stable")
                listed = pa.StructArray.from_arrays([pa.array(np.concatenate([h[1] for h in hits])[order], pa.int32()), pa.concat_arrays([h[2].cast(pa.string()) for h in hits]).take(pa.array(order)), pa.array(np.concatenate([h[3] for h in hits])[order], pa.int64())], ["config", "term", "tf"])
                ends = np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32)
                none = pa.nulls(n, pa.int64())
                yield _profile_row(ids, pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string()), [none] * len(stops), [pa.array(x) for x in lengths], [pa.array(x) for x in squares], pa.ListArray.from_arrays(pa.array(ends), listed))

    return profile


def _profile_row(ids, stemmed, term, tfs, lengths, squares, hits) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("config", pa.int32()), ("term", pa.string()), ("tf", pa.int64())]))
    columns = {"doc_id": ids, "stemmed": stemmed, "term": term, "hits": pa.nulls(len(ids), kind) if hits is None else hits}
    for name, of in (("tf", tfs), ("dl", lengths), ("sq", squares)):
        columns |= {f"{name}{k}": x for k, x in enumerate(of)}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
